"""Tables in the folder that all executors share: what must be computed once is written there and read back.

The folder is ``spark.checkpoint.dir``. A local session without that setting gets one temporary folder; on a cluster
the setting is asked for, since executors do not see each other's disks. Folders go when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; set to a fresh temporary one in a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ballotbook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path, whichever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: computed once, without lineage."""
    path = f"{new_folder(df.sparkSession, label)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
