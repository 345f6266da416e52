"""Shared-folder tables that cut lineage, and Arrow batch limits.

Every intermediate table is Parquet below ``spark.checkpoint.dir``, the folder that all executors
share; a lost executor costs the running tasks only. The tables go when the application ends.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import delete, file_system, new_folder

#: Rows and bytes that one Arrow batch may hold on its way to Python.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes: long texts then come a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="ballotbook-code-")) / "ballotbook.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


class Workspace:
    """Tables of one operator run in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str, codec: str = "zstd"):
        self.spark, self.codec = spark, codec
        self.root = new_folder(spark, name)
        self._n = 0
        bound_batches(spark)
        ship_package(spark)

    def path(self, label: str) -> str:
        """A path below the root that was not given out before."""
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back: computed once, without lineage."""
        path = self.path(label)
        schema = df.schema
        df.write.option("compression", self.codec).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._ballotbook_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that nothing will read again."""
        for df in tables:
            path = getattr(df, "_ballotbook_path", None)
            if path:
                delete(self.spark, path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of ended jobs, which it does once their plans are collected."""
        self.spark.sparkContext._jvm.System.gc()


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, asked of Hadoop's file system."""
    fs, p = file_system(spark, path)
    return fs.getContentSummary(p).getLength()
