"""Growing rosters as streams: first rows per voter, counts, and supplement upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sets import upsert


def roster_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Roster rows of a growing folder of Parquet files; ``ts`` is their event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_rows(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """One row per voter within the watermark (the state drops voters older than it)."""
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["vuid"])


def daily_counts(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Rows per day and ballot type, final once the watermark has passed."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "ballot_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("day"), "ballot_type", "n"
    )


def upsert_into(rows: DataFrame, target: str, checkpoint: str, key: str = "vuid", order: str = "ord") -> StreamingQuery:
    """Merge each micro-batch into a table of versions: ``target/v=N`` holds the state after batch N - 1 (U-05).

    A batch that is run again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{target}/v={number}") if number else batch.limit(0)
        upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{target}/v={number + 1}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
