"""Writers. Outputs are folders that executors write in parallel; one file only where asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list | None = None, one_file: bool = False) -> None:
    """Chosen columns as delimited text with a header (K-01 to K-05, K-08 to K-11). With ``order`` the files in
    name order are sorted."""
    out = df.select(*columns) if columns else df
    out = out.orderBy(*order) if order else out
    out = out.coalesce(1) if one_file else out
    out.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_by_value(df: DataFrame, path: str, column: str, order: list[str]) -> None:
    """A folder for each value, sorted inside (K-06, K-07). Rows of a value are spread by the sort columns as well,
    so a large value has several files in order."""
    folded = [F.lower(field(c)) for c in order]
    df.repartitionByRange(column, *folded).sortWithinPartitions(column, *folded).write.mode("overwrite").partitionBy(column).option(
        "header", "true"
    ).csv(path)


def write_text(df: DataFrame, path: str, column: str = "line", append: bool = False) -> None:
    """One text column as lines (K-12, K-15)."""
    df.select(F.col(column).alias("value")).write.mode("append" if append else "overwrite").text(path)


def with_blocks(early: DataFrame, election_day: DataFrame) -> DataFrame:
    """Early voting sites as block 0, election day sites as block 1."""
    return early.withColumn("block", F.lit(0)).unionByName(election_day.withColumn("block", F.lit(1)))


def sites_in_blocks(early: DataFrame, election_day: DataFrame, order: list[str]) -> DataFrame:
    """Early voting sites, then election day sites, each sorted (K-09)."""
    return with_blocks(early, election_day).orderBy("block", *order).drop("block")
