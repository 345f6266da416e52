"""Set operations on keyed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_wins, last_wins


def list_difference(a: DataFrame, b: DataFrame, key: str = "vuid") -> DataFrame:
    """(in_both, only_first, only_second): key counts of two lists in one aggregation (U-01, U-03)."""
    both = a.select(key).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(
        b.select(key).withColumn("a", F.lit(0)).withColumn("b", F.lit(1))
    )
    each = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(
        F.count(F.when((F.col("a") == 1) & (F.col("b") == 1), 1)).alias("in_both"),
        F.count(F.when((F.col("a") == 1) & (F.col("b") == 0), 1)).alias("only_first"),
        F.count(F.when((F.col("a") == 0) & (F.col("b") == 1), 1)).alias("only_second"),
    )


def only_in_first(a: DataFrame, b: DataFrame, key: str = "vuid") -> DataFrame:
    """First rows of the keys that the second list has not (U-02)."""
    return first_wins(a.join(b.select(key), key, "left_anti"), [key])


def upsert(main: DataFrame, supplement: DataFrame, key: str = "vuid", order: str = "ord") -> DataFrame:
    """Main rows (first wins) replaced or joined by supplement rows (last wins), all columns of both (U-05, U-06)."""
    new = last_wins(supplement.filter(F.coalesce(key, F.lit("")) != ""), [key], order)
    old = first_wins(main.filter(F.coalesce(key, F.lit("")) != ""), [key], order)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_unknown(known: DataFrame, unknown: DataFrame, blank: str = "address") -> DataFrame:
    """The rows of all partitions and those of voters that no list knows, with a blank address (U-07)."""
    return known.unionByName(unknown.select(*[F.lit("").alias(c) if c == blank else F.col(c) for c in known.columns]))


def unused(master: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Master keys that are never used (U-08)."""
    return master.select(key).distinct().join(used.select(key), key, "left_anti")
