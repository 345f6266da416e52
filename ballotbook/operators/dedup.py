"""Duplicates, first and last rows, ordered folds. Order comes from a column, never from arrival.

First and last rows are aggregates with map-side partial results, so a key with any number of rows costs one
row per task in the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def with_key(df: DataFrame, key: str) -> DataFrame:
    """The rows with a key that is not blank (P-06); ``counters`` says how many are left out."""
    return df.filter(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")


def counters(df: DataFrame, key: str, filled: str) -> DataFrame:
    """One row: rows, blank keys, distinct keys, later rows of a key, filled and empty values of a column (A-32)."""
    some = F.nullif(F.trim(F.coalesce(F.col(key), F.lit(""))), F.lit(""))
    value = F.trim(F.coalesce(F.col(filled), F.lit("")))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(some.isNull(), 1)).alias("n_blank_keys"), F.countDistinct(some).alias("n_keys"),
        (F.count(some) - F.countDistinct(some)).alias("n_duplicates"), F.count(F.when(value != "", 1)).alias("n_filled"),
        F.count(F.when(value == "", 1)).alias("n_empty"),
    )


def first_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The row of each key that comes first (W-01)."""
    return _pick(df, keys, F.min_by, order)


def last_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The row of each key that comes last (W-02)."""
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: list[str], by, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(by(F.struct(*rest), F.col(order)).alias("__row"))
    return found.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def duplicate_listing(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Each later row of a key beside the order of its first row (W-03)."""
    first = df.groupBy(*keys).agg(F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("__n"))
    return df.join(first.filter("__n > 1").drop("__n"), keys).filter(F.col(order) > F.col("first_ord"))


def prefer(df: DataFrame, keys: list[str], better: Column, order: str = "ord") -> DataFrame:
    """The first row of each key for which ``better`` holds, else the first row (W-04)."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct((~better).cast("int"), F.col(order))
    found = df.withColumn("__rank", rank).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("__rank")).alias("__row"))
    return found.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_association(df: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """(key, first value, number of distinct values): a map with its conflicts (W-12)."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value), F.countDistinct(value).alias("n_values"))


def repeated_groups(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Groups with several members, all keys non-blank, numbered in key order (A-17, W-13).

    The numbering is one global order over the groups that are left, which are few beside the rows.
    """
    some = None
    for k in keys:
        here = F.coalesce(F.col(k), F.lit("")) != ""
        some = here if some is None else some & here
    groups = df.filter(some).groupBy(*keys).agg(F.countDistinct(member).alias("n_members")).filter("n_members > 1")
    return number_rows(groups, keys).withColumnRenamed("number", "group_no")


def number_rows(df: DataFrame, keys: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """Rows numbered from 1 in key order: ranges are sorted apart and offset by the counts before them.

    The sorted rows are written once and numbered as written, so counts and rows are of the same ranges. Nulls come
    first, and last in descending keys; rows with equal keys are numbered in any order. An empty table stays empty.
    """
    order = [F.col(k).desc() if k in descending else F.col(k).asc() for k in keys]
    ordered = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    # One row for each partition.
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(
        "__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    return (
        ordered.withColumn("__part", part).join(F.broadcast(before), "__part")
        .withColumn("number", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1)
        .drop("__at", "__part", "__before")
    )


def folded(df: DataFrame, key: str, columns: list[str], order: str = "ord") -> DataFrame:
    """Distinct combinations of the columns in first-seen order, each column then joined without repeats (A-20).

    Rows in which the first two columns are blank are left out. A key's list is as long as its distinct
    combinations.
    """
    blank = (F.coalesce(F.col(columns[0]), F.lit("")) == "") & (F.coalesce(F.col(columns[1]), F.lit("")) == "")
    seen = df.filter(~blank).groupBy(key, *columns).agg(F.min(order).alias("__ord"))
    rows = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__ord", *columns))).alias("__rows"))
    seen_values = [F.array_join(F.array_distinct(F.col(f"__rows.{c}")), ";").alias(c) for c in columns]
    return rows.select(key, *seen_values)
