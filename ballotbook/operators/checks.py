"""Data checks V-01 to V-16: each returns the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import field
from .ordered import contest_groups


def contest_shape(lines: DataFrame, starts: str | None = None) -> DataFrame:
    """Lines of contests whose second line is no ``Vote For: n`` of two parts (V-01).

    Without ``starts`` only contests with a Vote-For line can be told; ``starts`` is a pattern of contest titles, and
    titles that no such line follows are found too.
    """
    bad = contest_groups(lines).filter("role = 'vote_for'").filter(F.size(F.split("line", ":")) != 2)
    if starts is None:
        return bad
    some = lines.filter(field("line") != "")
    following = F.lead(F.lower(field("line"))).over(Window.partitionBy("file").orderBy("line_no"))
    titles = some.withColumn("__next", F.coalesce(following, F.lit(""))).filter(
        field("line").rlike(starts) & ~F.col("__next").startswith("vote for:")
    )
    return bad.unionByName(titles.drop("__next").withColumn("contest_no", F.lit(None).cast("long")).withColumn("role", F.lit("contest")))


def selection_counts(rows: DataFrame) -> DataFrame:
    """Contests of a ballot whose selections are not vote-for, or more if overvoted (V-02)."""
    each = rows.groupBy("ballot", "contest").agg(
        F.max("vote_for").alias("vote_for"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("status") == "Overvoted", 1).otherwise(0)).alias("over")
    )
    return each.filter(((F.col("over") == 0) & (F.col("n") != F.col("vote_for"))) | ((F.col("over") == 1) & (F.col("n") <= F.col("vote_for"))))


def status_text(rows: DataFrame) -> DataFrame:
    """Statuses with parentheses (V-03)."""
    return rows.filter(F.col("status").rlike(r"[()]"))


def barcode_counts(ballots: DataFrame) -> DataFrame:
    """Ballots whose barcodes are not as many as their counted selections (V-04, V-09)."""
    return ballots.filter((F.size("barcodes") > 0) & (F.size("barcodes") != F.col("n_counted")))


def style_codes(ballots: DataFrame) -> DataFrame:
    """Ballots with barcodes and no 28-digit style code (V-05)."""
    return ballots.filter((F.size("barcodes") > 0) & ~F.coalesce(F.col("style_code").rlike("^[0-9]{28}$"), F.lit(False)))


def barcode_lengths(codes: DataFrame) -> DataFrame:
    """Codes that are none of 28, 8 or 6 digits (V-06)."""
    return codes.filter(~F.coalesce(F.col("code").rlike("^([0-9]{28}|[0-9]{8}|[0-9]{6})$"), F.lit(False)))


def batch_totals(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """Contests whose batches do not add up to the total (V-07)."""
    sums = shares.groupBy("contest").agg(F.sum(F.col("n_batch") + F.col("n_rest")).alias("sum"))
    return sums.join(totals, "contest").filter(F.col("sum") != F.col("total"))


def duplicate_barcodes(styles: DataFrame) -> DataFrame:
    """Barcodes that a style holds several times (V-08)."""
    return styles.groupBy("style", "barcode").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def header_labels(headers: DataFrame, expected: list[str]) -> DataFrame:
    """Files whose header row lacks an expected label (V-10)."""
    have = F.transform("labels", lambda x: F.lower(field(x)))
    return headers.filter(~reduce(lambda a, b: a & b, [F.array_contains(have, e.lower()) for e in expected]))


def sheet_counts(sheets: DataFrame, expected: int) -> DataFrame:
    """Workbooks with another number of sheets (V-11)."""
    return sheets.groupBy("file").agg(F.countDistinct("sheet").alias("n")).filter(F.col("n") != expected)


def file_dates(files: DataFrame) -> DataFrame:
    """File names whose first word is no dotted date of three parts (V-12)."""
    return files.filter(F.size(F.split(F.get(F.split("name", " "), F.lit(0)), r"\.")) != 3)


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """(name): the required columns that are missing (V-13)."""
    have = {c.strip().upper() for c in df.columns}
    return df.sparkSession.createDataFrame([(n,) for n in names if n.upper() not in have], "name string")


def over_column_limit(spark: SparkSession, names: list[str], limit: int = 1024) -> DataFrame:
    """(name, position) of the columns beyond the limit (V-15)."""
    return spark.createDataFrame([(n, k) for k, n in enumerate(names, 1) if k > limit], "name string, position long")


def district_conflicts(precincts: DataFrame) -> DataFrame:
    """Precincts seen in several districts (V-14)."""
    return precincts.filter("n_values > 1")


def history_letters(rows: DataFrame) -> DataFrame:
    """History strings with letters that no score knows (V-16)."""
    return rows.filter(~F.upper("history").rlike("^[RD_]*(~.*)?$"))
