"""Operators over file order: fill-down, sides and pages, carried styles, segments and groups of lines.

A file is the unit of work: windows are partitioned by file, so one file is sorted in one task and any number
of files run apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field, header_value, last_token_count, to_int_or_zero


def _so_far(*order: str) -> Window:
    return Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fill_down(df: DataFrame, lead: str, columns: list[str], order: list[str]) -> DataFrame:
    """Rows without both row_no and col_no go; blank ``lead`` rows take the columns of the last that has it (W-06)."""
    some = df.filter(F.col("row_no").isNotNull() | F.col("col_no").isNotNull())
    own = F.when(F.col(lead).isNotNull(), F.struct(*columns))
    filled = some.withColumn("__f", F.last(own, ignorenulls=True).over(_so_far(*order)))
    return filled.select(*[F.col(f"__f.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def sides_and_pages(df: DataFrame, order: list[str]) -> DataFrame:
    """ballot_no, side_no and page_no: a drop in ``seq`` begins a ballot; in it a drop in col_no turns the side and
    every second turn the page (W-07)."""
    w = Window.partitionBy("file").orderBy(*order)
    new = F.coalesce(F.col("seq") < F.lag("seq").over(w), F.lit(True))
    drop = ~new & F.coalesce(F.col("col_no") < F.lag("col_no").over(w), F.lit(False))
    marked = df.withColumn("__new", new.cast("int")).withColumn("__drop", drop.cast("int"))
    ballots = marked.withColumn("ballot_no", F.sum("__new").over(_so_far(*order)))
    turns = F.sum("__drop").over(
        Window.partitionBy("file", "ballot_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ballots.withColumn("__k", turns)
        .withColumn("side_no", (1 + F.col("__k") % 2).cast("int"))
        .withColumn("page_no", (1 + F.floor(F.col("__k") / 2)).cast("int"))
        .drop("__new", "__drop", "__k")
    )


def carry(df: DataFrame, value: Column, name: str, order: list[str]) -> DataFrame:
    """The last value so far (W-08)."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_so_far(*order)))


def tape_segments(lines: DataFrame, keywords: list[str], end: str = "END OF REPORT") -> DataFrame:
    """Tapes of scanned text: (file, tape, serial, counters, one count per keyword) (W-11, D15).

    Lines: file, line_no, line. A tape ends at a line with ``end`` and without a colon. Each field takes its last
    value in the tape. The lines after a file's last end are a tape only with a serial number.
    """
    text = field("line")
    is_end = F.contains(F.upper(text), F.lit(end)) & ~F.contains(text, F.lit(":"))
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("__end", is_end.cast("int")).withColumn("tape", F.coalesce(F.sum("__end").over(before), F.lit(0)))
    key, value = field(F.get(F.split(text, ":", 2), F.lit(0))), field(F.get(F.split(text, ":", 2), F.lit(1)))
    pair = F.contains(text, F.lit(":"))
    last = lambda hit, v: F.max_by(F.when(hit, v), F.when(hit, F.col("line_no")))
    count = lambda name: last(pair & F.contains(F.lower(key), F.lit(name.lower())), to_int_or_zero(value))
    out = marked.groupBy("file", "tape").agg(
        last(pair & F.contains(F.lower(key), F.lit("number")), value).alias("serial"),
        count("Public Count").alias("public_count"),
        count("ExpressVote Cards").alias("cards"),
        count("Sheets Processed").alias("sheets"),
        *[last(~pair & text.rlike("(?i)" + k), last_token_count(text)).alias(k) for k in keywords],
        F.max("__end").alias("__ended"),
    )
    return out.filter((F.col("__ended") == 1) | F.col("serial").isNotNull()).drop("__ended")


def header_fields(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of each ``key: value`` header per file (F-30)."""
    return lines.groupBy("file").agg(
        *[F.max_by(header_value("line", k), F.when(header_value("line", k).isNotNull(), F.col("line_no"))).alias(k.lower().replace(" ", "_")) for k in keys]
    )


def contest_groups(lines: DataFrame) -> DataFrame:
    """Lines grouped by contest: a contest begins at the line before ``Vote For:`` or, where names wrap, at the
    first line after the contest before it (W-10). Returns file, contest_no, line_no, line, role."""
    w = Window.partitionBy("file").orderBy("line_no")
    is_for = F.lower(field("line")).startswith("vote for:")
    some = lines.filter(field("line") != "")
    starts = some.withColumn("__for", is_for).withColumn("__start", F.coalesce(F.lead(is_for).over(w), F.lit(False)))
    numbered = starts.withColumn("contest_no", F.sum(F.col("__start").cast("int")).over(_so_far("line_no")))
    role = F.when(F.col("contest_no") == 0, "header").when(F.col("__start"), "contest").when(F.col("__for"), "vote_for").otherwise("selection")
    return numbered.withColumn("role", role).drop("__for", "__start")
