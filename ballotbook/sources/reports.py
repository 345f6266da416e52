"""Paginated ballot listings (S-04) and cast vote record text (S-15, W-09, W-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.history import style_text_parts
from ..functions.text import field
from ..operators.ordered import carry, contest_groups


def ballot_listing(rows: DataFrame, columns: list[str], header: str = "Order", page: str = "Ballot Detail Listing", style: str = "Ballot Style") -> DataFrame:
    """The detail rows of a paginated listing with their style: (file, line_no, ballot_type, style, columns).

    Rows: file, line_no, cells. A page begins with its title and ends at the next; rows between a page's title and
    its column header are its head; a style line applies until the next, also within a page.
    """
    text = F.array_join("cells", " ")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_page, is_style = F.contains(text, F.lit(page)), F.contains(text, F.lit(style))
    is_head = field(F.get("cells", F.lit(0))) == header
    marked = rows.select("file", "line_no", "cells", text.alias("t"), is_page.alias("p"), is_style.alias("s"), is_head.alias("h"))
    marked = carry(marked, F.when(F.col("s"), F.col("t")), "style_text", ["line_no"])
    last = lambda c: F.max(F.when(F.col(c), F.col("line_no"))).over(w)
    inside = marked.withColumn("__p", last("p")).withColumn("__h", last("h"))
    inside = inside.filter(~F.col("p") & ~F.col("s") & ~F.col("h") & (F.col("__h") > F.coalesce("__p", F.lit(-1))))
    parts = style_text_parts(F.col("style_text"))
    cells = [field(F.get("cells", F.lit(k))).alias(c) for k, c in enumerate(columns)]
    out = inside.select("file", "line_no", *[c.alias(n) for n, c in parts.items()], *cells)
    return out.filter(F.concat(*columns) != "")


def pages_without_header(rows: DataFrame, header: str = "Order", page: str = "Ballot Detail Listing") -> DataFrame:
    """Pages that have no column header."""
    text = F.array_join("cells", " ")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    no = F.sum(F.contains(text, F.lit(page)).cast("int")).over(w)
    head = (field(F.get("cells", F.lit(0))) == header).cast("int")
    pages = rows.withColumn("page_no", no).withColumn("__h", head).filter("page_no > 0").groupBy("file", "page_no").agg(F.max("__h").alias("h"))
    return pages.filter("h = 0").drop("h")


def cast_vote_records(lines: DataFrame) -> DataFrame:
    """Selections of cast vote record text in long form: (ballot, ord, contest, vote_for, selection, status).

    Lines: file, line_no, line. Below ``Vote For: n`` a selection's name may wrap until its ``(id)``; the line
    after it is its status.
    """
    groups = contest_groups(lines.withColumn("line", field("line"))).filter("contest_no > 0")
    within = Window.partitionBy("file", "contest_no").orderBy("line_no")
    head = F.first(F.when(F.col("role") == "contest", F.col("line")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    votes = F.first(F.when(F.col("role") == "vote_for", field(F.get(F.split("line", ":"), F.lit(1))).try_cast("long")), ignorenulls=True).over(
        within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    body = groups.withColumn("contest", F.regexp_replace(head, r"\s*\([0-9]+\)\s*$", "")).withColumn("vote_for", votes).filter("role = 'selection'")
    ends = body.withColumn("__end", F.col("line").rlike(r"\([0-9]+\)\s*$"))
    status = F.coalesce(F.lag("__end").over(within), F.lit(False))
    marked = ends.withColumn("__status", status)
    no = F.sum(F.col("__status").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    each = marked.withColumn("__no", F.coalesce(no, F.lit(0))).groupBy("file", "contest_no", "contest", "vote_for", "__no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("__status"), F.struct("line_no", "line")))), lambda x: x["line"]), " ").alias("selection"),
        F.max(F.when(F.col("__status"), F.col("line"))).alias("status"),
        F.min("line_no").alias("ord"),
    )
    name = F.regexp_replace("selection", r"\s*\([0-9]+\)\s*$", "")
    return each.select(F.col("file").alias("ballot"), "ord", "contest", "vote_for", name.alias("selection"), "status").filter("selection != ''")
