"""Voting history strings and scores, and ballot barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col, date_of, field

# Primary election dates, newest first.
PRIMARY_DATES = [
    "2026-03-03", "2024-03-05", "2022-03-01", "2020-03-03", "2018-03-06", "2016-03-01", "2014-03-04", "2012-05-29",
]


def calendar(spark: SparkSession, dates: list[str] = PRIMARY_DATES) -> DataFrame:
    """(position, day) of the elections, newest first: a fixed list as a relation (S-21)."""
    return spark.createDataFrame(list(enumerate(dates, 1)), "position int, day string")


def history_string(registered: Column | str, parties: list[Column | str], dates: list[str] = PRIMARY_DATES) -> Column:
    """One letter per election, newest first: the party's initial, ``_`` for a voter who could have voted,
    ``~`` for one registered less than 30 days before or on no known date (F-22)."""
    since = date_of(registered)
    letters = []
    for party, day in zip(parties, dates, strict=True):
        name = F.upper(field(party))
        could = since <= F.date_sub(F.lit(day).cast("date"), 30)
        letters.append(
            F.when(name != "", F.substring(name, 1, 1)).when(F.coalesce(could, F.lit(False)), F.lit("_")).otherwise(F.lit("~"))
        )
    return F.concat(*letters)


def _used(history: Column | str) -> Column:
    """The letters before the first ``~`` as an array; null if a letter other than R, D and _ is among them."""
    text = F.upper(col(history))
    return F.when(text.rlike("^[RD_]*(~|$)"), F.filter(F.split(F.regexp_extract(text, "^[^~]*", 0), ""), lambda x: x != ""))


def weighted_score(history: Column | str) -> Column:
    """Halving weights, R = 1, _ = 0.5, D = 0, in percent of the weights used; 0 without letters (F-23)."""
    value = lambda x: F.when(x == "R", 1.0).when(x == "_", 0.5).otherwise(0.0)
    letters = _used(history)
    total = F.aggregate(
        F.transform(letters, lambda x, i: value(x) * F.pow(F.lit(0.5), i)), F.lit(0.0), lambda a, x: a + x
    )
    weight = F.aggregate(F.transform(letters, lambda x, i: F.pow(F.lit(0.5), i)), F.lit(0.0), lambda a, x: a + x)
    return F.when(letters.isNull(), F.lit(None)).when(F.size(letters) == 0, F.lit(0.0)).otherwise(F.bround(total / weight * 100, 2))


def bisection_score(history: Column | str) -> Column:
    """50 plus or minus 25, 12.5, ... for R and D, up to the first ``~`` (F-24)."""
    letters = _used(history)
    step = lambda x, i: F.when(x == "R", 1.0).when(x == "D", -1.0).otherwise(0.0) * F.lit(25.0) * F.pow(F.lit(0.5), i)
    return F.bround(F.aggregate(F.transform(letters, step), F.lit(50.0), lambda a, x: a + x), 2)


def oval_barcode(column: Column, row: Column, side: Column, page: Column) -> Column:
    """CCRRSP as a number (F-25)."""
    return column * 10000 + row * 100 + side * 10 + page


def barcode_parts(code: Column) -> dict[str, Column]:
    """The parts of CCRRSP (F-26)."""
    return {
        "col_no": F.floor(code / 10000).cast("int"),
        "row_no": (F.floor(code / 100) % 100).cast("int"),
        "side_no": (F.floor(code / 10) % 10).cast("int"),
        "page_no": (code % 10).cast("int"),
    }


def style_code_parts(code: Column) -> dict[str, Column]:
    """The slices of a 28-digit style code (F-32, P-17)."""
    at = lambda a, n: F.substring(code, a, n).try_cast("int")
    return {
        "precinct_id": F.substring(code, 1, 10).try_cast("long"),
        "style_id": F.substring(code, 11, 10).try_cast("long"),
        "write_ins": at(22, 2),
        "selections": at(25, 2),
        "judge_initials": at(27, 1),
        "review_box": at(28, 1),
    }


def style_text_parts(text: Column) -> dict[str, Column]:
    """Ballot type (D, R, DZ, RZ) and style id of a style text (F-27)."""
    up = F.upper(text)
    return {
        "ballot_type": F.regexp_extract(up, r"\b([DR]Z?)\s*\d", 1),
        "style": F.regexp_extract(up, r"\b[DR]Z?\s*(\d+)", 1),
    }


def page_name_parts(name: Column) -> dict[str, Column]:
    """Stem and page number of one-page file names such as ``X-12.pdf`` (F-31)."""
    return {
        "stem": F.regexp_extract(name, r"^(.*?)[-_](\d+)\.pdf$", 1),
        "page": F.regexp_extract(name, r"^(.*?)[-_](\d+)\.pdf$", 2).try_cast("int"),
    }
