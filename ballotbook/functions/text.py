"""Text, number and date expressions. Blank and missing are the same: ``''``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field(c: Column | str) -> Column:
    """A field as text without outer white space; missing is blank (P-03)."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def normalize_text(c: Column | str) -> Column:
    """Upper case, white space collapsed (F-01)."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))), r"\s+", " "))


def fold(c: Column | str) -> Column:
    """Case-blind comparison form (F-17); differs from full case folding only for letters such as sharp s."""
    return F.lower(field(c))


def nan_to_empty(c: Column | str) -> Column:
    """Spreadsheet blanks and the text ``nan`` become blank (F-18)."""
    text = field(c)
    return F.when(F.lower(text) == "nan", F.lit("")).otherwise(text)


def zip5(c: Column | str) -> Column:
    """The first five digits, or fewer (F-02)."""
    return F.substring(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), "[^0-9]", ""), 1, 5)


def zip_split(zip_code: Column | str, plus4: Column | str) -> tuple[Column, Column]:
    """(five digits, usable +4 or blank); nine digits in one field split 5 + 4, an all-zero +4 is unusable (F-39)."""
    digits = F.regexp_replace(field(zip_code), "[^0-9]", "")
    long = F.length(digits) >= 9
    five = F.when(long, F.substring(digits, 1, 5)).otherwise(field(zip_code))
    own = F.regexp_replace(field(plus4), "[^0-9]", "")
    four = F.when(own != "", own).when(long, F.substring(digits, 6, 4)).otherwise(F.lit(""))
    return five, F.when(four.rlike("[1-9]"), four).otherwise(F.lit(""))


def to_int_or_zero(c: Column | str) -> Column:
    """Digits only, else 0 (F-28)."""
    text = field(c)
    return F.when(text.rlike("^[0-9]+$"), F.coalesce(text.try_cast("int"), F.lit(0))).otherwise(F.lit(0)).cast("int")


def last_token_count(c: Column | str) -> Column:
    """The count at the end of a line; a line of one token has none, 0 (F-29)."""
    tokens = F.split(normalize_text(c), " ")
    return F.when(F.size(tokens) > 1, to_int_or_zero(F.element_at(tokens, -1))).otherwise(F.lit(0))


def date_of(c: Column | str) -> Column:
    """A date in m/d/yyyy or yyyymmdd, else null."""
    return F.coalesce(F.try_to_date(field(c), "M/d/yyyy"), F.try_to_date(field(c), "yyyyMMdd"))


def compare_dates(a: Column | str, b: Column | str) -> Column:
    """-1, 0, 1, or null where a side is no date (F-19)."""
    return F.signum(F.datediff(date_of(a), date_of(b))).cast("int")


def date_part(c: Column | str) -> Column:
    """The first white-space token of a date and time (F-20)."""
    return F.coalesce(F.get(F.split(field(c), r"\s+"), F.lit(0)), F.lit(""))


def time_part(c: Column | str) -> Column:
    return F.coalesce(F.get(F.split(field(c), r"\s+"), F.lit(1)), F.lit(""))


def clean_precinct(c: Column | str) -> Column:
    """A precinct without its ``P `` or ``P Z`` prefix (F-21)."""
    return F.regexp_replace(field(c), "^P Z?", "")


def last_of_combined(c: Column | str) -> Column:
    """``Last, First Middle`` -> Last (F-16)."""
    return field(F.get(F.split(field(c), ",", 2), F.lit(0)))


def first_of_combined(c: Column | str) -> Column:
    """``Last, First Middle`` -> First (F-16)."""
    rest = field(F.get(F.split(field(c), ",", 2), F.lit(1)))
    return F.get(F.split(rest, r"\s+"), F.lit(0))


def percent(part: Column | str, whole: Column | str) -> Column:
    """part / whole * 100, 0 where the whole is 0 (F-35)."""
    return F.when(col(whole) > 0, col(part) / col(whole) * 100).otherwise(F.lit(0.0))


def header_value(line: Column | str, key: str) -> Column:
    """The value of a ``key: value`` line, null for other lines (F-30)."""
    text = field(line)
    return F.when(F.lower(text).startswith(key.lower() + ":"), field(F.get(F.split(text, ":"), F.lit(1))))


def maps_url(c: Column | str) -> Column:
    """A map search link with a trailing space, blank for blank addresses (F-13)."""
    query = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    return F.when(
        query != "", F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.url_encode(query), F.lit(" "))
    ).otherwise(F.lit(""))


def quoted(c: Column | str, delimiter: str = ",") -> Column:
    """A delimited field, in quotes where it has a delimiter, quote or line end (F-40)."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    special = f"[{'\\t' if delimiter == chr(9) else delimiter}\"\\r\\n]"
    return F.when(text.rlike(special), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
