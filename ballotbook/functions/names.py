"""Display names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import field


def _joined(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])


def voter_name(full, last, first, middle) -> Column:
    """The full name, else ``last, first middle`` without blanks (F-14)."""
    given = _joined(" ", field(first), field(middle))
    return F.when(field(full) != "", field(full)).otherwise(_joined(", ", field(last), given))


def compose_name(full, prefix, first, middle, last, suffix, surname_first: bool = True) -> Column:
    """The full name, else ``Last, Prefix First Middle Suffix`` or the natural order (F-37)."""
    p, f, m, la, s = (field(x) for x in (prefix, first, middle, last, suffix))
    made = _joined(", ", la, _joined(" ", p, f, m, s)) if surname_first else _joined(" ", p, f, m, la, s)
    return F.when(field(full) != "", field(full)).otherwise(made)


def compose_address(full, number, predir, street, kind, postdir, unit_type, unit, city, state, zip5, zip4) -> Column:
    """The full address, else street parts, city and ``ST ZIP-4`` joined by commas (F-38)."""
    line = _joined(" ", *(field(x) for x in (number, predir, street, kind, postdir, unit_type, unit)))
    code = F.when((field(zip5) != "") & (field(zip4) != ""), F.concat_ws("-", field(zip5), field(zip4))).otherwise(field(zip5))
    return F.when(field(full) != "", field(full)).otherwise(
        _joined(", ", line, field(city), _joined(" ", field(state), code))
    )


def precinct_address(full, street, city, zip_code) -> Column:
    """The full address, else ``street, city, TX zip``, else ``Unknown`` (F-41)."""
    made = _joined(", ", field(street), field(city), F.when(field(zip_code) != "", F.concat(F.lit("TX "), field(zip_code))).otherwise(F.lit("")))
    return F.when(field(full) != "", field(full)).when((field(street) != "") | (field(city) != ""), made).otherwise(F.lit("Unknown"))
