"""The interactive list: roles of columns, sorted views, paging and delimited copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import compose_address, compose_name
from ..functions.text import quoted, zip_split
from .dedup import number_rows

# ---- Fixed values: header names per role, letters and digits only ----
ROLES = {
    "vuid": ["VUID", "VUIDNO", "SOSVOTERID", "BARCODEVUID", "SOSVOTERIDNUMBER"],
    "other_id": ["ID", "IDNUMBER", "LEGACYVOTERID", "COUNTYID"],
    "full_name": ["NAME", "FULLNAME", "FULLNAM", "CONTACTNAME", "VOTERNAME"],
    "prefix": ["NAMPFX", "NAMEPREFIX", "PREFIX"],
    "first": ["FSTNAM", "FIRSTNAME", "FIRST", "FNAME", "GIVENNAME"],
    "middle": ["MIDNAM", "MIDDLENAME", "MIDDLE", "MNAME"],
    "last": ["LSTNAM", "LASTNAME", "LAST", "LNAME", "SURNAME"],
    "suffix": ["NAMESUFFIX", "NAMESUFFIXCODE", "SUFFIX", "NSUFFIX"],
    "full_address": ["ADDRESS", "FULLADDRESS", "RESADDRESS", "STREETADDRESS", "RESIDENTIALADDRESS"],
    "number": ["BLKNUM", "BLOCKNUM", "HOUSENUM", "HOUSENUMBER", "HOUSENO", "HSENO", "STREETNUMBER", "STREETNUM", "STREETNO", "STRNUM"],
    "predir": ["STRPRE", "STRPREFIX", "PREDIR", "PREDIRECTION", "STREETPREFIX"],
    "street": ["STRNAM", "STRNAME", "STREETNAME", "STREETNAM", "STREET"],
    "kind": ["STRTYP", "STRTYPE", "STREETTYPE", "STREETTYP"],
    "direction": ["STRDIR", "STREETDIR"],
    "postdir": ["POSTDIR", "POSTDIRECTION", "STRPOST"],
    "unit_type": ["UNITYP", "UNITTYPE", "APTTYPE"],
    "unit": ["UNITNO", "UNITNUM", "UNITNUMBER", "APTNO", "APTNUM", "APARTMENT"],
    "city": ["RSCITY", "RESCITY", "RESIDENCECITY", "CITY"],
    "state": ["RSTATE", "RESSTATE", "RESIDENCESTATE", "STATE"],
    "zip": ["RZIPCD", "RZIP", "RESZIP", "ZIPCODE", "ZIPCD", "ZIP"],
    "zip4": ["RZIP4", "ZIP4", "PLUS4"],
}
# ---- End of fixed values ----
_ROLE_OF = {name: role for role, names in ROLES.items() for name in names}
MOST_COLUMNS = 1024


def header_key(name: str) -> str:
    """Letters A-Z and digits of a header, upper case (F-36)."""
    return "".join(c for c in name.upper() if c.isascii() and c.isalnum())


def roles(headers: list[str]) -> dict[str, str]:
    """Role -> the first header that has it (P-05). Without a voter id another id stands in; an unplaced direction
    goes before the street, or after it where a column before it exists."""
    found: dict[str, str] = {}
    for h in headers:
        role = _ROLE_OF.get(header_key(h))
        if role and role not in found:
            found[role] = h
    if "vuid" not in found and "other_id" in found:
        found["vuid"] = found["other_id"]
    if "direction" in found:
        found.setdefault("postdir" if "predir" in found else "predir", found["direction"])
    return found


def display(df: DataFrame, surname_first: bool = True) -> DataFrame:
    """The columns Voter ID, Name and Address before those of the source; more than 1,024 columns raise (D23, V-15)."""
    if len(df.columns) + 3 > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    r = roles(df.columns)
    get = lambda k: F.col(f"`{r[k]}`") if k in r else F.lit("")
    five, four = zip_split(get("zip"), get("zip4"))
    name = compose_name(*(get(k) for k in ("full_name", "prefix", "first", "middle", "last", "suffix")), surname_first=surname_first)
    address = compose_address(
        *(get(k) for k in ("full_address", "number", "predir", "street", "kind", "postdir", "unit_type", "unit", "city", "state")), five, four
    )
    return df.select(get("vuid").alias("Voter ID"), name.alias("Name"), address.alias("Address"), *[F.col(f"`{c}`") for c in df.columns])


def sorted_view(df: DataFrame, column: str, descending: bool = False, row_id: str = "row_id") -> DataFrame:
    """Rows by a column without regard to case; ties by row id upwards in both directions (O-01)."""
    key = F.lower(F.col(column).cast("string"))
    return df.orderBy(key.desc() if descending else key.asc(), F.col(row_id).asc())


def numbered_view(df: DataFrame, column: str, descending: bool = False, row_id: str = "row_id") -> DataFrame:
    """The rows with their ``position`` in the sorted view, from 1."""
    keyed = df.withColumn("__key", F.lower(F.col(column).cast("string")))
    return number_rows(keyed, ["__key", row_id], ("__key",) if descending else ()).withColumnRenamed("number", "position").drop("__key")


def numeric_order(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """The rows with their ``position`` by a column: whole numbers by value, then other texts by letters (O-03)."""
    number = F.col(column).try_cast("bigint")
    keyed = df.withColumn("__text", number.isNull().cast("int")).withColumn("__number", number)
    return number_rows(keyed, ["__text", "__number", column, row_id]).withColumnRenamed("number", "position").drop("__text", "__number")


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` values with the most rows, ties by value (O-07)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def page(df: DataFrame, offset: int, size: int) -> DataFrame:
    """A stretch of a sorted view."""
    return df.offset(offset).limit(size)


def copy_text(df: DataFrame, columns: list[str], delimiter: str = ",") -> Column:
    """One delimited line per row, quoted where needed (K-15)."""
    return F.concat_ws(delimiter, *[quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), delimiter) for c in columns])
