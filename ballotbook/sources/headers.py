"""Columns by header: first of equal headers wins, aliases are tried in order, missing ones are blank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field

# ---- Fixed values: aliases per role, in order of preference ----
ROLES = {
    "vuid": ["VUID", "VUIDNO"],
    "full_name": ["NAME", "FULL_NAME"],
    "last": ["LAST_NAME", "LSTNAM"],
    "first": ["FIRST_NAME", "FSTNAM"],
    "middle": ["MIDDLE_NAME", "MIDNAM"],
    "dob": ["DATE_OF_BIRTH", "DOB"],
    "freeform": ["RESIDENTIAL ADDRESS", "RESIDENTIAL_ADDRESS", "RES_ADDR", "RESIDENCE_ADDRESS", "ADDRESS"],
    "number": ["STREET NUMBER 1", "STREET_NUMBER_1", "STREET NUMBER", "STREET_NUMBER", "SITUS_NUM", "HOUSE_NUMBER", "ADDR_NUM"],
    "pre": ["PRE-DIRECTION", "PRE_DIRECTION", "PREDIRECTION", "STREET_PREFIX", "STRDIR"],
    "name1": ["STREET NAME 1", "STREET_NAME_1", "STREET NAME", "STREET_NAME", "STRNAM"],
    "name2": ["STREET NAME 2", "STREET_NAME_2"],
    "type": ["STREET TYPE", "STREET_TYPE", "STREET SUFFIX", "STREET_SUFFIX", "STRTYP"],
    "post": ["POST-DIRECTION", "POST_DIRECTION", "POSTDIRECTION"],
    "unit": ["UNIT", "UNIT NUMBER", "UNIT_NUMBER", "APT", "APARTMENT"],
    "unit_type": ["UNIT TYPE", "UNIT_TYPE"],
    "city": ["RESIDENT_CITY", "RESIDENCE_CITY", "RES_CITY", "CITY"],
    "zip": ["ZIP CODE 5", "ZIP_CODE_5", "RESIDENT_ZIP_CODE", "ZIP", "ZIPCODE", "ZIP_CODE", "RES_ZIP"],
    "zip4": ["ZIP CODE 4", "ZIP_CODE_4"],
    "precinct": ["PRECINCT", "PCTCOD"],
    "district": ["STATE SENATE"],
    "party": ["PARTY_CODE", "PARTYDECLARED"],
}
# ---- End of fixed values ----


def header_map(names: list[str]) -> dict[str, int]:
    """Upper-case header -> position of its first column (P-01)."""
    found: dict[str, int] = {}
    for k, name in enumerate(names):
        found.setdefault(name.strip().lstrip("﻿").upper(), k)
    return found


def resolve(found: dict[str, int], *aliases: str) -> int | None:
    """The first alias that exists (P-02)."""
    return next((found[a.upper()] for a in aliases if a.upper() in found), None)


def role_table(spark: SparkSession, names: list[str], roles: dict[str, list[str]] = ROLES) -> DataFrame:
    """(role, position) of the roles that a header has (P-01, P-02, P-04)."""
    found = header_map(names)
    rows = [(role, resolve(found, *aliases)) for role, aliases in roles.items()]
    return spark.createDataFrame([r for r in rows if r[1] is not None], "role string, position int")


def by_roles(df: DataFrame, roles: dict[str, list[str]] = ROLES, keep: list[str] = ["ord"]) -> DataFrame:
    """One trimmed text column per role, blank where the header has none (P-03, P-04). Columns are taken by
    position, so clashing headers do no harm."""
    plain = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    found = header_map(df.columns)
    kept = [F.col(f"_{df.columns.index(k)}").alias(k) for k in keep if k in df.columns]
    cols = []
    for role, aliases in roles.items():
        at = resolve(found, *aliases)
        cols.append((field(F.col(f"_{at}")) if at is not None else F.lit("")).alias(role))
    return plain.select(*kept, *cols)


def require(df: DataFrame, *roles: list[str]) -> None:
    """Raise where no alias of a required role exists (V-13)."""
    found = header_map(df.columns)
    missing = [r[0] for r in roles if resolve(found, *r) is None]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
