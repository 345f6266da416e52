"""Election views over the driver's tables, and the same views as SQL.

Each view is a pair: a DataFrame of its columns and a SQL text with the same derivation. Only functions that mean
the same in both engines are used here; everything of substance is in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (voter's direction, name, type) and (property's prefix, street, suffix) of the invented streets.
STREETS = [
    (("N", "IH 35", ""), ("N", "INTERSTATE HY 35", "")),
    (("N", "FM 620", "RD"), ("N", "RANCH RD 620", "")),
    (("W", "WELLS BRANCH", "PKWY"), ("", "WELLS BRANCH", "PARKWAY")),
    (("", "MC NEIL", "DR"), ("", "MCNEIL", "DR")),
    (("E", "21ST", "ST"), ("E", "21", "ST")),
    (("W", "US 290", "HWY"), ("W", "U S HY 290", "")),
    (("", "BOB HARRISON", ""), ("", "BOB HARRISON", "ST")),
    (("", "NORTH PLZ", ""), ("", "NORTH", "PLAZA")),
    (("S", "LAMAR", "BLVD"), ("SOUTH", "LAMAR", "BOULEVARD")),
    (("", "MLK", "BLVD"), ("", "MARTIN LUTHER KING", "BLVD")),
    (("E", "RIVERSIDE", "DR"), ("", "NOWHERE", "LN")),
    (("", "CAPITAL OF TX", "HWY"), ("", "CAPITAL OF TEXAS", "HWY")),
]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _parts(side: int, part: int) -> list[str]:
    return [s[side][part] for s in STREETS]


# Expressions that both engines read alike; {pick} is filled per engine.
_REGISTRATION = """
SELECT CAST(c_custkey + {shift} AS BIGINT) AS ord, CAST(c_custkey AS VARCHAR(20)) AS vuid, {last} AS last,
  concat('F', CAST(c_custkey % 10 AS VARCHAR(9))) AS first, concat('M', CAST(c_nationkey % 3 AS VARCHAR(9))) AS middle,
  concat('1960-01-', lpad(CAST(1 + c_custkey % 7 AS VARCHAR(9)), 2, '0')) AS dob,
  CASE c_custkey % 4 WHEN 0 THEN 'REP' WHEN 1 THEN 'DEM' WHEN 2 THEN '' ELSE 'LIB' END AS party,
  CAST(c_nationkey AS VARCHAR(9)) AS precinct, CAST((n_regionkey + CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END) AS VARCHAR(9)) AS district,
  CAST(100 + c_custkey % 60 AS VARCHAR(9)) AS number, {pre} AS pre, {name} AS name1, {type} AS type,
  CASE WHEN c_custkey % 5 = 0 THEN concat('APT ', CAST({seven} % 4 AS VARCHAR(9))) ELSE '' END AS unit,
  CAST(78700 + {sixty} % 6 AS VARCHAR(9)) AS zip, CASE WHEN c_custkey % 37 = 0 THEN '*** ***' ELSE 'Austin' END AS city,
  CASE c_custkey % 3 WHEN 0 THEN concat(CAST(1 + c_custkey % 12 AS VARCHAR(9)), '/5/', CAST(2008 + c_custkey % 18 AS VARCHAR(9)))
    WHEN 1 THEN concat(CAST(2008 + c_custkey % 18 AS VARCHAR(9)), '0615') ELSE '' END AS edr,
  CAST(c_custkey AS BIGINT) AS ck
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {where}
"""
_ROSTER = """
SELECT CAST(o_orderkey AS BIGINT) AS ord, CAST(o_custkey AS VARCHAR(20)) AS vuid,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('X', c_mktsegment) WHEN o_orderkey % 13 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS last,
  concat('F', CAST(o_custkey % 10 AS VARCHAR(9))) AS first,
  CASE o_orderstatus WHEN 'F' THEN 'REP' WHEN 'O' THEN 'DEM' ELSE 'LIB' END AS party,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BBM' WHEN '2' THEN 'EV' WHEN '3' THEN 'ED' WHEN '4' THEN 'PROV' ELSE 'LTD' END AS ballot_type,
  concat(CAST(month(o_orderdate) AS VARCHAR(9)), '/', CAST(day(o_orderdate) AS VARCHAR(9)), '/', CAST(year(o_orderdate) AS VARCHAR(9))) AS vote_date,
  CAST(c_nationkey AS VARCHAR(9)) AS precinct, year(o_orderdate) AS y
FROM orders JOIN customer ON o_custkey = c_custkey
"""
_CHECKINS = """
SELECT CAST(event_id AS BIGINT) AS ord, CAST(user_id AS VARCHAR(20)) AS vuid, event_type AS location,
  CAST(user_id % 25 AS VARCHAR(9)) AS precinct, CASE event_id % 2 WHEN 0 THEN 'REP' ELSE 'DEM' END AS party,
  CASE WHEN event_id % 13 = 0 THEN 'Y' WHEN event_id % 13 = 1 THEN '' WHEN event_id % 13 = 2 THEN 'N' ELSE 'n' END AS flag,
  CASE event_id % 3 WHEN 0 THEN 'ED00123' WHEN 1 THEN 'ev00001' ELSE 'xx' END AS code,
  concat(CAST(month(ts) AS VARCHAR(9)), '/', CAST(day(ts) AS VARCHAR(9)), '/', CAST(year(ts) AS VARCHAR(9))) AS vote_date
FROM events
"""
_SELECTIONS = """
SELECT CAST(l_orderkey AS BIGINT) AS ballot,
  CAST(l_linenumber AS BIGINT) * 1000000000000 + CAST(l_partkey AS BIGINT) * 1000000 + CAST(l_suppkey AS BIGINT) * 100 + CAST(l_quantity AS BIGINT) AS ord,
  concat('C', CAST(l_partkey % 8 AS VARCHAR(9))) AS contest, CAST(1 + l_partkey % 8 % 3 AS BIGINT) AS vote_for,
  concat('S', CAST(l_suppkey % 5 AS VARCHAR(9))) AS selection,
  CASE l_returnflag WHEN 'A' THEN 'Counted' WHEN 'N' THEN 'Overvoted' ELSE CASE WHEN l_linenumber = 6 THEN 'Smudged' ELSE 'Undervoted' END END AS status,
  CASE l_suppkey % 3 WHEN 0 THEN concat('DS200-', CAST(l_suppkey % 10 AS VARCHAR(9))) WHEN 1 THEN concat('ExpressTouch-', CAST(l_suppkey % 10 AS VARCHAR(9))) ELSE concat('C', CAST(l_suppkey % 10 AS VARCHAR(9))) END AS machine,
  concat('P', CAST(l_partkey % 20 AS VARCHAR(9))) AS place, l_orderkey % 4 = 0 AS barcoded
FROM lineitem
"""
_STYLES = "SELECT CAST(p_partkey AS BIGINT) AS ord, p_brand AS style, CAST(p_size AS BIGINT) AS barcode, p_type AS contest, p_name AS selection FROM part"
_DETAIL = """
SELECT l_orderkey % 16 AS file,
  CAST(l_orderkey AS BIGINT) AS k1, CAST(l_linenumber AS BIGINT) AS k2, CAST(l_partkey AS BIGINT) AS k3, CAST(l_suppkey AS BIGINT) AS k4,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS k5, CAST(l_quantity AS BIGINT) AS k6,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS seq_text, CAST(l_linenumber AS BIGINT) AS seq,
  concat('C', CAST(l_partkey % 8 AS VARCHAR(9))) AS contest, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 40 AS BIGINT) END AS row_no,
  CASE WHEN l_suppkey % 9 = 0 AND l_partkey % 2 = 0 THEN NULL ELSE CAST(l_suppkey % 10 AS BIGINT) END AS col_no
FROM lineitem
"""
_PROPERTIES = """
SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(p_partkey AS VARCHAR(20)) AS prop_id, CAST(100 + p_partkey % 60 AS VARCHAR(9)) AS number,
  {pre} AS prefix, {name} AS street, {type} AS suffix, CASE WHEN p_partkey % 5 = 0 THEN concat('# ', CAST({seven} % 4 AS VARCHAR(9))) ELSE '' END AS unit,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'AUSTIN' END AS city, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(78700 + {sixty} % 6 AS VARCHAR(9)) END AS zip,
  CASE WHEN p_partkey % 11 = 0 THEN 'Small Motel' WHEN p_partkey % 17 = 0 THEN '' ELSE p_type END AS type_desc,
  CASE p_partkey % 5 WHEN 0 THEN 'A1;C1' WHEN 1 THEN 'F1' WHEN 2 THEN '' WHEN 3 THEN ' c1 ; f1' ELSE 'M1' END AS state_codes,
  CASE WHEN p_partkey % 12 < 6 THEN concat('PO BOX 1, ', CAST(100 + p_partkey % 60 AS VARCHAR(9)), ' ', {pre}, ' ', {name}, ' ', {type}) ELSE '' END AS owner_line,
  'PFLUGERVILLE' AS owner_city
FROM part
"""
_IMPROVEMENTS = """
SELECT CAST(l_partkey AS VARCHAR(20)) AS prop_id, CAST(l_orderkey AS BIGINT) * 10 + CAST(l_linenumber AS BIGINT) AS ord,
  CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag END AS type_cd, CASE WHEN l_linenumber = 7 THEN '' ELSE concat('D', CAST(l_suppkey % 4 AS VARCHAR(9))) END AS type_desc,
  l_linestatus AS state_cd
FROM lineitem
"""
_LINES = "SELECT doc_id AS file, text FROM documents"


def _fill(text: str, engine: str) -> dict[str, str]:
    """The SQL of the views for one engine: list picks and whole-number division differ."""
    spark = engine == "spark"

    def pick(side: int, part: int, key: str) -> str:
        values = _parts(side, part)
        return f"element_at({_array(values)}, CAST({key} % 12 + 1 AS INT))" if spark else f"{_list(values)}[CAST({key} % 12 + 1 AS INTEGER)]"

    div = (lambda k, n: f"({k} div {n})") if spark else (lambda k, n: f"({k} // {n})")
    out = {"pre": None, "name": None, "type": None}
    key, side = ("p_partkey", 1) if "p_partkey" in text else ("c_custkey", 0)
    for n, k in enumerate(out):
        out[k] = pick(side, n, key)
    return out | {"seven": div(key, 7), "sixty": div(key, 60)}


def _views(engine: str) -> dict[str, str]:
    reg = lambda where, shift="0", last="c_mktsegment": _REGISTRATION.format(
        where=where, shift=shift, last=last, **_fill("c_custkey", engine)
    )
    moved = reg("c_custkey % 8 <> 1").replace(
        "CAST(c_nationkey AS VARCHAR(9)) AS precinct", "CAST((c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) % 25 AS VARCHAR(9)) AS precinct"
    )
    return {
        "registration": f"{reg('c_custkey % 10 <> 0')} UNION ALL {reg('c_custkey % 9 = 0', '10000000', chr(39) + 'LATER' + chr(39))}",
        "registration2": reg("c_custkey % 4 <> 1", "20000000", "concat(c_mktsegment, '-2')"),
        "registration_new": moved,
        "roster": _ROSTER,
        "primary_roster": f"SELECT * FROM ({_ROSTER}) r WHERE y < 1996",
        "checkins": _CHECKINS,
        "selections": _SELECTIONS,
        "styles": _STYLES,
        "detail": _DETAIL,
        "properties": _PROPERTIES.format(**_fill("p_partkey", engine)),
        "improvements": _IMPROVEMENTS,
    }


class Tables:
    """The views over one folder; each source table is read with the columns that a view asks for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, view: str) -> DataFrame:
        text = _views("spark")[view]
        names = ["customer", "nation", "orders", "events", "lineitem", "part"]
        return self.spark.sql(_with_sources(text, names), **{n: self.source(n) for n in names if f" {n}" in text})

    def lines(self) -> DataFrame:
        """(file, line_no, line) of documents."""
        return self.source("documents").select(
            F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")
        )


def _with_sources(text: str, names: list[str]) -> str:
    import re

    for n in names:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return text


def with_views(sql: str) -> str:
    """A DuckDB query with the views it names as common table expressions."""
    import re

    views = _views("duckdb")
    used = [v for v in views if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    body = sql.strip()
    parts = ", ".join(f"{v} AS ({views[v].strip()})" for v in used)
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
