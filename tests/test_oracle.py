"""Every query with SQL against DuckDB on the smallest driver tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ballotbook.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}" if not math.isnan(float(v)) else "nan"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    con = duck.execute(SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[k]) for k in order) for r in con.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
    assert mine or name in ("batch_total_violations", "singleton_groups")  # right batches add up, sites are large


def test_line_groups_equal_a_plain_loop(spark):
    frame = QUERIES["cvr_line_groups"](spark, SF)
    by: dict = {}
    for r in frame.collect():
        by.setdefault(r["file"], []).append((r["line_no"], r["line"], r["contest_no"], r["role"]))
    for rows in by.values():
        rows.sort()
        no = 0
        for k, (_, text, contest, role) in enumerate(rows):
            start = k + 1 < len(rows) and rows[k + 1][1].strip().lower().startswith("vote for:")
            no += start
            want = "header" if no == 0 else "contest" if start else "vote_for" if text.strip().lower().startswith("vote for:") else "selection"
            assert (contest, role) == (no, want)
