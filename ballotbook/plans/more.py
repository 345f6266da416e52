"""Queries of the single expressions, checks, orders, readers and writers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import history as H
from ..functions import names as N
from ..functions import text as T
from ..operators import checks, compare, dedup, ordered, places, property, sets, tally, viewer
from ..sources import files, headers, reports, sinks
from ..sources.scratch import new_folder
from .adapters import Tables
from .catalog import query
from .sql_text import street_sql

# ---- expressions ----


@query("SELECT ord, CASE WHEN ck % 4 = 0 THEN 'Full Name ' || ck ELSE concat_ws(', ', last, concat_ws(' ', first, nullif(CASE WHEN ck % 3 = 0 THEN '' ELSE middle END, ''))) END AS name FROM registration")
def voter_names(t: Tables) -> DataFrame:
    full = F.when(F.col("ck") % 4 == 0, F.concat(F.lit("  Full Name "), F.col("ck").cast("string"))).otherwise(F.lit(""))
    middle = F.when(F.col("ck") % 3 == 0, F.lit(" ")).otherwise(F.col("middle"))
    return t.registration.select("ord", N.voter_name(full, F.col("last"), F.col("first"), middle).alias("name"))


@query("SELECT ord, last, first, CASE WHEN ck % 2 = 0 THEN 'one' ELSE '' END AS rest FROM registration")
def combined_names(t: Tables) -> DataFrame:
    rows = t.registration.withColumn("name", F.concat(F.lit(" "), F.col("last"), F.lit(" ,  "), F.col("first"), F.lit(" "), F.col("middle"), F.lit(", Jr")))
    alone = F.when(F.col("ck") % 2 == 0, F.lit("x, one")).otherwise(F.lit("no comma"))
    return rows.select("ord", T.last_of_combined("name").alias("last"), T.first_of_combined("name").alias("first"), T.first_of_combined(alone).alias("rest"))


@query("SELECT ord, vote_date AS day, CASE WHEN ord % 3 = 0 THEN '' ELSE '10:' || CAST(10 + ord % 50 AS VARCHAR) END AS clock FROM checkins")
def checkin_date_parts(t: Tables) -> DataFrame:
    clock = F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("   10:"), (10 + F.col("ord") % 50).cast("string"), F.lit(" AM")))
    return t.checkins.withColumn("at", F.concat(F.lit(" "), F.col("vote_date"), clock)).select("ord", T.date_part("at").alias("day"), T.time_part("at").alias("clock"))


@query("SELECT ord, precinct FROM registration")
def clean_precincts(t: Tables) -> DataFrame:
    prefix = F.when(F.col("ck") % 3 == 0, F.lit("P Z")).when(F.col("ck") % 3 == 1, F.lit("P ")).otherwise(F.lit(" "))
    return t.registration.select("ord", T.clean_precinct(F.concat(prefix, F.col("precinct"))).alias("precinct"))


@query("SELECT ord, CASE WHEN ord % 4 = 3 THEN '' ELSE ['D', 'R', 'DZ', 'RZ'][CAST(ord % 4 + 1 AS INTEGER)] END AS ballot_type, CASE WHEN ord % 4 = 3 THEN '' ELSE CAST(ord AS VARCHAR) END AS style FROM styles")
def style_texts(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("d ", "R", "dz ", "no type ")]), (F.col("ord") % 4 + 1).cast("int"))
    parts = H.style_text_parts(F.concat(F.lit("Ballot Style "), kind, F.col("ord").cast("string"), F.lit(" of the county")))
    return t.styles.select("ord", *[c.alias(n) for n, c in parts.items()])


@query("SELECT ord, CASE WHEN ord % 2 = 0 THEN 'deck-' || style ELSE '' END AS stem, CASE WHEN ord % 2 = 0 THEN CAST(barcode AS INTEGER) END AS page FROM styles")
def page_names(t: Tables) -> DataFrame:
    name = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("deck-"), F.col("style"), F.lit("-"), F.col("barcode").cast("string"), F.lit(".pdf"))).otherwise(F.lit("deck.pdf"))
    return t.styles.select("ord", *[c.alias(n) for n, c in H.page_name_parts(name).items()])


@query("SELECT ord, CASE WHEN ck % 3 = 0 THEN 'Full 1' WHEN ck % 3 = 1 THEN concat_ws(', ', nullif(name1, ''), city, 'TX ' || zip) ELSE 'Unknown' END AS address FROM registration")
def precinct_address_texts(t: Tables) -> DataFrame:
    some = lambda c: F.when(F.col("ck") % 3 == 1, F.col(c)).otherwise(F.lit(""))
    full = F.when(F.col("ck") % 3 == 0, F.lit(" Full 1 ")).otherwise(F.lit(""))
    return t.registration.select("ord", N.precinct_address(full, some("name1"), some("city"), some("zip")).alias("address"))


_UNIT = "CASE WHEN unit = '' THEN NULL ELSE substr(unit, 5) END"


@query(
    f"""WITH a AS (SELECT ord, number, {street_sql("concat_ws(' ', pre, name1, type)")} AS st, {_UNIT} AS u, zip FROM registration)
SELECT ord, concat_ws(' ', number, st, u, zip) AS key, concat_ws(' ', number, st) AS short FROM a"""
)
def address_keys(t: Tables) -> DataFrame:
    street, text = F.concat_ws(" ", "pre", "name1", "type"), F.concat(F.lit(" "), F.col("number"))
    return t.registration.select(
        "ord", A.address_key(text, street, F.col("unit"), F.col("zip")).alias("key"), A.address_key(text, street).alias("short")
    )


@query(f"SELECT ord, concat_ws(' ', number, nullif(name1, ''), CASE WHEN unit <> '' THEN 'UNIT ' || substr(unit, 5) END, city, zip) AS address FROM registration")
def address_displays(t: Tables) -> DataFrame:
    return t.registration.select("ord", A.display(F.col("number"), F.col("name1"), A.unit("unit"), F.col("city"), F.col("zip")).alias("address"))


@query("SELECT ord, CASE WHEN ck % 5 = 0 THEN '' ELSE vuid END AS plain, CASE WHEN ck % 5 IN (0, 1) THEN '' ELSE vuid END AS filled FROM registration")
def blank_fields(t: Tables) -> DataFrame:
    raw = F.when(F.col("ck") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" \t"), F.col("vuid"), F.lit("\n ")))
    sheet = F.when(F.col("ck") % 5 == 1, F.lit(" NaN")).otherwise(raw)
    return t.registration.select("ord", T.field(raw).alias("plain"), T.nan_to_empty(sheet).alias("filled"))


@query(
    """SELECT ord, CAST(sign(date_diff('day', DATE '2015-06-15', coalesce(try_strptime(edr, '%m/%d/%Y'), try_strptime(edr, '%Y%m%d')))) AS INTEGER) AS cmp FROM registration"""
)
def date_outcomes(t: Tables) -> DataFrame:
    return t.registration.select("ord", T.compare_dates("edr", F.lit("6/15/2015")).alias("cmp"))


# ---- headers and roles ----


@query("SELECT * FROM (VALUES ('vuid', 0), ('last', 1), ('zip', 4), ('precinct', 5)) x(role, position)")
def header_roles(t: Tables) -> DataFrame:
    """The first of clashing headers, aliases in order of preference."""
    names = ["﻿VuidNo", "LSTNAM", "VUIDNO", "zip", "ZIP CODE 5", "Precinct", "precinct"]
    return headers.role_table(t.spark, names)


@query("SELECT * FROM (VALUES ('vuid', 'SOS_VoterID'), ('first', 'First Name'), ('last', 'LSTNAM'), ('predir', 'Str.Dir'), ('zip4', 'RZIP+4'), ('other_id', 'id number'), ('direction', 'Str.Dir')) x(role, header)")
def viewer_roles(t: Tables) -> DataFrame:
    names = ["id number", "SOS_VoterID", "First Name", "LSTNAM", "Str.Dir", "RZIP+4", "Comments"]
    return t.spark.createDataFrame(list(viewer.roles(names).items()), "role string, header string")


@query("SELECT * FROM (VALUES ('DOB'), ('PARTY_CODE')) x(name)")
def missing_columns(t: Tables) -> DataFrame:
    return checks.required_columns(t.registration.drop("dob"), ["vuid", "LAST", "DOB", "PARTY_CODE"])


@query("SELECT * FROM (VALUES (1, '2026-03-03'), (2, '2024-03-05'), (3, '2022-03-01'), (4, '2020-03-03'), (5, '2018-03-06'), (6, '2016-03-01'), (7, '2014-03-04'), (8, '2012-05-29')) x(position, day)")
def primary_calendar(t: Tables) -> DataFrame:
    return H.calendar(t.spark)


# ---- orders, counters and reports ----


@query("SELECT ord, row_number() OVER (ORDER BY try_cast(v AS BIGINT) NULLS LAST, v, ord) AS position FROM (SELECT ord, CASE WHEN ck % 5 = 0 THEN 'A' || vuid WHEN ck % 7 = 0 THEN '' ELSE vuid END AS v FROM registration)")
def numeric_order(t: Tables) -> DataFrame:
    value = F.when(F.col("ck") % 5 == 0, F.concat(F.lit("A"), F.col("vuid"))).when(F.col("ck") % 7 == 0, F.lit("")).otherwise(F.col("vuid"))
    return viewer.numeric_order(t.registration.select("ord", value.alias("v")), "v", "ord").select("ord", "position")


@query("SELECT ord, row_number() OVER (ORDER BY lower(last), lower(first), ord) AS position FROM roster")
def name_order(t: Tables) -> DataFrame:
    rows = t.roster.select("ord", T.fold("last").alias("l"), T.fold("first").alias("f"))
    return dedup.number_rows(rows, ["l", "f", "ord"]).select("ord", F.col("number").alias("position"))


@query("SELECT ord, row_number() OVER (ORDER BY vuid, ord) AS position FROM roster")
def id_string_order(t: Tables) -> DataFrame:
    return dedup.number_rows(t.roster.select("ord", "vuid"), ["vuid", "ord"]).select("ord", F.col("number").alias("position"))


@query("SELECT type_cd, type_desc, state_cd, n, row_number() OVER (ORDER BY n DESC, type_cd, type_desc, state_cd) AS position FROM (SELECT type_cd, type_desc, state_cd, count(*) AS n FROM (SELECT DISTINCT prop_id, type_cd, type_desc, state_cd FROM improvements) GROUP BY ALL)")
def improvement_types_ranked(t: Tables) -> DataFrame:
    keys = ["n", "type_cd", "type_desc", "state_cd"]
    return dedup.number_rows(property.type_counts(t.improvements), keys, ("n",)).withColumnRenamed("number", "position")


@query("SELECT last, count(*) AS n FROM roster GROUP BY last ORDER BY n DESC, last LIMIT 5")
def most_common_names(t: Tables) -> DataFrame:
    return viewer.most_common(t.roster, "last", 5)


@query("SELECT ord, last FROM registration ORDER BY lower(last), ord LIMIT 25 OFFSET 10")
def viewer_page(t: Tables) -> DataFrame:
    rows = t.registration.select("ord", "last").withColumn("row_id", F.col("ord"))
    return viewer.page(viewer.sorted_view(rows, "last"), 10, 25).select("ord", "last")


@query(
    """SELECT count(*) AS n_rows, count(*) FILTER (party = '') AS n_blank_keys, count(DISTINCT nullif(party, '')) AS n_keys,
count(*) FILTER (party <> '') - count(DISTINCT nullif(party, '')) AS n_duplicates, count(*) FILTER (edr <> '') AS n_filled, count(*) FILTER (edr = '') AS n_empty FROM registration"""
)
def run_counters(t: Tables) -> DataFrame:
    return dedup.counters(t.registration, "party", "edr")


@query("SELECT ord, vuid, party FROM registration WHERE party <> ''")
def filled_keys(t: Tables) -> DataFrame:
    return dedup.with_key(t.registration.select("ord", "vuid", F.concat(F.lit(" "), F.col("party")).alias("p"), "party"), "p").drop("p")


@query(
    """SELECT 'ballot type' AS section, ballot_type AS label, count(*) AS n FROM roster GROUP BY ballot_type
UNION ALL SELECT 'party', party, count(*) FROM roster GROUP BY party UNION ALL SELECT 'total', 'rows', count(*) FROM roster"""
)
def roster_report(t: Tables) -> DataFrame:
    return compare.report(t.roster, {"ballot type": "ballot_type", "party": "party"})


_MOVED = """w AS (SELECT upper(number || ' ' || name1) AS key, arg_min(precinct, ord) AS new_precinct FROM registration_new WHERE precinct <> '' GROUP BY 1),
m AS (SELECT r.precinct AS old_precinct, new_precinct, count(*) AS n FROM registration r LEFT JOIN w ON upper(r.number || ' ' || r.name1) = w.key WHERE r.precinct <> '' GROUP BY ALL)"""


def _moved(t: Tables) -> DataFrame:
    address = F.concat_ws(" ", "number", "name1").alias("address")
    return places.migration(t.registration.select("ord", "precinct", address), t.registration_new.select("ord", "precinct", address))


@query(f"WITH {_MOVED} SELECT old_precinct, new_precinct, n, row_number() OVER (PARTITION BY old_precinct ORDER BY n DESC, new_precinct NULLS LAST) AS place FROM m")
def destinations_ranked(t: Tables) -> DataFrame:
    return places.ranked_destinations(_moved(t))


@query(f"WITH {_MOVED} SELECT old_precinct, new_precinct, printf('%.1f%%', round_even(n / sum(n) OVER (PARTITION BY old_precinct) * 100, 1)) AS cell FROM m QUALIFY new_precinct IS NOT NULL")
def migration_cells(t: Tables) -> DataFrame:
    return places.migration_cells(_moved(t))


# ---- lists ----


@query(
    """SELECT vuid, precinct, name1 AS address FROM (SELECT * FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1)
WHERE party = 'REP' UNION ALL SELECT vuid, arg_min(precinct, ord), '' FROM roster WHERE vuid NOT IN (SELECT vuid FROM registration) GROUP BY vuid"""
)
def partitions_with_unknown(t: Tables) -> DataFrame:
    known = dedup.first_wins(t.registration.select("vuid", "ord", "precinct", "party", F.col("name1").alias("address")), ["vuid"]).filter("party = 'REP'")
    unknown = dedup.first_wins(compare.unknown_voters(t.roster.select("ord", "vuid", "precinct"), t.registration), ["vuid"])
    return sets.with_unknown(known.select("vuid", "precinct", "address"), unknown)


@query("SELECT DISTINCT vuid FROM registration WHERE vuid NOT IN (SELECT vuid FROM roster WHERE ballot_type = 'EV')")
def voters_without_ballots(t: Tables) -> DataFrame:
    return sets.unused(t.registration, t.roster.filter("ballot_type = 'EV'"), "vuid")


@query(
    """WITH s AS (SELECT CAST(ord // 3 AS VARCHAR) AS location, party, precinct, CASE WHEN upper(substr(code, 1, 2)) IN ('ED', 'EV') THEN upper(substr(code, 1, 2)) ELSE '' END AS period FROM checkins)
SELECT location, period, count(*) AS n_singletons FROM (SELECT location, period FROM s GROUP BY location, party, precinct, period HAVING count(*) = 1) GROUP BY ALL"""
)
def singleton_voters(t: Tables) -> DataFrame:
    return places.singletons(places.with_period(t.checkins).withColumn("location", F.expr("cast(ord div 3 as string)")))


@query(
    """WITH f AS (SELECT prop_id, type_cd, type_desc, state_cd, min(ord) AS o FROM improvements WHERE NOT (type_cd = '' AND type_desc = '') GROUP BY ALL),
g AS (SELECT prop_id, list(type_cd ORDER BY o) AS a, list(type_desc ORDER BY o) AS b FROM f GROUP BY prop_id),
u AS (SELECT prop_id, list_reduce(a, lambda x, y: CASE WHEN list_contains(string_split(x, ';'), y) THEN x ELSE x || ';' || y END) AS type_cd,
list_reduce(b, lambda x, y: CASE WHEN list_contains(string_split(x, ';'), y) THEN x ELSE x || ';' || y END) AS type_desc FROM g)
SELECT p.prop_id, u.type_cd, u.type_desc FROM properties p LEFT JOIN u USING (prop_id)"""
)
def property_improvements(t: Tables) -> DataFrame:
    return property.with_improvements(t.properties.select("prop_id"), t.improvements).select("prop_id", "type_cd", "type_desc")


# ---- checks ----


@query("SELECT ballot, ord FROM selections WHERE status = 'Smudged'")
def status_parentheses(t: Tables) -> DataFrame:
    text = F.when(F.col("status") == "Smudged", F.lit("Counted (sic)")).otherwise(F.col("status"))
    return checks.status_text(t.selections.withColumn("status", text)).select("ballot", "ord")


@query("SELECT ballot, count(*) FILTER (status = 'Counted') AS n_counted FROM selections GROUP BY ballot")
def counted_per_ballot(t: Tables) -> DataFrame:
    one = t.selections.groupBy("ballot", "contest").agg(F.collect_list(F.struct("selection", "status")).alias("selections"))
    nested = one.groupBy("ballot").agg(F.collect_list(F.struct("contest", "selections")).alias("contests"))
    return tally.counted_per_ballot(nested).select("ballot", F.col("n_counted").cast("long").alias("n_counted"))


_CODES = """b AS (SELECT CAST(l_orderkey AS BIGINT) AS ballot, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'A') AS n_counted FROM lineitem GROUP BY 1)"""


def _coded(t: Tables) -> DataFrame:
    each = t.source("lineitem").groupBy(F.col("l_orderkey").cast("long").alias("ballot")).agg(
        F.collect_list(F.lit(10101)).alias("barcodes"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("n_counted")
    )
    size = F.when(F.col("ballot") % 3 == 0, 28).otherwise(27)
    return each.withColumn("style_code", F.when(F.col("ballot") % 5 != 0, F.lpad(F.col("ballot").cast("string"), 28, "0").substr(F.lit(1), size)))


@query(f"WITH {_CODES} SELECT ballot FROM b WHERE n_lines <> n_counted")
def barcode_count_violations(t: Tables) -> DataFrame:
    return checks.barcode_counts(_coded(t)).select("ballot")


@query(f"WITH {_CODES} SELECT ballot FROM b WHERE ballot % 5 = 0 OR ballot % 3 <> 0")
def style_code_violations(t: Tables) -> DataFrame:
    return checks.style_codes(_coded(t)).select("ballot")


@query("SELECT CAST(o_orderkey AS BIGINT) AS ballot FROM orders WHERE o_orderkey % 5 IN (1, 4)")
def barcode_length_violations(t: Tables) -> DataFrame:
    size = F.element_at(F.array(*[F.lit(n) for n in (28, 27, 8, 6, 7)]), (F.col("ballot") % 5 + 1).cast("int"))
    codes = t.source("orders").select(F.col("o_orderkey").cast("long").alias("ballot")).withColumn("code", F.expr("repeat('7', 28)").substr(F.lit(1), size))
    return checks.barcode_lengths(codes).select("ballot")


@query("SELECT CAST(o_orderkey AS BIGINT) AS file, lpad(CAST(o_orderkey AS VARCHAR), 28, '0') AS style_code, CASE WHEN o_orderkey % 2 = 0 THEN '12345678' END AS header_code, '300003,200002' AS barcodes FROM orders")
def routed_codes(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    codes = F.array(F.lit("200002"), F.lpad(key.cast("string"), 28, "0"), F.when(key % 2 == 0, F.lit("12345678")).otherwise(F.lit("123")), F.lit("300003"))
    rows = t.source("orders").select(key.cast("long").alias("file"), F.posexplode(codes).alias("ord", "code"))
    return files.routed_barcodes(rows).withColumn("barcodes", F.array_join("barcodes", ","))


@query("SELECT * FROM (VALUES ('b.xlsx')) x(file)")
def header_label_violations(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([("a.xlsx", [" VUID", "precinct", "Note"]), ("b.xlsx", ["VUID", "Name"])], "file string, labels array<string>")
    return checks.header_labels(rows, ["Vuid", "Precinct"]).select("file")


@query("SELECT location AS file, count(DISTINCT precinct) AS n FROM checkins GROUP BY 1 HAVING count(DISTINCT precinct) <> 2")
def sheet_count_violations(t: Tables) -> DataFrame:
    return checks.sheet_counts(t.checkins.select(F.col("location").alias("file"), F.col("precinct").alias("sheet")), 2)


_NAMES = """f AS (SELECT CAST(o_orderkey AS BIGINT) AS ord, CASE o_orderkey % 3 WHEN 0 THEN '03.04.2026' WHEN 1 THEN '3.4' ELSE '12.31.2025' END AS day,
['Mail ballots', 'EARLY voting', 'Provisional early', 'limited mail', 'Election Day'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS words FROM orders)"""


def _named_files(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.when(key % 3 == 0, F.lit("03.04.2026")).when(key % 3 == 1, F.lit("3.4")).otherwise(F.lit("12.31.2025"))
    words = F.element_at(F.array(*[F.lit(w) for w in ("Mail ballots", "EARLY voting", "Provisional early", "limited mail", "Election Day")]), (key % 5 + 1).cast("int"))
    return t.source("orders").select(key.cast("long").alias("ord"), F.concat_ws(" ", day, words).alias("name"))


@query(
    f"""WITH {_NAMES} SELECT ord, CASE WHEN words ILIKE '%provisional%' THEN 'PROV' WHEN words ILIKE '%limited%' THEN 'LTD' WHEN words ILIKE '%mail%' THEN 'BBM'
WHEN words ILIKE '%early%' THEN 'EV' ELSE 'ED' END AS ballot_type, CASE WHEN day <> '3.4' THEN replace(day, '.', '/') END AS vote_date FROM f"""
)
def roster_file_names(t: Tables) -> DataFrame:
    return _named_files(t).select("ord", *[c.alias(n) for n, c in files.roster_name_parts(F.col("name")).items()])


@query(f"WITH {_NAMES} SELECT ord FROM f WHERE day = '3.4'")
def file_date_violations(t: Tables) -> DataFrame:
    return checks.file_dates(_named_files(t)).select("ord")


@query("SELECT precinct, arg_min(district, ord) AS district, count(DISTINCT district) AS n_values FROM registration WHERE precinct <> '' AND district <> '' GROUP BY precinct HAVING count(DISTINCT district) > 1")
def district_conflicts(t: Tables) -> DataFrame:
    return checks.district_conflicts(places.precinct_districts(t.registration))


@query("SELECT ord FROM registration WHERE ck % 7 = 0")
def history_letter_violations(t: Tables) -> DataFrame:
    text = F.when(F.col("ck") % 7 == 0, F.lit("RDX_")).when(F.col("ck") % 7 == 1, F.lit("rd_~zz")).otherwise(F.lit("RD__"))
    return checks.history_letters(t.registration.withColumn("history", text)).select("ord")


@query("SELECT 'i' || i AS name, i AS position FROM range(1025, 1030) x(i)")
def columns_over_limit(t: Tables) -> DataFrame:
    return checks.over_column_limit(t.spark, [f"i{k}" for k in range(1, 1030)])


# ---- reports and records as text ----


def _record(t: Tables) -> DataFrame:
    """Eight lines for each order: a header, a contest with a plain and a wrapped selection; some have no Vote-For line."""
    key = F.col("o_orderkey")
    lines = F.array(
        F.lit("Precinct: 7"), F.concat(F.lit("Contest "), (key % 3).cast("string"), F.lit(" (9)")),
        F.when(key % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Vote For: "), (1 + key % 2).cast("string"))),
        F.concat(F.lit("Cand "), (key % 5).cast("string"), F.lit(" (11)")), F.lit("Counted"), F.lit("A long"), F.lit("name (12)"), F.lit("Undervoted"),
    )
    return t.source("orders").select(key.cast("long").alias("file"), F.posexplode(lines).alias("line_no", "line"))


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS ballot, s.ord, 'Contest ' || CAST(o_orderkey % 3 AS VARCHAR) AS contest, CAST(1 + o_orderkey % 2 AS BIGINT) AS vote_for,
CASE s.ord WHEN 3 THEN 'Cand ' || CAST(o_orderkey % 5 AS VARCHAR) ELSE 'A long name' END AS selection, CASE s.ord WHEN 3 THEN 'Counted' ELSE 'Undervoted' END AS status
FROM orders, (VALUES (3), (5)) s(ord) WHERE o_orderkey % 4 <> 0"""
)
def record_selections(t: Tables) -> DataFrame:
    return reports.cast_vote_records(_record(t))


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS file, n AS line_no, CASE WHEN n = 0 OR o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS contest_no,
CASE WHEN n = 0 OR o_orderkey % 4 = 0 THEN 'header' WHEN n = 1 THEN 'contest' WHEN n = 2 THEN 'vote_for' ELSE 'selection' END AS role
FROM orders, range(8) r(n) WHERE NOT (n = 2 AND o_orderkey % 4 = 0)"""
)
def record_groups(t: Tables) -> DataFrame:
    return ordered.contest_groups(_record(t)).select("file", "line_no", F.col("contest_no").cast("long").alias("contest_no"), "role")


@query("SELECT CAST(o_orderkey AS BIGINT) AS file, 1 AS line_no FROM orders WHERE o_orderkey % 4 = 0")
def contest_shape_violations(t: Tables) -> DataFrame:
    body = _record(t).filter("line_no > 0")
    return checks.contest_shape(body, starts=r"^Contest .*\([0-9]+\)$").select("file", "line_no")


@query(
    """SELECT CAST(p_size AS BIGINT) AS file, CAST(p_partkey AS BIGINT) * 10 + n AS line_no, CASE WHEN p_partkey % 2 = 0 THEN 'R' ELSE 'DZ' END AS ballot_type, CAST(p_partkey AS VARCHAR) AS style,
p_brand AS contest, p_name AS candidate FROM part, (VALUES (5), (6)) r(n)"""
)
def listing_rows(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    style = F.concat(F.lit("Ballot Style "), F.when(key % 2 == 0, F.lit("R ")).otherwise(F.lit("dz ")), key.cast("string"))
    detail = F.array("p_brand", "p_name")
    lines = F.array(
        F.array(F.lit("Ballot Detail Listing")), F.array(F.lit("County"), F.lit("x")), F.array(F.lit("Orientation")), F.array(style),
        F.array(F.lit("Order"), F.lit("Name")), detail, detail,
    )
    rows = t.source("part").select(F.col("p_size").cast("long").alias("file"), key.cast("long").alias("k"), F.posexplode(lines).alias("n", "cells"))
    return reports.ballot_listing(rows.select("file", (F.col("k") * 10 + F.col("n")).alias("line_no"), "cells"), ["contest", "candidate"])


@query("SELECT ord, vuid, last, zip FROM registration")
def fixed_width_rows(t: Tables) -> DataFrame:
    value = F.concat(F.rpad("vuid", 12, " "), F.rpad("last", 20, " "), F.lpad("zip", 8, " "))
    blank = t.spark.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit("   ").alias("value"))
    rows = files.fixed_width(t.registration.select("ord", value.alias("value")).unionByName(blank), {"vuid": (1, 12), "last": (13, 32), "zip": (33, 40)})
    return rows.withColumn("zip", T.field("zip"))


# ---- files: written, then read back ----


@query("SELECT vuid, chr(34) || last || ', x' AS last, party FROM registration")
def csv_round_trip(t: Tables) -> DataFrame:
    path = f"{new_folder(t.spark, 'csv')}/t"
    rows = t.registration.select("vuid", F.concat(F.lit('"'), F.col("last"), F.lit(", x")).alias("last"), "party", "zip")
    sinks.write_csv(rows, path, ["vuid", "last", "party"])
    return files.read_delimited(t.spark, path).select("vuid", "last", F.coalesce("party", F.lit("")).alias("party"))


@query("SELECT vuid, last, 'main' AS part FROM registration UNION ALL SELECT vuid, last, 'second' FROM registration2")
def folder_union(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "lists")
    for name, rows in (("main", t.registration), ("second", t.registration2)):
        sinks.write_csv(rows.select("vuid", "last", F.lit(name).alias("part")), f"{path}/{name}", order=["vuid"])
    return files.read_delimited(t.spark, f"{path}/*", encoding="utf-8").select("vuid", "last", "part")


@query("SELECT vuid, last, party FROM roster")
def files_by_party(t: Tables) -> DataFrame:
    path = f"{new_folder(t.spark, 'parties')}/t"
    sinks.write_by_value(t.roster.select("vuid", "last", "party"), path, "party", ["last", "vuid"])
    return t.spark.read.option("header", "true").schema("vuid string, last string, party string").csv(path)


@query("SELECT vuid || ' ' || last AS line, count(*) AS n FROM roster GROUP BY 1")
def text_round_trip(t: Tables) -> DataFrame:
    path = f"{new_folder(t.spark, 'text')}/t"
    sinks.write_text(t.roster.select(F.concat_ws(" ", "vuid", "last").alias("line")), path)
    return files.read_lines(t.spark, path).filter("value != ''").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vuid, ord, party FROM registration")
def versioned_round_trip(t: Tables) -> DataFrame:
    path = f"{new_folder(t.spark, 'versions')}/t"
    files.write_versioned(t.registration.select("vuid", "ord", "party"), path, 3)
    return files.read_versioned(t.spark, path, 3)


@query("SELECT 'part' AS stem, count(*) AS n FROM (SELECT DISTINCT party FROM roster)")
def file_listing(t: Tables) -> DataFrame:
    """Files below a folder of one file for each party."""
    path = f"{new_folder(t.spark, 'listing')}/t"
    t.roster.select("vuid", "party").repartition(1).write.partitionBy("party").csv(path)
    found = files.file_list(t.spark, path, r"^part-.*\.csv$")
    return found.groupBy(F.get(F.split("name", "-"), F.lit(0)).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '/x/' || o_orderkey || 'c.pdf' AS path, CASE WHEN o_orderkey % 3 = 0 THEN '/x/' || o_orderkey || 'i.pdf' ELSE '' END AS companion FROM orders")
def companion_files(t: Tables) -> DataFrame:
    name = lambda end: F.concat(F.lit("/x/"), F.col("o_orderkey").cast("string"), F.lit(end))
    found = F.array(name("c.pdf"), F.when(F.col("o_orderkey") % 3 == 0, name("i.pdf")).otherwise(F.lit("/x/readme.txt")))
    return files.companions(t.source("orders").select(F.explode(found).alias("path")))


@query(
    """WITH b AS (SELECT location, lower(flag) <> 'n' AS p, upper(substr(code, 1, 2)) AS period FROM checkins), s AS (SELECT DISTINCT location, period FROM b WHERE period IN ('EV', 'ED'))
SELECT location, CASE period WHEN 'EV' THEN 0 ELSE 1 END AS block, row_number() OVER (ORDER BY CASE period WHEN 'EV' THEN 0 ELSE 1 END, location) AS position FROM s"""
)
def site_blocks(t: Tables) -> DataFrame:
    sites = places.with_period(t.checkins).select("location", "period").distinct()
    part = lambda p: sites.filter(F.col("period") == p).select("location")
    return dedup.number_rows(sinks.with_blocks(part("EV"), part("ED")), ["block", "location"]).withColumnRenamed("number", "position")
