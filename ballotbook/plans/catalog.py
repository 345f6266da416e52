"""The named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import history as H
from ..functions import names as N
from ..functions import text as T
from ..operators import checks, compare, dedup, ordered, places, property, sets, tally, viewer
from .adapters import Tables, with_views
from .sql_text import FREEFORM, HISTORY, PROPERTY_CTE, STREET_CTE

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the views under its own name."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- rosters and registrations ----


@query(
    """WITH reg AS (SELECT * FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1)
SELECT r.ballot_type, r.party, CASE WHEN g.vuid IS NULL THEN 'unknown' WHEN lower(r.last) <> lower(g.last) THEN 'name_mismatch' ELSE 'match' END AS outcome,
count(*) AS n FROM roster r LEFT JOIN reg g USING (vuid) GROUP BY ALL"""
)
def roster_vs_registration(t: Tables) -> DataFrame:
    return compare.outcome_counts(t.roster, t.registration)


@query("SELECT ballot_type, count(*) AS n FROM roster GROUP BY ballot_type")
def roster_type_counts(t: Tables) -> DataFrame:
    return compare.type_counts(t.roster)


@query("SELECT ballot_type, CASE WHEN party = 'REP' THEN 'REP' ELSE 'DEM' END AS side, count(*) AS n FROM roster GROUP BY ROLLUP (ballot_type, side)")
def roster_type_party_counts(t: Tables) -> DataFrame:
    return compare.type_party_counts(t.roster)


@query("SELECT vuid, ord, last, party, vote_date FROM roster QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1")
def roster_dedup_first(t: Tables) -> DataFrame:
    return dedup.first_wins(t.roster.select("vuid", "ord", "last", "party", "vote_date"), ["vuid"])


@query("SELECT vuid, ord, last, party, vote_date FROM roster QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord DESC) = 1")
def roster_dedup_last(t: Tables) -> DataFrame:
    return dedup.last_wins(t.roster.select("vuid", "ord", "last", "party", "vote_date"), ["vuid"])


@query("SELECT vuid, ord, min(ord) OVER (PARTITION BY vuid) AS first_ord FROM roster QUALIFY ord > first_ord")
def roster_duplicates(t: Tables) -> DataFrame:
    return dedup.duplicate_listing(t.roster.select("vuid", "ord"), ["vuid"])


@query("SELECT ord, vuid, party FROM roster WHERE vuid NOT IN (SELECT vuid FROM registration)")
def unknown_voters(t: Tables) -> DataFrame:
    return compare.unknown_voters(t.roster.select("ord", "vuid", "party"), t.registration)


@query(
    """SELECT ord, vuid, 1 AS source FROM roster WHERE vuid IN (SELECT vuid FROM registration)
UNION ALL SELECT ord, vuid, 2 FROM roster WHERE vuid NOT IN (SELECT vuid FROM registration) AND vuid IN (SELECT vuid FROM registration2)"""
)
def unknown_second_list(t: Tables) -> DataFrame:
    return compare.found_in_list(t.roster.select("vuid", "ord"), t.registration, t.registration2)


@query(
    """SELECT r.ord, vuid, g.number, g.name1, g.zip FROM roster r
JOIN (SELECT * FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1) g USING (vuid)"""
)
def convention_list(t: Tables) -> DataFrame:
    return compare.enriched(t.roster.select("vuid", "ord"), t.registration, ["number", "name1", "zip"])


@query(
    """WITH r AS (SELECT DISTINCT vuid FROM roster WHERE ballot_type <> 'BBM'), c AS (SELECT DISTINCT vuid FROM checkins)
SELECT vuid, 'roster' AS side FROM r WHERE vuid NOT IN (SELECT vuid FROM c)
UNION ALL SELECT vuid, 'checkin' FROM c WHERE vuid NOT IN (SELECT vuid FROM r)"""
)
def checkin_full_difference(t: Tables) -> DataFrame:
    return compare.checkin_difference(t.roster, t.checkins)


@query(
    """SELECT r.ord, vuid, r.last, g.last AS reg_last FROM roster r
JOIN (SELECT * FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1) g USING (vuid) WHERE lower(r.last) <> lower(g.last)"""
)
def name_mismatch(t: Tables) -> DataFrame:
    return compare.name_mismatches(t.roster, t.registration).select("ord", "vuid", "last", "reg_last")


_FIRST_CHECKIN = "(SELECT * FROM checkins QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1)"


@query(f"SELECT r.ord, vuid, r.party, c.party AS checkin_party FROM roster r JOIN {_FIRST_CHECKIN} c USING (vuid) WHERE r.party <> c.party")
def party_mismatch(t: Tables) -> DataFrame:
    return compare.party_mismatches(t.roster, t.checkins).select("ord", "vuid", "party", "checkin_party")


@query(
    f"""SELECT CAST(sign(date_diff('day', try_strptime(c.vote_date, '%m/%d/%Y'), try_strptime(r.vote_date, '%m/%d/%Y'))) AS INTEGER) AS cmp, count(*) AS n
FROM roster r JOIN {_FIRST_CHECKIN} c USING (vuid) GROUP BY cmp"""
)
def date_mismatch(t: Tables) -> DataFrame:
    return compare.date_mismatches(t.roster, t.checkins).groupBy("cmp").agg(F.count(F.lit(1)).alias("n"))


_LAST_PRIMARY = "(SELECT * FROM primary_roster QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord DESC) = 1)"


@query(f"SELECT r.party, coalesce(nullif(p.party, ''), '(none)') AS primary_party, count(*) AS n FROM roster r LEFT JOIN {_LAST_PRIMARY} p USING (vuid) GROUP BY ALL")
def party_vs_primary(t: Tables) -> DataFrame:
    return compare.party_against_primary(t.roster, t.primary_roster)


@query(
    f"""WITH j AS (SELECT r.party, p.vuid AS pv, p.party AS pp, g.party AS gp FROM roster r LEFT JOIN {_LAST_PRIMARY} p USING (vuid)
LEFT JOIN (SELECT * FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1) g USING (vuid))
SELECT CASE WHEN pv IS NOT NULL THEN CASE WHEN pp = party THEN 'same_as_primary' ELSE 'other_than_primary' END
WHEN gp IS NULL THEN 'unregistered' WHEN gp = '' THEN 'no_party' WHEN gp = party THEN 'same_as_registration' ELSE 'other_than_registration' END AS verdict,
count(*) AS n FROM j GROUP BY verdict"""
)
def three_way_consistency(t: Tables) -> DataFrame:
    return compare.three_way(t.roster, t.primary_roster, t.registration)


@query(
    """WITH m AS (SELECT c.location AS reason, coalesce(r.party, 'Unknown') AS p FROM checkins c
LEFT JOIN (SELECT * FROM roster QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1) r USING (vuid))
SELECT reason, count(*) AS n, count(*) FILTER (p = 'REP') AS n_rep, count(*) FILTER (p = 'DEM') AS n_dem FROM m GROUP BY reason"""
)
def rid_first_match(t: Tables) -> DataFrame:
    return compare.reason_counts(compare.first_match(t.checkins.select("vuid", F.col("location").alias("reason")), t.roster))


@query(
    """SELECT g.ord, vuid, coalesce(r.party, g.party) AS party FROM registration g
LEFT JOIN (SELECT * FROM roster QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord DESC) = 1) r USING (vuid)"""
)
def history_semi_update(t: Tables) -> DataFrame:
    return compare.updated_party(t.registration.select("ord", "vuid", "party"), t.roster)


_GROUPS = """groups AS (SELECT last, first, middle, dob, count(DISTINCT vuid) AS n_members FROM registration
WHERE last <> '' AND first <> '' AND middle <> '' AND dob <> '' GROUP BY ALL HAVING count(DISTINCT vuid) > 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY last, first, middle, dob) AS group_no FROM groups)"""
_NAME = ["last", "first", "middle", "dob"]


@query(f"WITH {_GROUPS} SELECT group_no, last, first, middle, dob, n_members FROM numbered")
def suspect_groups(t: Tables) -> DataFrame:
    return dedup.repeated_groups(t.registration, _NAME, "vuid")


@query(
    f"""WITH {_GROUPS}, people AS (SELECT DISTINCT group_no, vuid FROM registration JOIN numbered USING (last, first, middle, dob)),
votes AS (SELECT vuid, count(*) AS n FROM roster GROUP BY vuid)
SELECT group_no, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_votes, coalesce(sum(n) > 1, false) AS several FROM people LEFT JOIN votes USING (vuid) GROUP BY group_no"""
)
def multi_vote_flags(t: Tables) -> DataFrame:
    groups = dedup.repeated_groups(t.registration, _NAME, "vuid")
    return compare.multi_vote_flags(groups, t.registration, t.roster, _NAME)


@query("SELECT count(*) FILTER (party = 'REP') AS rep, count(*) FILTER (party = 'DEM') AS dem, count(*) FILTER (party = '') AS blank, count(*) FILTER (party NOT IN ('REP', 'DEM', '')) AS other FROM registration")
def registration_party_counts(t: Tables) -> DataFrame:
    return compare.party_counts(t.registration)


@query(
    """SELECT ballot_type, count(*) AS n FROM roster WHERE vuid IN
(SELECT vuid FROM (SELECT * FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1) WHERE district = '2') GROUP BY ballot_type"""
)
def district_filter_counts(t: Tables) -> DataFrame:
    return compare.district_counts(t.roster, t.registration, "2")


@query(
    """WITH a AS (SELECT DISTINCT vuid FROM registration), b AS (SELECT DISTINCT vuid FROM registration2)
SELECT (SELECT count(*) FROM a WHERE vuid IN (SELECT vuid FROM b)) AS in_both, (SELECT count(*) FROM a WHERE vuid NOT IN (SELECT vuid FROM b)) AS only_first,
(SELECT count(*) FROM b WHERE vuid NOT IN (SELECT vuid FROM a)) AS only_second"""
)
def list_diff_counts(t: Tables) -> DataFrame:
    return sets.list_difference(t.registration, t.registration2)


_ONLY = "SELECT vuid, last, dob FROM {a} WHERE vuid NOT IN (SELECT vuid FROM {b}) QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1"


@query(_ONLY.format(a="registration", b="registration2"))
def list_only_first(t: Tables) -> DataFrame:
    return sets.only_in_first(t.registration, t.registration2).select("vuid", "last", "dob")


@query(_ONLY.format(a="registration2", b="registration"))
def list_only_second(t: Tables) -> DataFrame:
    return sets.only_in_first(t.registration2, t.registration).select("vuid", "last", "dob")


@query(
    """WITH m AS (SELECT vuid, last, party FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1),
s AS (SELECT vuid, last, party FROM registration2 QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord DESC) = 1)
SELECT * FROM s UNION ALL SELECT * FROM m WHERE vuid NOT IN (SELECT vuid FROM s)"""
)
def supplement_upsert(t: Tables) -> DataFrame:
    return sets.upsert(t.registration, t.registration2).select("vuid", "last", "party")


@query(
    """WITH m AS (SELECT vuid, last, ord FROM registration QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord) = 1),
s AS (SELECT vuid, party, ord FROM registration2 QUALIFY row_number() OVER (PARTITION BY vuid ORDER BY ord DESC) = 1)
SELECT vuid, NULL AS last, party FROM s UNION ALL SELECT vuid, last, NULL FROM m WHERE vuid NOT IN (SELECT vuid FROM s)"""
)
def schema_union(t: Tables) -> DataFrame:
    return sets.upsert(t.registration.select("vuid", "last", "ord"), t.registration2.select("vuid", "party", "ord")).select("vuid", "last", "party")


# ---- ballots ----

_VALID = """v AS (SELECT s.* FROM selections s LEFT JOIN (SELECT ballot, min(ord) AS bad FROM selections
WHERE status NOT IN ('Counted', 'Overvoted', 'Undervoted') GROUP BY ballot) b USING (ballot) WHERE bad IS NULL OR ord < bad)"""
_BUCKETS = "SELECT DISTINCT contest, b AS selection, 0 AS n FROM v, (VALUES ('Overvote'), ('Undervote')) x(b)"


def _valid(t: Tables) -> DataFrame:
    return tally.valid_selections(t.selections)


@query(
    f"""WITH {_VALID}, one AS (SELECT contest, arg_min(CASE status WHEN 'Overvoted' THEN 'Overvote' WHEN 'Undervoted' THEN 'Undervote' ELSE selection END, ord) AS selection
FROM v GROUP BY ballot, contest), c AS (SELECT contest, selection, count(*) AS n FROM one GROUP BY ALL UNION ALL {_BUCKETS})
SELECT contest, selection, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL"""
)
def contest_tally_single(t: Tables) -> DataFrame:
    return tally.tally_single(_valid(t).dropDuplicates(["ballot", "ord"]))


_MULTI = f"""c AS (SELECT contest, selection, count(*) AS n FROM v WHERE status = 'Counted' GROUP BY ALL
UNION ALL SELECT contest, 'Overvote', sum(x) FROM (SELECT contest, max(vote_for) AS x FROM v WHERE status = 'Overvoted' GROUP BY ballot, contest) GROUP BY contest
UNION ALL SELECT contest, 'Undervote', count(*) FROM v WHERE status = 'Undervoted' GROUP BY contest UNION ALL {_BUCKETS})"""


@query(f"WITH {_VALID}, {_MULTI} SELECT contest, selection, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL")
def contest_tally_multi(t: Tables) -> DataFrame:
    return tally.tally_multi(_valid(t))


@query(f"WITH {_VALID.replace('WHERE bad IS NULL OR ord < bad', 'WHERE (bad IS NULL OR ord < bad) AND barcoded')}, {_MULTI} SELECT contest, selection, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL")
def barcode_only_tally(t: Tables) -> DataFrame:
    return tally.tally_multi(_valid(t), F.col("barcoded"))


@query(
    f"""WITH {_VALID}, m AS (SELECT DISTINCT contest, 'S' || CAST(k AS VARCHAR) AS selection FROM v, (SELECT unnest(range(8)) AS k)),
n AS (SELECT contest, selection, count(*) AS n FROM v WHERE status = 'Counted' GROUP BY ALL)
SELECT contest, selection, coalesce(n, 0) AS n FROM m LEFT JOIN n USING (contest, selection)"""
)
def zero_filled_tally(t: Tables) -> DataFrame:
    v = _valid(t)
    master = v.select("contest").distinct().select("contest", F.explode(F.array(*[F.lit(f"S{k}") for k in range(8)])).alias("selection"))
    counts = v.filter("status = 'Counted'").groupBy("contest", "selection").agg(F.count(F.lit(1)).alias("n"))
    return tally.zero_filled(master, counts)


@query("SELECT contest, count(*) AS total FROM selections GROUP BY contest")
def contest_totals(t: Tables) -> DataFrame:
    return tally.contest_totals(t.selections.groupBy("contest", "selection").agg(F.count(F.lit(1)).alias("n")))


def _ballots(t: Tables) -> DataFrame:
    """Ballots of a style with the barcodes of their lines: orders of one brand stand for ballots."""
    return t.source("lineitem").join(t.source("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_orderkey").cast("long").alias("ballot"), F.col("p_brand").alias("style")
    ).agg(F.collect_set(((F.col("l_suppkey") + F.col("l_partkey")) % 60).cast("long")).alias("barcodes"))


_BALLOTS = """ballots AS (SELECT CAST(l_orderkey AS BIGINT) AS ballot, p_brand AS style, list_distinct(list(CAST((l_suppkey + l_partkey) % 60 AS BIGINT))) AS barcodes
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
st AS (SELECT * FROM styles QUALIFY row_number() OVER (PARTITION BY style, barcode ORDER BY ord DESC) = 1),
long AS (SELECT ballot, style, unnest(barcodes) AS barcode FROM ballots),
dec AS (SELECT long.*, st.contest, st.selection FROM long LEFT JOIN st USING (style, barcode))"""


def _styles(t: Tables) -> DataFrame:
    return dedup.last_wins(t.styles, ["style", "barcode"])


@query(f"WITH {_BALLOTS} SELECT barcode, count(*) AS n FROM long GROUP BY barcode")
def barcode_frequency(t: Tables) -> DataFrame:
    return tally.barcode_frequency(_ballots(t))


@query(f"WITH {_BALLOTS} SELECT coalesce(contest, '(missing)') AS contest, count(*) AS n FROM dec GROUP BY 1")
def style_barcode_lookup(t: Tables) -> DataFrame:
    found = tally.decoded(_ballots(t), _styles(t))
    return found.groupBy(F.coalesce("contest", F.lit("(missing)")).alias("contest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_BALLOTS}, due AS (SELECT DISTINCT ballot, style, st.contest FROM ballots JOIN st USING (style))
SELECT contest, count(*) AS n_undervotes FROM due WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.ballot = due.ballot AND dec.contest = due.contest) GROUP BY contest"""
)
def style_undervotes(t: Tables) -> DataFrame:
    return tally.style_undervotes(_ballots(t), _styles(t))


@query("SELECT style, barcode, count(*) AS n FROM styles GROUP BY ALL HAVING count(*) > 1")
def duplicate_barcodes(t: Tables) -> DataFrame:
    return checks.duplicate_barcodes(t.styles)


@query("SELECT DISTINCT ord FROM styles WHERE ord NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def unused_styles(t: Tables) -> DataFrame:
    used = t.source("lineitem").filter("l_quantity = 50").select(F.col("l_partkey").cast("long").alias("ord"))
    return sets.unused(t.styles, used, "ord")


@query("SELECT DISTINCT contest, selection FROM styles s WHERE NOT EXISTS (SELECT 1 FROM styles m WHERE m.ord % 3 <> 0 AND m.contest = s.contest AND m.selection = s.selection)")
def master_list_violations(t: Tables) -> DataFrame:
    return tally.not_in_master(t.styles, t.styles.filter("ord % 3 <> 0").select("contest", "selection").distinct())


@query(
    f"""WITH {_VALID} SELECT machine, count(DISTINCT ballot) AS n_ballots, min(place) FILTER (ord = f) AS place
FROM (SELECT *, min(ord) OVER (PARTITION BY machine) AS f FROM v) GROUP BY machine"""
)
def machine_counts(t: Tables) -> DataFrame:
    v = _valid(t)
    return tally.machine_counts(v.withColumn("ord", F.struct("ord", "place")))


@query(
    f"""WITH {_VALID} SELECT machine, CAST(coalesce(sum(1) FILTER (regexp_matches(selection, 'S[01]')), 0) AS BIGINT) AS "S[01]", CAST(coalesce(sum(1) FILTER (regexp_matches(selection, 'S3')), 0) AS BIGINT) AS "S3"
FROM v WHERE status = 'Counted' GROUP BY machine"""
)
def machine_candidate_pivot(t: Tables) -> DataFrame:
    return tally.machine_pivot(_valid(t), ["S[01]", "S3"])


@query(
    f"""WITH {_VALID}, e AS (SELECT machine, selection, count(*) AS n, min(ord) AS o FROM v WHERE status = 'Counted' GROUP BY ALL)
SELECT machine, coalesce(arg_max(n, o) FILTER (regexp_matches(selection, 'S[01]')), 0) AS "S[01]" FROM e GROUP BY machine"""
)
def machine_candidate_last(t: Tables) -> DataFrame:
    return tally.machine_pivot(_valid(t), ["S[01]"], mode="last")


@query("SELECT CASE WHEN machine LIKE 'DS200%' THEN 'DS200' WHEN machine LIKE 'Express%' THEN 'ExpressTouch' ELSE 'Central' END AS class, count(DISTINCT machine) AS n FROM selections GROUP BY 1")
def machine_class_counts(t: Tables) -> DataFrame:
    return t.selections.groupBy(tally.machine_class(F.col("machine")).alias("class")).agg(F.countDistinct("machine").alias("n"))


@query("SELECT machine, max(vote_for) AS public_count, CASE WHEN machine LIKE 'C%' THEN NULL ELSE count(*) END AS cards, greatest(max(vote_for), coalesce(cards, 0)) AS total FROM selections GROUP BY machine")
def tape_totals(t: Tables) -> DataFrame:
    tapes = t.selections.groupBy("machine").agg(
        F.max("vote_for").alias("public_count"), F.when(~F.col("machine").startswith("C"), F.count(F.lit(1))).alias("cards")
    )
    return tally.tape_totals(tapes, ["public_count", "cards"])


_SHARES = """e AS (SELECT contest, selection, count(*) FILTER (machine LIKE 'DS200%') AS n_batch, count(*) FILTER (machine NOT LIKE 'DS200%') AS n_rest
FROM selections WHERE status = 'Counted' GROUP BY ALL)"""


@query(
    f"""WITH {_SHARES} SELECT contest, selection, n_batch, n_rest,
CASE WHEN sum(n_batch) OVER w > 0 THEN round_even(CAST(n_batch AS DOUBLE) / CAST(sum(n_batch) OVER w AS DOUBLE) * 100, 6) ELSE 0.0 END AS pct_batch,
CASE WHEN sum(n_rest) OVER w > 0 THEN round_even(CAST(n_rest AS DOUBLE) / CAST(sum(n_rest) OVER w AS DOUBLE) * 100, 6) ELSE 0.0 END AS pct_rest FROM e WINDOW w AS (PARTITION BY contest)"""
)
def batch_share_compare(t: Tables) -> DataFrame:
    return tally.share_comparison(t.selections, F.col("machine").startswith("DS200"))


@query(f"WITH {_SHARES}, v AS (SELECT contest, CAST(sum(n_batch + n_rest) AS BIGINT) AS sum FROM e GROUP BY contest), t AS (SELECT contest, count(*) AS total FROM selections GROUP BY contest) SELECT contest, sum, total FROM v JOIN t USING (contest) WHERE sum <> total")
def batch_total_violations(t: Tables) -> DataFrame:
    return checks.batch_totals(batch_share_compare(t), contest_totals(t))


@query(
    """WITH e AS (SELECT ballot, contest, max(vote_for) AS vote_for, count(*) AS n, CAST(max(CASE WHEN status = 'Overvoted' THEN 1 ELSE 0 END) AS INTEGER) AS over FROM selections GROUP BY ALL)
SELECT * FROM e WHERE (over = 0 AND n <> vote_for) OR (over = 1 AND n <= vote_for)"""
)
def selection_count_violations(t: Tables) -> DataFrame:
    return checks.selection_counts(t.selections)


# ---- ballot details in file order ----

_ORDER = ["k1", "k2", "k3", "k4", "k5", "k6"]
_W = "PARTITION BY file ORDER BY k1, k2, k3, k4, k5, k6"


@query(
    f"""WITH d AS (SELECT *, last_value(CASE WHEN seq_text IS NOT NULL THEN k1 * 10 + k2 END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS src,
last_value(CASE WHEN seq_text IS NOT NULL THEN contest END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS filled,
last_value(seq_text IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS filled_seq
FROM detail WHERE row_no IS NOT NULL OR col_no IS NOT NULL) SELECT file, filled AS contest, filled_seq AS seq_text, count(*) AS n FROM d GROUP BY ALL"""
)
def forward_fill_detail(t: Tables) -> DataFrame:
    return ordered.fill_down(t.detail, "seq_text", ["seq_text", "contest"], _ORDER).groupBy("file", "contest", "seq_text").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH a AS (SELECT *, coalesce(seq < lag(seq) OVER ({_W}), true) AS nw, coalesce(col_no < lag(col_no) OVER ({_W}), false) AS lower_col FROM detail WHERE row_no IS NOT NULL AND col_no IS NOT NULL),
b AS (SELECT *, CAST(sum(CAST(nw AS INTEGER)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ballot_no, CAST(NOT nw AND lower_col AS INTEGER) AS d FROM a),
c AS (SELECT *, CAST(sum(d) OVER (PARTITION BY file, ballot_no ORDER BY k1, k2, k3, k4, k5, k6 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k FROM b)
SELECT file, k1, k2, k3, k4, k5, k6, ballot_no, CAST(1 + k % 2 AS INTEGER) AS side_no, CAST(1 + k // 2 AS INTEGER) AS page_no,
CAST(col_no * 10000 + row_no * 100 + (1 + k % 2) * 10 + 1 + k // 2 AS BIGINT) AS barcode FROM c"""
)
def ballot_side_page(t: Tables) -> DataFrame:
    rows = ordered.sides_and_pages(t.detail.filter("row_no is not null and col_no is not null"), _ORDER)
    code = H.oval_barcode(F.col("col_no"), F.col("row_no"), F.col("side_no"), F.col("page_no"))
    return rows.select("file", *_ORDER, "ballot_no", "side_no", "page_no", code.alias("barcode"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(x // 10000 AS INTEGER) AS col_no, CAST(x // 100 % 100 AS INTEGER) AS row_no, CAST(x // 10 % 10 AS INTEGER) AS side_no, CAST(x % 10 AS INTEGER) AS page_no
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_partkey * 37 % 1000000 AS x FROM lineitem)"""
)
def barcode_decode(t: Tables) -> DataFrame:
    rows = t.source("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 37 % 1000000).alias("x")).distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in H.barcode_parts(F.col("x")).items()])


@query(
    """SELECT p_partkey, CAST(substr(s, 1, 10) AS BIGINT) AS precinct_id, CAST(substr(s, 11, 10) AS BIGINT) AS style_id, CAST(substr(s, 22, 2) AS INTEGER) AS write_ins,
CAST(substr(s, 25, 2) AS INTEGER) AS selections, CAST(substr(s, 27, 1) AS INTEGER) AS judge_initials, CAST(substr(s, 28, 1) AS INTEGER) AS review_box
FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 10, '0') || lpad(CAST(p_size AS VARCHAR), 10, '0') || '0' || lpad(CAST(p_size % 7 AS VARCHAR), 2, '0') || '0' || lpad(CAST(p_size % 23 AS VARCHAR), 2, '0') || '1' || '0' AS s FROM part)"""
)
def style_code_slices(t: Tables) -> DataFrame:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    size = F.col("p_size")
    code = F.concat(pad(F.col("p_partkey"), 10), pad(size, 10), F.lit("0"), pad(size % 7, 2), F.lit("0"), pad(size % 23, 2), F.lit("10"))
    return t.source("part").select("p_partkey", *[c.alias(n) for n, c in H.style_code_parts(code).items()])


@query(
    f"""SELECT file, k1, k2, k3, k4, k5, k6, last_value(CASE WHEN k3 % 7 = 0 THEN 'D' || CAST(k3 AS VARCHAR) END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS style FROM detail"""
)
def style_carry(t: Tables) -> DataFrame:
    mark = F.when(F.col("k3") % 7 == 0, F.concat(F.lit("D"), F.col("k3").cast("string")))
    return ordered.carry(t.detail, mark, "style", _ORDER).select("file", *_ORDER, "style")


# ---- places ----

_SITES = """s AS (SELECT *, lower(flag) <> 'n' AS provisional, CASE WHEN upper(substr(code, 1, 2)) IN ('ED', 'EV') THEN upper(substr(code, 1, 2)) ELSE '' END AS period FROM checkins)"""


def _sites(t: Tables) -> DataFrame:
    return places.with_period(t.checkins)


@query(
    f"""WITH {_SITES} SELECT location, period = 'EV' AS early, count(*) FILTER (NOT provisional) AS voters, count(*) FILTER (provisional) AS prov_voters,
count(DISTINCT precinct) FILTER (NOT provisional) AS precincts, count(DISTINCT precinct) FILTER (provisional) AS prov_precincts FROM s GROUP BY ALL"""
)
def polling_site_summary(t: Tables) -> DataFrame:
    return places.site_summary(_sites(t))


@query(
    f"""WITH {_SITES}, g AS (SELECT location, period FROM s GROUP BY location, party, precinct, period HAVING count(*) = 1)
SELECT location, period, count(*) AS n_singletons FROM g GROUP BY ALL"""
)
def singleton_groups(t: Tables) -> DataFrame:
    return places.singletons(_sites(t))


@query("SELECT precinct, arg_min(district, ord) AS district, count(DISTINCT district) AS n_values FROM registration WHERE precinct <> '' AND district <> '' GROUP BY precinct")
def precinct_district_map(t: Tables) -> DataFrame:
    return places.precinct_districts(t.registration)


_ADDRESS = "regexp_replace(number || ' ' || pre || ' ' || name1 || ' ' || type || ' ' || unit || ' ' || zip, ' +', ' ', 'g')"


def _with_address(df: DataFrame) -> DataFrame:
    parts = F.concat_ws(" ", "number", "pre", "name1", "type", "unit", "zip")
    return df.withColumn("address", F.regexp_replace(parts, " +", " "))


@query(f"SELECT precinct, {_ADDRESS} AS address, count(*) AS n FROM registration GROUP BY ALL")
def precinct_addresses(t: Tables) -> DataFrame:
    return places.precinct_addresses(_with_address(t.registration))


_MOVED = f"""w AS (SELECT {_ADDRESS} AS address, arg_min(precinct, ord) AS new_precinct FROM registration_new GROUP BY 1),
moved AS (SELECT precinct AS old_precinct, new_precinct, count(*) AS n FROM (SELECT *, {_ADDRESS} AS address FROM registration) LEFT JOIN w USING (address) GROUP BY ALL)"""


def _moved(t: Tables) -> DataFrame:
    return places.migration(_with_address(t.registration), _with_address(t.registration_new))


@query(f"WITH {_MOVED} SELECT * FROM moved")
def precinct_migration(t: Tables) -> DataFrame:
    return _moved(t)


_MATRIX = ["0", "1", "2", "3", "4"]


@query(
    f"""WITH {_MOVED}, p AS (SELECT *, round_even(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY old_precinct) AS DOUBLE) * 100, 1) AS pct FROM moved)
SELECT new_precinct, {", ".join(f"max(pct) FILTER (old_precinct = '{k}') AS {chr(34)}{k}{chr(34)}" for k in _MATRIX)} FROM p WHERE new_precinct IS NOT NULL GROUP BY new_precinct"""
)
def precinct_migration_matrix(t: Tables) -> DataFrame:
    return places.migration_matrix(_moved(t), _MATRIX)


@query(
    f"""WITH {_MOVED}, s AS (SELECT old_precinct, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (new_precinct = old_precinct), 0) AS BIGINT) AS stayed,
count(new_precinct) AS destinations, CAST(coalesce(sum(n) FILTER (new_precinct IS NULL), 0) AS BIGINT) AS unmapped FROM moved GROUP BY old_precinct)
SELECT *, CASE WHEN stayed = total THEN 'unchanged' WHEN CAST(stayed AS DOUBLE) / total * 100 >= 50 THEN 'majority_stayed' WHEN destinations = 1 THEN 'merged' ELSE 'split' END AS label FROM s"""
)
def precinct_topology(t: Tables) -> DataFrame:
    return places.topology(_moved(t))


# ---- history ----


def _histories(t: Tables) -> DataFrame:
    party = lambda k: F.when(F.col("ck") % (k + 3) == 0, F.lit("REP")).when(F.col("ck") % (k + 4) == 0, F.lit("dem")).otherwise(F.lit(""))
    return t.registration.select("ord", H.history_string("edr", [party(k) for k in range(8)]).alias("history"))


@query(f"WITH {HISTORY} SELECT ord, history FROM h")
def history_string(t: Tables) -> DataFrame:
    return _histories(t)


@query(
    f"""WITH {HISTORY}, c AS (SELECT ord, unnest(range(8)) AS i, history FROM h), u AS (SELECT ord, i, substr(history, CAST(i + 1 AS INTEGER), 1) AS x FROM c WHERE i < length(regexp_extract(history, '^[^~]*'))),
s AS (SELECT ord, sum(CASE x WHEN 'R' THEN 1.0 WHEN '_' THEN 0.5 ELSE 0.0 END * pow(0.5, i)) AS a, sum(pow(0.5, i)) AS b FROM u GROUP BY ord)
SELECT h.ord, CASE WHEN b IS NULL THEN 0.0 ELSE round_even(a / b * 100, 2) END AS score FROM h LEFT JOIN s USING (ord)"""
)
def weighted_score(t: Tables) -> DataFrame:
    return _histories(t).select("ord", H.weighted_score("history").alias("score"))


@query(
    f"""WITH {HISTORY}, c AS (SELECT ord, unnest(range(8)) AS i, history FROM h), u AS (SELECT ord, i, substr(history, CAST(i + 1 AS INTEGER), 1) AS x FROM c WHERE i < length(regexp_extract(history, '^[^~]*'))),
s AS (SELECT ord, sum(CASE x WHEN 'R' THEN 1.0 WHEN 'D' THEN -1.0 ELSE 0.0 END * 25.0 * pow(0.5, i)) AS a FROM u GROUP BY ord)
SELECT h.ord, round_even(50.0 + coalesce(a, 0.0), 2) AS score FROM h LEFT JOIN s USING (ord)"""
)
def bisection_score(t: Tables) -> DataFrame:
    return _histories(t).select("ord", H.bisection_score("history").alias("score"))


# ---- addresses and properties ----


def _streets(t: Tables) -> DataFrame:
    """Raw streets of voters and properties."""
    v = t.registration.select(F.concat_ws(" ", "pre", "name1", "type").alias("raw"))
    p = t.properties.select(F.concat_ws(" ", "prefix", "street", "suffix").alias("raw"))
    return v.unionByName(p).distinct()


@query(f"WITH {STREET_CTE} SELECT raw, st AS street FROM norm")
def street_normalize(t: Tables) -> DataFrame:
    return _streets(t).select("raw", A.normalize_street("raw").alias("street"))


@query(f"WITH {STREET_CTE} SELECT raw, street, label FROM variants")
def street_variants(t: Tables) -> DataFrame:
    return _streets(t).select("raw", F.explode(A.street_variants("raw")).alias("v")).select("raw", "v.street", "v.label")


@query(FREEFORM)
def freeform_address(t: Tables) -> DataFrame:
    line = F.concat_ws(" ", "number", "pre", "name1", "type", "unit", F.lit(", Austin TX"), "zip")
    rows = t.registration.select("ord", line.alias("line"), F.lit("Kyle").alias("town"), F.lit("").alias("code"))
    return A.freeform(rows, "line", "town", "code").select("ord", "number", "street", "unit", "city", "zip")


@query(
    """SELECT page_id, CASE WHEN length(d) >= 9 THEN substr(d, 1, 5) ELSE z END AS five, CASE WHEN length(d) >= 9 AND regexp_matches(substr(d, 6, 4), '[1-9]') THEN substr(d, 6, 4) ELSE '' END AS four
FROM (SELECT page_id, z, regexp_replace(z, '[^0-9]', '', 'g') AS d FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '78701-0000' WHEN 1 THEN '78702-' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') ELSE CAST(78700 + page_id % 90 AS VARCHAR) END AS z FROM pages))"""
)
def zip_split(t: Tables) -> DataFrame:
    k = F.col("page_id")
    z = F.when(k % 3 == 0, F.lit("78701-0000")).when(k % 3 == 1, F.concat(F.lit("78702-"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise((78700 + k % 90).cast("string"))
    five, four = T.zip_split(z, F.lit(""))
    return t.source("pages").select("page_id", five.alias("five"), four.alias("four"))


@query("SELECT ord, last || ', ' || first || CASE WHEN ck % 2 = 0 THEN ' ' || middle ELSE '' END AS list_name, first || CASE WHEN ck % 2 = 0 THEN ' ' || middle ELSE '' END || ' ' || last AS natural_name FROM registration")
def compose_name(t: Tables) -> DataFrame:
    middle = F.when(F.col("ck") % 2 == 0, F.col("middle")).otherwise(F.lit(" "))
    none = F.lit("")
    made = lambda order: N.compose_name(none, none, F.col("first"), middle, F.col("last"), none, order)
    return t.registration.select("ord", made(True).alias("list_name"), made(False).alias("natural_name"))


@query(
    """SELECT ord, regexp_replace(trim(number || ' ' || pre || ' ' || name1 || ' ' || type || ' ' || unit), ' +', ' ', 'g') || ', ' || city || ', TX ' || zip ||
CASE WHEN ck % 2 = 0 THEN '-1234' ELSE '' END AS address FROM registration"""
)
def compose_address(t: Tables) -> DataFrame:
    none = F.lit("")
    five, four = T.zip_split(F.col("zip"), F.when(F.col("ck") % 2 == 0, F.lit("1234")).otherwise(F.lit("0000")))
    made = N.compose_address(none, *(F.col(c) for c in ("number", "pre", "name1", "type")), none, none, F.col("unit"), F.col("city"), F.lit("TX"), five, four)
    return t.registration.select("ord", made.alias("address"))


def _voters(t: Tables) -> DataFrame:
    names = ["number", "pre", "name1", "type", "unit", "city", "zip"]
    rows = dedup.first_wins(t.registration, ["vuid"]).select("vuid", *names)
    found = A.voter_address(rows, {n: n for n in names})
    return found.select("vuid", *[F.col(f"a_{n}").alias(n) for n in ("number", "street", "unit", "city", "zip")], "confidential")


def _matches(t: Tables) -> DataFrame:
    return property.match_properties(_voters(t), t.properties)


@query(f"WITH {PROPERTY_CTE} SELECT vuid, prop_id, level FROM matched")
def property_match(t: Tables) -> DataFrame:
    return _matches(t).select("vuid", "prop_id", "level")


@query(f"WITH {PROPERTY_CTE} SELECT level, count(*) AS n FROM matched WHERE prop_id IS NOT NULL GROUP BY level")
def property_match_levels(t: Tables) -> DataFrame:
    return property.level_counts(_matches(t))


@query(f"WITH {PROPERTY_CTE} SELECT vuid, prop_id, type_desc, state_codes FROM matched WHERE prop_id IS NOT NULL AND NOT is_residential")
def nonresidential_detail(t: Tables) -> DataFrame:
    return property.nonresidential(_matches(t)).select("vuid", "prop_id", "type_desc", "state_codes")


@query(f"WITH {PROPERTY_CTE} SELECT coalesce(nullif(trim(type_desc), ''), '(blank)') AS type_desc, coalesce(nullif(trim(state_codes), ''), '(blank)') AS state_codes, count(*) AS n FROM matched WHERE prop_id IS NOT NULL AND NOT is_residential GROUP BY 1, 2")
def nonresidential_counts(t: Tables) -> DataFrame:
    return property.description_counts(_matches(t))


@query(f"WITH {PROPERTY_CTE} SELECT prop_id FROM properties WHERE prop_id NOT IN (SELECT prop_id FROM matched WHERE prop_id IS NOT NULL)")
def unmatched_properties(t: Tables) -> DataFrame:
    return t.properties.select("prop_id").join(_matches(t).filter("prop_id is not null").select("prop_id"), "prop_id", "left_anti")


@query("SELECT count(*) FILTER (contains(city, '***')) AS n FROM registration")
def confidential_count(t: Tables) -> DataFrame:
    return t.registration.agg(F.count(F.when(A.confidential("city", "name1", "unit"), 1)).alias("n"))


@query(
    """WITH k AS (SELECT prop_id, city, owner_city, trim(regexp_replace(upper(number || ' ' || prefix || ' ' || street || ' ' || suffix), ' +', ' ', 'g')) AS key,
trim(regexp_replace(regexp_replace(upper(owner_line), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS line FROM properties)
SELECT prop_id, CASE WHEN city <> '' THEN city WHEN line <> '' AND contains(line, regexp_replace(key, '^[0-9]+ ', '')) THEN owner_city ELSE '' END AS city FROM k"""
)
def situs_city_backfill(t: Tables) -> DataFrame:
    city = property.back_filled_city("city", "number", "prefix", "street", "suffix", [([F.col("owner_line")], F.col("owner_city"))])
    return t.properties.select("prop_id", city.alias("city"))


@query(
    """WITH s AS (SELECT prop_id, type_cd, type_desc, state_cd, min(ord) AS o FROM improvements WHERE NOT (type_cd = '' AND type_desc = '') GROUP BY ALL),
f AS (SELECT prop_id, list(type_cd ORDER BY o, type_cd, type_desc, state_cd) AS a, list(type_desc ORDER BY o, type_cd, type_desc, state_cd) AS b, list(state_cd ORDER BY o, type_cd, type_desc, state_cd) AS c FROM s GROUP BY prop_id)
SELECT prop_id, list_aggregate(list_filter(a, lambda x, i: list_position(a, x) = i), 'string_agg', ';') AS type_cd, list_aggregate(list_filter(b, lambda x, i: list_position(b, x) = i), 'string_agg', ';') AS type_desc,
list_aggregate(list_filter(c, lambda x, i: list_position(c, x) = i), 'string_agg', ';') AS state_cd FROM f"""
)
def improvement_fold(t: Tables) -> DataFrame:
    return dedup.folded(t.improvements, "prop_id", ["type_cd", "type_desc", "state_cd"])


@query("SELECT type_cd, type_desc, state_cd, count(*) AS n FROM (SELECT DISTINCT prop_id, type_cd, type_desc, state_cd FROM improvements) GROUP BY ALL")
def improvement_type_counts(t: Tables) -> DataFrame:
    return property.type_counts(t.improvements)


@query("SELECT type_cd, type_desc, count(DISTINCT state_cd) AS n_codes FROM improvements GROUP BY ALL HAVING count(DISTINCT state_cd) > 1")
def state_code_fd_violations(t: Tables) -> DataFrame:
    return property.state_code_conflicts(t.improvements)


@query("SELECT ord, 'https://www.google.com/maps/search/?api=1&query=' || replace(url_encode(number || ' ' || name1 || ' & co, Austin'), '%20', '+') || ' ' AS url FROM registration WHERE name1 <> ''")
def maps_url(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), F.col("number"), F.lit("  "), F.col("name1"), F.lit(" & co, Austin"))
    return t.registration.filter("name1 != ''").select("ord", T.maps_url(text).alias("url"))


# ---- viewer and text ----


@query("SELECT row_number() OVER (ORDER BY lower(last) DESC, ord) AS position, ord, last FROM registration")
def viewer_sorted(t: Tables) -> DataFrame:
    rows = t.registration.select("ord", "last").withColumn("row_id", F.col("ord"))
    return viewer.numbered_view(rows, "last", descending=True).drop("row_id")


@query("SELECT ord, concat_ws(',', vuid, CASE WHEN ck % 2 = 0 THEN chr(34) || last || ', ' || first || chr(34) ELSE last END, chr(34) || 'say ' || repeat(chr(34), 2) || first || repeat(chr(34), 3)) AS line FROM registration")
def copy_text(t: Tables) -> DataFrame:
    name = F.when(F.col("ck") % 2 == 0, F.concat_ws(", ", "last", "first")).otherwise(F.col("last"))
    said = F.concat(F.lit('say "'), F.col("first"), F.lit('"'))
    rows = t.registration.select("ord", "vuid", name.alias("name"), said.alias("said"))
    return rows.select("ord", viewer.copy_text(rows, ["vuid", "name", "said"]).alias("line"))


_LINES = """l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
_TAPE = """t AS (SELECT file, line_no, CASE WHEN line_no % 5 = 4 THEN 'END OF REPORT' WHEN line_no % 5 = 0 THEN 'Serial Number: ' || md5(line) WHEN line_no % 5 = 1 THEN 'Public Count: ' || CAST(length(line) AS VARCHAR)
WHEN line_no % 5 = 2 THEN 'Smith votes ' || CAST(length(line) % 97 AS VARCHAR) ELSE 'Sheets Processed: ' || CAST(length(line) AS VARCHAR) || 'x' END AS line FROM l)"""


def _tape_lines(t: Tables) -> DataFrame:
    n, size = F.col("line_no") % 5, F.length("line")
    text = (
        F.when(n == 4, F.lit("END OF REPORT")).when(n == 0, F.concat(F.lit("Serial Number: "), F.md5(F.col("line").cast("binary"))))
        .when(n == 1, F.concat(F.lit("Public Count: "), size.cast("string"))).when(n == 2, F.concat(F.lit("Smith votes "), (size % 97).cast("string")))
        .otherwise(F.concat(F.lit("Sheets Processed: "), size.cast("string"), F.lit("x")))
    )
    return t.lines().select("file", "line_no", text.alias("line"))


@query(
    f"""WITH {_LINES}, {_TAPE}, s AS (SELECT *, line_no // 5 AS tape FROM t)
SELECT file, CAST(tape AS BIGINT) AS tape, max(substr(line, 16)) FILTER (line LIKE 'Serial%') AS serial, CAST(max(try_cast(substr(line, 15) AS INTEGER)) FILTER (line LIKE 'Public%') AS INTEGER) AS public_count,
CAST(NULL AS INTEGER) AS cards, CAST(max(0) FILTER (line LIKE 'Sheets%') AS INTEGER) AS sheets, CAST(max(try_cast(substr(line, 13) AS INTEGER)) FILTER (line LIKE 'Smith%') AS INTEGER) AS Smith FROM s GROUP BY file, tape"""
)
def tape_segments(t: Tables) -> DataFrame:
    return ordered.tape_segments(_tape_lines(t), ["Smith"])


@query(f"WITH {_LINES}, {_TAPE} SELECT file, arg_max(trim(substr(line, 14)), line_no) FILTER (line LIKE 'Public Count:%') AS public_count, arg_max(trim(substr(line, 15)), line_no) FILTER (line LIKE 'Serial Number:%') AS serial_number FROM t GROUP BY file")
def key_value_header(t: Tables) -> DataFrame:
    return ordered.header_fields(_tape_lines(t), ["Public Count", "Serial Number"])


@query()
def cvr_line_groups(t: Tables) -> DataFrame:
    """Contest groups of lines; tests hold it against a plain loop."""
    n = F.col("line_no") % 4
    text = F.when(n == 1, F.lit("Vote For: 2")).when(n == 0, F.concat(F.lit("Contest "), F.col("line_no").cast("string"))).otherwise(F.col("line"))
    return ordered.contest_groups(t.lines().select("file", "line_no", text.alias("line")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more  # noqa: F401  registers its queries

    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401  registers its queries

    return {name: with_views(sql) for name, sql in _SQL.items()}
