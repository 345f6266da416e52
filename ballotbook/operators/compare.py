"""Rosters against registrations, check-ins and earlier rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compare_dates, fold
from .dedup import first_wins, last_wins


def with_registration(roster: DataFrame, registration: DataFrame) -> DataFrame:
    """Roster rows with the first registration of their voter; ``found`` says whether there is one (J-01)."""
    reg = first_wins(registration, ["vuid"]).select(
        "vuid", F.col("last").alias("reg_last"), F.col("first").alias("reg_first"), F.col("party").alias("reg_party"),
        F.lit(True).alias("found"),
    )
    return roster.join(reg, "vuid", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def outcome_counts(roster: DataFrame, registration: DataFrame) -> DataFrame:
    """Rows by ballot type, party and outcome: match, name_mismatch, unknown."""
    outcome = (
        F.when(~F.col("found"), "unknown").when(fold("last") != fold("reg_last"), "name_mismatch").otherwise("match")
    )
    return with_registration(roster, registration).groupBy("ballot_type", "party", outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def unknown_voters(roster: DataFrame, *lists: DataFrame) -> DataFrame:
    """Roster rows that no list knows; each list is asked only for the misses of those before (J-02, J-03)."""
    for one in lists:
        roster = roster.join(one.select("vuid"), "vuid", "left_anti")
    return roster


def found_in_list(roster: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Known rows with the number of the list that knows them (J-03)."""
    one = roster.join(first.select("vuid"), "vuid", "left_semi").withColumn("source", F.lit(1))
    rest = roster.join(first.select("vuid"), "vuid", "left_anti")
    return one.unionByName(rest.join(second.select("vuid"), "vuid", "left_semi").withColumn("source", F.lit(2)))


def enriched(roster: DataFrame, registration: DataFrame, columns: list[str]) -> DataFrame:
    """Roster rows with columns of their registration (J-04)."""
    return roster.join(first_wins(registration, ["vuid"]).select("vuid", *columns), "vuid")


def checkin_difference(roster: DataFrame, checkins: DataFrame, mail: str = "BBM") -> DataFrame:
    """Keys of one side only; the roster counts without mail ballots (J-05)."""
    in_person = roster.filter(F.col("ballot_type") != mail)
    a = in_person.join(checkins.select("vuid"), "vuid", "left_anti").select("vuid", F.lit("roster").alias("side"))
    b = checkins.join(in_person.select("vuid"), "vuid", "left_anti").select("vuid", F.lit("checkin").alias("side"))
    return a.unionByName(b).distinct()


def name_mismatches(roster: DataFrame, registration: DataFrame) -> DataFrame:
    """Known voters whose last names differ (J-06)."""
    return with_registration(roster, registration).filter(F.col("found") & (fold("last") != fold("reg_last")))


def party_mismatches(roster: DataFrame, checkins: DataFrame) -> DataFrame:
    """Voters whose roster and check-in parties differ (J-06)."""
    c = first_wins(checkins, ["vuid"]).select("vuid", F.col("party").alias("checkin_party"))
    return roster.join(c, "vuid").filter(fold("party") != fold("checkin_party"))


def date_mismatches(roster: DataFrame, checkins: DataFrame) -> DataFrame:
    """Roster and check-in dates by comparison: -1, 0, 1 or null (J-06, F-19)."""
    c = first_wins(checkins, ["vuid"]).select("vuid", F.col("vote_date").alias("checkin_date"))
    return roster.join(c, "vuid").withColumn("cmp", compare_dates("vote_date", "checkin_date"))


def party_against_primary(roster: DataFrame, primary: DataFrame) -> DataFrame:
    """Counts by party now and in the primary, ``(none)`` without one (J-07, A-30)."""
    p = last_wins(primary, ["vuid"]).select("vuid", F.col("party").alias("primary_party"))
    return (
        roster.join(p, "vuid", "left")
        .groupBy("party", F.coalesce(F.nullif("primary_party", F.lit("")), F.lit("(none)")).alias("primary_party"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def three_way(roster: DataFrame, primary: DataFrame, registration: DataFrame) -> DataFrame:
    """Counts by verdict; the registration's party is asked only where there is no primary row (J-08)."""
    p = last_wins(primary, ["vuid"]).select("vuid", F.col("party").alias("p_party"), F.lit(True).alias("in_primary"))
    r = first_wins(registration, ["vuid"]).select("vuid", F.col("party").alias("r_party"))
    verdict = (
        F.when(F.col("in_primary"), F.when(F.col("p_party") == F.col("party"), "same_as_primary").otherwise("other_than_primary"))
        .when(F.col("r_party").isNull(), "unregistered")
        .when(F.col("r_party") == "", "no_party")
        .when(F.col("r_party") == F.col("party"), "same_as_registration")
        .otherwise("other_than_registration")
    )
    return roster.join(p, "vuid", "left").join(r, "vuid", "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def first_match(left: DataFrame, roster: DataFrame) -> DataFrame:
    """The first roster row of each left row's voter, ``Unknown`` without (J-09)."""
    r = first_wins(roster, ["vuid"]).select("vuid", F.col("party").alias("roster_party"))
    return left.join(r, "vuid", "left").withColumn("roster_party", F.coalesce("roster_party", F.lit("Unknown")))


def reason_counts(matched: DataFrame) -> DataFrame:
    """Counts by reason, all and by party (A-19)."""
    return matched.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("roster_party") == "REP", 1)).alias("n_rep"),
        F.count(F.when(F.col("roster_party") == "DEM", 1)).alias("n_dem"),
    )


def updated_party(history: DataFrame, roster: DataFrame) -> DataFrame:
    """History rows with the party of the voter's last roster row where there is one (J-10)."""
    r = last_wins(roster, ["vuid"]).select("vuid", F.col("party").alias("new_party"))
    return history.join(r, "vuid", "left").withColumn("party", F.coalesce("new_party", "party")).drop("new_party")


def multi_vote_flags(groups: DataFrame, members: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """Roster rows per suspect group, and whether they are several (J-11, A-18)."""
    votes = roster.groupBy("vuid").agg(F.count(F.lit(1)).alias("n"))
    people = members.select(*keys, "vuid").distinct().join(groups.select(*keys, "group_no"), keys)
    return people.join(votes, "vuid", "left").groupBy("group_no").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_votes"),
        F.coalesce(F.sum("n") > 1, F.lit(False)).alias("several"),
    )


def report(df: DataFrame, sections: dict[str, str]) -> DataFrame:
    """Counts by each of several columns and in all, as rows of section, label and n: one pass, no printing (K-16)."""
    pairs = [F.struct(F.lit(name).alias("section"), F.col(c).cast("string").alias("label")) for name, c in sections.items()]
    total = F.struct(F.lit("total").alias("section"), F.lit("rows").alias("label"))
    return df.select(F.explode(F.array(*pairs, total)).alias("x")).groupBy("x.section", "x.label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(roster: DataFrame) -> DataFrame:
    return roster.groupBy("ballot_type").agg(F.count(F.lit(1)).alias("n"))


def type_party_counts(roster: DataFrame) -> DataFrame:
    """Counts by ballot type with the party split; all but REP count as DEM (A-02), and a total row."""
    side = F.when(F.col("party") == "REP", "REP").otherwise("DEM")
    return roster.rollup("ballot_type", side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def party_counts(registration: DataFrame) -> DataFrame:
    """REP, DEM, blank and other, duplicates included (A-28)."""
    p = F.coalesce(F.col("party"), F.lit(""))
    n = lambda c: F.count(F.when(c, 1))
    return registration.agg(
        n(p == "REP").alias("rep"), n(p == "DEM").alias("dem"), n(p == "").alias("blank"), n(~p.isin("REP", "DEM", "")).alias("other")
    )


def district_counts(roster: DataFrame, registration: DataFrame, district: str) -> DataFrame:
    """Roster rows of one district by ballot type (A-29)."""
    reg = first_wins(registration, ["vuid"]).filter(F.col("district") == district).select("vuid")
    return roster.join(reg, "vuid", "left_semi").groupBy("ballot_type").agg(F.count(F.lit(1)).alias("n"))
