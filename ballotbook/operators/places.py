"""Polling places and precinct changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field, normalize_text, percent
from .dedup import first_association


def with_period(checkins: DataFrame) -> DataFrame:
    """Adds provisional (any flag but ``n``) and period, EV or ED by the code's first letters, else blank (P-09)."""
    period = F.upper(F.substring(F.trim("code"), 1, 2))
    return checkins.withColumn("provisional", ~F.lower(field("flag")).eqNullSafe(F.lit("n"))).withColumn(
        "period", F.when(period.isin("ED", "EV"), period).otherwise(F.lit(""))
    )


def site_summary(checkins: DataFrame) -> DataFrame:
    """Voters and precincts, regular and provisional, per site and period (A-14, A-16, P-15)."""
    early = F.col("period") == "EV"
    prov = F.col("provisional")
    count = lambda c: F.count(F.when(c, 1))
    distinct = lambda c: F.countDistinct(F.when(c, F.col("precinct")))
    return checkins.groupBy("location", early.alias("early")).agg(
        count(~prov).alias("voters"), count(prov).alias("prov_voters"),
        distinct(~prov).alias("precincts"), distinct(prov).alias("prov_precincts"),
    )


def singletons(checkins: DataFrame) -> DataFrame:
    """Site, party, precinct and period groups of one voter, counted per site and period (A-15)."""
    one = checkins.groupBy("location", "party", "precinct", "period").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return one.groupBy("location", "period").agg(F.count(F.lit(1)).alias("n_singletons"))


def precinct_districts(registration: DataFrame) -> DataFrame:
    """Each precinct's first district and how many it was seen in (W-12, J-18, V-14)."""
    return first_association(registration.filter("precinct != '' and district != ''"), "precinct", "district")


def precinct_addresses(registration: DataFrame) -> DataFrame:
    """Registrations per precinct and address (A-25)."""
    return registration.filter("precinct != '' and address != ''").groupBy("precinct", "address").agg(F.count(F.lit(1)).alias("n"))


def migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """Voters from each old precinct to each new one, null where the address is unmapped (J-13, A-26)."""
    where = first_association(
        new.filter("precinct != '' and address != ''").select(normalize_text("address").alias("key"), F.col("precinct").alias("new_precinct"), "ord"),
        "key", "new_precinct",
    ).drop("n_values")
    return (
        precinct_addresses(old).withColumn("key", normalize_text("address")).join(where, "key", "left")
        .groupBy(F.col("precinct").alias("old_precinct"), "new_precinct").agg(F.sum("n").alias("n"))
    )


def migration_shares(moved: DataFrame) -> DataFrame:
    """Each move as percent of the old precinct, one decimal, half to even (A-27)."""
    total = moved.groupBy("old_precinct").agg(F.sum("n").alias("total"))
    return moved.join(total, "old_precinct").withColumn("pct", F.bround(percent("n", "total"), 1))


def ranked_destinations(moved: DataFrame) -> DataFrame:
    """The moves with their place among those of the old precinct, most voters first, unmapped ones last (O-06)."""
    order = Window.partitionBy("old_precinct").orderBy(F.desc("n"), F.asc_nulls_last("new_precinct"))
    return moved.withColumn("place", F.row_number().over(order))  # an old precinct has few destinations


def migration_cells(moved: DataFrame) -> DataFrame:
    """The cells of the matrix as text with one decimal and a percent sign (K-05)."""
    cells = migration_shares(moved).filter("new_precinct is not null")
    return cells.select("old_precinct", "new_precinct", F.format_string("%.1f%%", F.col("pct").cast("double")).alias("cell"))


def migration_matrix(moved: DataFrame, old_precincts: list[str]) -> DataFrame:
    """A row per new precinct, a column per old one (A-27, K-05); the columns are given, so none is collected."""
    shares = migration_shares(moved).filter("new_precinct is not null")
    return shares.groupBy("new_precinct").pivot("old_precinct", old_precincts).agg(F.first("pct"))


def topology(moved: DataFrame) -> DataFrame:
    """unchanged, majority_stayed, merged or split per old precinct (F-42), with the unmapped voters."""
    stats = moved.groupBy("old_precinct").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("new_precinct") == F.col("old_precinct"), F.col("n"))), F.lit(0)).alias("stayed"),
        F.count("new_precinct").alias("destinations"),
        F.coalesce(F.sum(F.when(F.col("new_precinct").isNull(), F.col("n"))), F.lit(0)).alias("unmapped"),
    )
    label = (
        F.when(F.col("stayed") == F.col("total"), "unchanged")
        .when(percent("stayed", "total") >= 50, "majority_stayed")
        .when(F.col("destinations") == 1, "merged").otherwise("split")
    )
    return stats.withColumn("label", label)
