"""Contest tallies, machines, tapes and styles. Ballots come in long form: one row per selection.

Columns: ballot, ord, contest, vote_for, selection, status (Counted, Overvoted, Undervoted), machine, place,
barcoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["Counted", "Overvoted", "Undervoted"]


def valid_selections(rows: DataFrame) -> DataFrame:
    """A ballot's selections up to its first invalid status (P-10)."""
    bad = rows.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).groupBy("ballot").agg(F.min("ord").alias("__bad"))
    return rows.join(bad, "ballot", "left").filter(F.col("__bad").isNull() | (F.col("ord") < F.col("__bad"))).drop("__bad")


def tally_single(rows: DataFrame) -> DataFrame:
    """Counts by contest and selection; over- and undervotes count one each per contest of a ballot (A-03)."""
    name = F.when(F.col("status") == "Overvoted", "Overvote").when(F.col("status") == "Undervoted", "Undervote").otherwise(F.col("selection"))
    one = rows.groupBy("ballot", "contest").agg(F.min_by(F.struct(name.alias("selection")), "ord").alias("s"))
    counts = one.groupBy("contest", F.col("s.selection").alias("selection")).agg(F.count(F.lit(1)).alias("n"))
    return _with_buckets(counts, rows)


def tally_multi(rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """Counts by contest and selection; an overvoted contest counts its vote-for once per ballot, each undervoted
    selection one (A-04; with ``condition`` A-05)."""
    if condition is not None:
        rows = rows.filter(condition)
    counted = rows.filter("status = 'Counted'").groupBy("contest", "selection").agg(F.count(F.lit(1)).alias("n"))
    over = (
        rows.filter("status = 'Overvoted'").groupBy("ballot", "contest").agg(F.max("vote_for").alias("v"))
        .groupBy("contest").agg(F.sum("v").alias("n")).select("contest", F.lit("Overvote").alias("selection"), "n")
    )
    under = rows.filter("status = 'Undervoted'").groupBy("contest").agg(F.count(F.lit(1)).alias("n")).select(
        "contest", F.lit("Undervote").alias("selection"), "n"
    )
    return _with_buckets(counted.unionByName(over).unionByName(under), rows)


def _with_buckets(counts: DataFrame, rows: DataFrame) -> DataFrame:
    zero = rows.select("contest").distinct().select(
        "contest", F.explode(F.array(F.lit("Overvote"), F.lit("Undervote"))).alias("selection"), F.lit(0).cast("long").alias("n")
    )
    return counts.unionByName(zero).groupBy("contest", "selection").agg(F.sum("n").alias("n"))


def zero_filled(master: DataFrame, counts: DataFrame) -> DataFrame:
    """Every master selection with its count or 0 (A-13)."""
    return master.select("contest", "selection").distinct().join(counts, ["contest", "selection"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def contest_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("contest").agg(F.sum("n").alias("total"))


def barcode_frequency(ballots: DataFrame) -> DataFrame:
    """Occurrences of each barcode (A-06)."""
    return ballots.select(F.explode("barcodes").alias("barcode")).groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))


def machine_class(machine: Column) -> Column:
    """The scanner family of a machine name (P-14)."""
    return F.when(machine.rlike("(?i)ds200"), "DS200").when(machine.rlike("(?i)expresstouch"), "ExpressTouch").otherwise("Central")


def machine_counts(rows: DataFrame) -> DataFrame:
    """Ballots per machine, with the first place seen (A-07)."""
    return rows.groupBy("machine").agg(F.countDistinct("ballot").alias("n_ballots"), F.min_by("place", "ord").alias("place"))


def machine_pivot(rows: DataFrame, keywords: list[str], mode: str = "sum") -> DataFrame:
    """Counted votes per machine and keyword of the selection's name (A-08).

    ``sum`` adds all selections that match; ``last`` takes the one that is seen last first.
    """
    each = rows.filter("status = 'Counted'").groupBy("machine", "selection").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    out = []
    for k in keywords:
        hit = F.col("selection").rlike("(?i)" + k)
        value = F.sum(F.when(hit, F.col("n"))) if mode == "sum" else F.max_by("n", F.when(hit, F.col("ord")))
        out.append(F.coalesce(value, F.lit(0)).alias(k))
    return each.groupBy("machine").agg(*out)


def tape_totals(tapes: DataFrame, counts: list[str]) -> DataFrame:
    """The greatest of a tape's counters, missing as 0 (A-09, P-18)."""
    zero = [F.coalesce(F.col(c), F.lit(0)) for c in counts]
    return tapes.withColumn("total", F.greatest(*zero))


def share_comparison(rows: DataFrame, in_batch: Column) -> DataFrame:
    """Counts and percents of each selection in a batch and outside it, in one pass (J-16, A-11, P-11)."""
    each = rows.filter("status = 'Counted'").groupBy("contest", "selection").agg(
        F.count(F.when(in_batch, 1)).alias("n_batch"), F.count(F.when(~in_batch, 1)).alias("n_rest")
    )
    total = each.groupBy("contest").agg(F.sum("n_batch").alias("t_batch"), F.sum("n_rest").alias("t_rest"))
    pct = lambda n, t: F.when(F.col(t) > 0, F.bround(F.col(n) / F.col(t) * 100, 6)).otherwise(F.lit(0.0))
    return each.join(total, "contest").select(
        "contest", "selection", "n_batch", "n_rest", pct("n_batch", "t_batch").alias("pct_batch"), pct("n_rest", "t_rest").alias("pct_rest")
    )


def decoded(ballots: DataFrame, styles: DataFrame) -> DataFrame:
    """Ballot barcodes as contest and selection, null where the style has no such barcode (J-15)."""
    long = ballots.select("ballot", "style", F.explode("barcodes").alias("barcode"))
    return long.join(styles.select("style", "barcode", "contest", "selection"), ["style", "barcode"], "left")


def style_undervotes(ballots: DataFrame, styles: DataFrame) -> DataFrame:
    """Contests of a ballot's style without a selection, per contest; ballots of unknown style are left out (A-12)."""
    due = ballots.select("ballot", "style").join(styles.select("style", "contest").distinct(), "style")
    done = decoded(ballots, styles).filter("contest is not null").select("ballot", "contest")
    return due.join(done, ["ballot", "contest"], "left_anti").groupBy("contest").agg(F.count(F.lit(1)).alias("n_undervotes"))


def not_in_master(styles: DataFrame, master: DataFrame) -> DataFrame:
    """Detail selections that the master list has not (J-17)."""
    return styles.select("contest", "selection").distinct().join(master, ["contest", "selection"], "left_anti")


def counted_per_ballot(nested: DataFrame) -> DataFrame:
    """Counted selections of ballots with nested contests (A-31)."""
    n = F.aggregate(
        "contests", F.lit(0),
        lambda a, c: a + F.size(F.filter(c["selections"], lambda s: s["status"] == "Counted")),
    )
    return nested.select("ballot", n.alias("n_counted"))
