"""Registered addresses against property addresses, exact first and looser step by step (J-14).

Both sides are exploded to keys (at most 16 a voter, 20 a property) and meet in one equi-join; the best key of a
voter is a minimum, not a search. Keys carry their level, so a level with unit meets only its like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import compose_street, house_number, let, normalize_street, residential, street_variants, unit
from ..functions.text import field, zip5
from .dedup import folded, prefer

#: Levels in the order in which they are tried.
LEVELS = ["num_street_unit_zip", "num_street_zip", "num_street_unit", "num_street"]


def _keys(number: Column, forms: Column, unit_text: Column, zip_code: Column) -> Column:
    """Array of (variant, level_no, label, key) for the forms of a street; levels without their parts are left out.

    ``number``, ``unit_text`` and ``zip_code`` are normalised already; the forms are normalised once more.
    """

    def of(form: Column, i: Column) -> Column:
        def keys(st: Column) -> Column:
            made = [
                F.when((unit_text != "") & (zip_code != ""), F.concat_ws(" ", number, st, unit_text, zip_code)),
                F.when(zip_code != "", F.concat_ws(" ", number, st, zip_code)),
                F.when(unit_text != "", F.concat_ws(" ", number, st, unit_text)),
                F.concat_ws(" ", number, st),
            ]
            levels = F.array(*[
                F.struct(i.alias("variant"), F.lit(k).alias("level_no"), F.concat(F.lit(LEVELS[k]), form["label"]).alias("label"), key.alias("key"))
                for k, key in enumerate(made)
            ])
            return F.filter(levels, lambda x: x["key"].isNotNull() & (st != "") & (number != ""))

        return let(normalize_street(form["street"]), keys)

    return F.flatten(F.transform(forms, of))


def property_keys(properties: DataFrame) -> DataFrame:
    """(level_no, key, prop columns): one property per key, residential ones first, then the earliest (W-04, D19)."""
    rows = (
        properties.withColumn("__base", compose_street("prefix", "street", "suffix"))
        .withColumn("__bare", compose_street("prefix", "street", F.lit("")))
        .withColumn("__number", house_number("number")).withColumn("__unit", unit("unit")).withColumn("__zip", zip5("zip"))
        .withColumn("is_residential", residential("state_codes", "type_desc"))
    )
    other = F.when((F.col("__bare") != F.col("__base")) & (F.col("__bare") != ""), F.array(F.struct(F.col("__bare").alias("street"), F.lit("").alias("label")))).otherwise(F.array())
    rows = rows.withColumn("__forms", F.concat(street_variants("__base", True), other))
    rows = rows.withColumn("k", F.explode(_keys(F.col("__number"), F.col("__forms"), F.col("__unit"), F.col("__zip"))))
    rows = rows.select(
        F.col("k.level_no").alias("level_no"), F.col("k.key").alias("key"), "prop_id", "type_desc", "state_codes", "ord", "is_residential",
    )
    return prefer(rows, ["level_no", "key"], F.col("is_residential"))


def match_properties(voters: DataFrame, properties: DataFrame) -> DataFrame:
    """Each voter with a non-confidential address and the property of its first key that has one (J-14, W-05).

    Columns: vuid, prop_id, level, is_residential, type_desc, state_codes; null where no key has one.
    """
    open_rows = voters.filter(~F.col("confidential"))
    ready = open_rows.select(
        "vuid", street_variants("street").alias("forms"), house_number("number").alias("number"), unit("unit").alias("unit"), zip5("zip").alias("zip")
    )
    keys = ready.select("vuid", F.explode(_keys(F.col("number"), F.col("forms"), F.col("unit"), F.col("zip"))).alias("k")).select(
        "vuid", F.col("k.level_no").alias("level_no"), F.col("k.key").alias("key"),
        (F.col("k.variant") * 4 + F.col("k.level_no")).alias("rank"), F.col("k.label").alias("level"),
    )
    hits = keys.join(property_keys(properties), ["level_no", "key"])
    best = hits.groupBy("vuid").agg(
        F.min_by(F.struct("prop_id", "level", "is_residential", "type_desc", "state_codes"), "rank").alias("m")
    )
    return open_rows.select("vuid").join(best, "vuid", "left").select("vuid", "m.*")


def level_counts(matches: DataFrame) -> DataFrame:
    """Matched voters per level (A-24, O-07)."""
    return matches.filter("prop_id is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def nonresidential(matches: DataFrame) -> DataFrame:
    """Matches that are not residential, blank descriptions last (P-13, O-05)."""
    rows = matches.filter("prop_id is not null and not is_residential")
    return rows.orderBy(F.when(F.trim(F.col("type_desc")) == "", 1).otherwise(0), F.upper("type_desc"), "vuid")


def description_counts(matches: DataFrame, label: str = "(blank)") -> DataFrame:
    """Non-residential matches by description and state code (A-23)."""
    name = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(label)).alias(c)
    return nonresidential(matches).groupBy(name("type_desc"), name("state_codes")).agg(F.count(F.lit(1)).alias("n"))


def with_improvements(properties: DataFrame, improvements: DataFrame) -> DataFrame:
    """Properties with their improvements folded into ``;`` lists (J-12, A-20)."""
    return properties.join(folded(improvements, "prop_id", ["type_cd", "type_desc", "state_cd"]), "prop_id", "left")


def type_counts(improvements: DataFrame) -> DataFrame:
    """Properties per improvement triple, most first (A-21, O-04)."""
    each = improvements.select("prop_id", "type_cd", "type_desc", "state_cd").distinct()
    return each.groupBy("type_cd", "type_desc", "state_cd").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type_cd", "type_desc", "state_cd")


def state_code_conflicts(improvements: DataFrame) -> DataFrame:
    """Type codes and descriptions with several state codes (A-22)."""
    return improvements.groupBy("type_cd", "type_desc").agg(F.countDistinct("state_cd").alias("n_codes")).filter("n_codes > 1")


def back_filled_city(city: Column, number: Column, prefix: Column, street: Column, suffix: Column, owners: list[tuple[list[Column], Column]]) -> Column:
    """A blank situs city from the first owner layout whose address lines hold the situs street, with or without
    its house number (F-34)."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.upper(field(c)), "[^A-Z0-9 ]", " "), " +", " "))
    parts = [field(x) for x in (number, prefix, street, suffix)]
    key = clean(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))
    bare = F.regexp_replace(key, "^[0-9]+ ", "")
    out = F.when(field(city) != "", field(city))
    for lines, town in owners:
        hit = F.exists(F.array(*[clean(x) for x in lines]), lambda x: (x != "") & (F.contains(x, key) | F.contains(x, bare)))
        out = out.when((key != "") & (field(town) != "") & hit, field(town))
    return out.otherwise(F.lit(""))
