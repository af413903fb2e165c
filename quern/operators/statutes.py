"""Amendments of statutes, and lookups of sections by references: maps (old_act, old_section, new_act, new_section)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_directions(maps: DataFrame) -> DataFrame:
    """(act, section, to_act, to_section, direction): each mapping from the old section to the new one, ``forward``, and back."""
    one = maps.select(F.col("old_act").alias("act"), F.col("old_section").alias("section"), F.col("new_act").alias("to_act"), F.col("new_section").alias("to_section"), F.lit("forward").alias("direction"))
    back = maps.select(F.col("new_act").alias("act"), F.col("new_section").alias("section"), F.col("old_act").alias("to_act"), F.col("old_section").alias("to_section"), F.lit("back").alias("direction"))
    return one.unionByName(back)


def amendment_lookup(maps: DataFrame) -> DataFrame:
    """(act, section, direction, targets): all sections that one became, or came from, as sorted ``act section`` texts."""
    return both_directions(maps).groupBy("act", "section", "direction").agg(F.sort_array(F.collect_set(F.concat_ws(" ", "to_act", "to_section"))).alias("targets"))


def replacement_fields(statutes: DataFrame, maps: DataFrame) -> DataFrame:
    """statutes(act, section, ..) with ``replaced_by`` and ``replaces``, comma-separated; empty where there is nothing."""
    found = amendment_lookup(maps)
    joined = statutes
    for name, direction in (("replaced_by", "forward"), ("replaces", "back")):
        own = found.where(F.col("direction") == direction).select("act", "section", F.array_join("targets", ", ").alias(name))
        joined = joined.join(own, ["act", "section"], "left").withColumn(name, F.coalesce(name, F.lit("")))
    return joined


def expand_references(refs: DataFrame, maps: DataFrame) -> DataFrame:
    """refs(act, section) and what they became or came from, each once."""
    other = refs.join(both_directions(maps), ["act", "section"]).select(F.col("to_act").alias("act"), F.col("to_section").alias("section"))
    return refs.select("act", "section").unionByName(other).distinct()


def find_sections(statutes: DataFrame, refs: DataFrame) -> DataFrame:
    """Sections of statutes(act, name, section, text, replaced_by) for refs(act, section): the act's code alike whatever its case, or its name holds the reference.

    Both ways of matching are joins on the section, which is the selective part,
    so no pair of unrelated rows is looked at. Each section comes once, with the
    text of what replaced it, if that is among the statutes.
    """
    asked = refs.select(F.lower("act").alias("asked"), F.lower(F.trim("section")).alias("of")).distinct()
    fits = (F.lower("act") == F.col("asked")) | F.contains(F.lower("name"), F.col("asked"))
    found = statutes.join(asked, (F.lower(F.trim("section")) == F.col("of")) & fits, "left_semi").dropDuplicates(["act", "section"])
    parts = F.split("replaced_by", " (?=[^ ]+$)")
    later = statutes.select(F.col("act").alias("later_act"), F.col("section").alias("later_section"), F.col("text").alias("replacement")).dropDuplicates(["later_act", "later_section"])
    return found.join(later, (F.get(parts, F.lit(0)) == F.col("later_act")) & (F.get(parts, F.lit(1)) == F.col("later_section")), "left").select("act", "section", "text", "replaced_by", "replacement")


def first_by_order(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key, by aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
