"""Joins: enrichment, cascades of lookups, as-of and interval lookups, referential checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window


def count_children(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Parents with their number of children, 0 for none; children are counted before the join, so nothing fans out."""
    counted = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def scalar_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # of one-row tables
    return out


def enrich(ranked: DataFrame, details: DataFrame, key: str, keep_unmatched: bool = False) -> DataFrame:
    """Ranked rows with the columns of ``details``; rows without details go unless kept."""
    return ranked.join(details, key, "left" if keep_unmatched else "inner")


def fill_missing(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of ``left`` that are null or blank are filled from ``right``."""
    r = right.select(key, *[F.col(c).alias(f"quern_{c}") for c in columns])
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return left.join(r, key, "left").select(*[F.when(empty(c), F.col(f"quern_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns])


def cascade(rows: DataFrame, text: Column, lookups: Sequence[tuple[DataFrame, Column]]) -> DataFrame:
    """rows with ``target`` and ``tier``: the id that the first lookup (key, id) with the row's key gives, keys tried in turn.

    Each lookup names the column made from ``text`` under which it is asked. Only
    one equality join per lookup is made; of repeated keys the largest id counts.
    """
    out = rows
    for n, (lookup, key) in enumerate(lookups):
        one = lookup.groupBy("key").agg(F.max("id").alias(f"id{n}")).withColumnRenamed("key", f"key{n}")
        out = out.withColumn(f"ask{n}", key).join(one, F.col(f"ask{n}") == F.col(f"key{n}"), "left").drop(f"ask{n}", f"key{n}")
    ids = [f"id{n}" for n in range(len(lookups))]
    tier = F.lit(0)
    for n in reversed(range(len(lookups))):
        tier = F.when(F.col(f"id{n}").isNotNull(), n + 1).otherwise(tier)
    return out.withColumn("target", F.coalesce(*ids)).withColumn("tier", tier).drop(*ids)


def stab(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, key: str, width: int) -> DataFrame:
    """Each point with the span start <= point < end of the same key, if any.

    Spans are listed in the grid cells of ``width`` that they touch and points
    meet only spans of their own cell, so the join is one of equality.
    """
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    asked = points.withColumn("cell", F.floor(F.col(point) / width))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    return asked.alias("p").join(cells.alias("s"), [F.col(f"p.{key}") == F.col(f"s.{key}"), F.col("p.cell") == F.col("s.cell"), inside], "left").drop(F.col("s.cell")).drop(F.col(f"s.{key}")).drop("cell")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, bucket: int = 30 * 86_400) -> DataFrame:
    """left(key, at, ..) with the last ``value`` of ``right``(key, at, value) at or before each row's time.

    Time is cut into buckets of ``bucket`` seconds, and both sides go through one
    window per key and bucket, right rows before left rows of the same time; what
    a bucket starts with is the last value of the buckets before, found over one
    row a bucket. So a frequent key's rows are dealt over its buckets.
    """
    number = F.col(at) if isinstance(left.schema[at].dataType, NumericType) else F.col(at).cast("timestamp").cast("long")
    step = F.floor(number / bucket)
    both = left.withColumn("quern_side", F.lit(1)).unionByName(right.select(key, at, F.col(value).alias("quern_value")).withColumn("quern_side", F.lit(0)), allowMissingColumns=True).withColumn("quern_step", step)
    lasts = both.where("quern_value IS NOT NULL").groupBy(key, "quern_step").agg(F.max_by("quern_value", F.struct(at)).alias("own"))
    steps = both.select(key, "quern_step").distinct().join(lasts, [key, "quern_step"], "left")
    earlier = Window.partitionBy(key).orderBy("quern_step").rowsBetween(Window.unboundedPreceding, -1)
    begins = steps.select(key, "quern_step", F.last("own", ignorenulls=True).over(earlier).alias("quern_before"))
    within = Window.partitionBy(key, "quern_step").orderBy(at, "quern_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("quern_own", F.last("quern_value", ignorenulls=True).over(within)).where("quern_side = 1").join(begins, [key, "quern_step"], "left")
    return found.select(*left.columns, F.coalesce("quern_own", "quern_before").alias(value))


def newest_per_key(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("quern_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("quern_n") <= n).drop("quern_n")


def not_among(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def first_by_source(rows: DataFrame, key: str, rank: Sequence[Column]) -> DataFrame:
    """One row a key, that of the best source; by aggregation, so that a frequent key needs no sort of its rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("r")).select(key, "r.*")
