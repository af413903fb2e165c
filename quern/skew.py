"""Joins of rows with a table of their groups in which a few groups may hold most rows.

Groups with a 4096th of all rows or more are at most 4096, so their part of the
table is broadcast whatever its input; every other group is small against a
task, so the rest is left to an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups with this share of all rows are joined by broadcast; as many groups as this at most have it.
HOT_SHARE = 4096


def by_shuffle(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that is not to broadcast either side, whatever Spark holds their sizes to be.

    Spark sizes what an explode or a step in Python makes by what goes in, and a
    file by its compressed bytes, so a table of many times the broadcast threshold
    can be taken for one below it and end on the driver.
    """
    return rows.hint("merge")


def _parts(groups: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    hot = F.col("n") * HOT_SHARE >= total
    return F.broadcast(groups.where(hot)), groups.where(~hot)


def join_groups(rows: DataFrame, groups: DataFrame, on: Column, total: int) -> DataFrame:
    """Inner join of ``total`` rows with groups(.., n rows), whose keys are unique."""
    hot, cold = _parts(groups, total)
    return rows.join(hot, on).unionByName(rows.join(cold, on))


def without_groups(rows: DataFrame, groups: DataFrame, on: Column, total: int) -> DataFrame:
    """The rows that have no group."""
    hot, cold = _parts(groups, total)
    return rows.join(hot, on, "left_anti").join(cold, on, "left_anti")
