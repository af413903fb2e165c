"""Joins with what an explode makes: Spark sizes it by its input, so no side may be broadcast for that size."""

import re

import pytest
from pyspark.sql import functions as F

from quern.llm import similar, simhash


def plans_of(module, monkeypatch):
    """Optimized plans of what a module materialises, by name."""
    seen, settle = {}, module.materialise

    def spied(df, name="step"):
        seen.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df, name)

    monkeypatch.setattr(module, "materialise", spied)
    return seen


@pytest.mark.parametrize("hot", [200, 1])
def test_simhash_links_are_not_broadcast(spark, tmp_path, hot):
    fps = [(a * 0x9E3779B97F4A7C15 % (1 << 63)) ^ bit for a in range(300) for bit in (0, 1, 6)]
    spark.createDataFrame([(x,) for x in fps], "fp long").write.parquet(f"{tmp_path}/fps")
    links = simhash.link(spark.read.parquet(f"{tmp_path}/fps"), hot=hot)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"Join (Inner|LeftSemi)", x) and re.search(r"bit_count|part#", x)]
    assert joins and all("strategy=merge" in x for x in joins)
    assert {frozenset((r.a, r.b)) for r in links.collect()} >= {frozenset((x, x ^ 1)) for x in fps[::3]}


@pytest.mark.parametrize("module, rule", [(simhash, simhash.simhash_dedup), (similar, similar.similar_components)])
def test_salted_roots_are_not_broadcast(spark, monkeypatch, module, rule):
    seen = plans_of(module, monkeypatch)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), F.lit(40)), (F.col("id") % 20).cast("string")).alias("text"))
    assert rule(docs).count() == 60
    joins = [x for x in seen["components"][0].splitlines() if re.search(r"Join .*salt#", x)]
    assert joins and all("strategy=merge" in x for x in joins)
