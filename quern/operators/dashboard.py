"""Views of a citation graph: leading, rising and doubted cases, communities, topics, a case's evolution and neighbours.

``nodes`` has a row per case: id, year, community, tags (array), bench, disposal,
reportable, cited_by, rank, ratio (share of recent citers); ``edges`` are
(src, dst, treatment). Everything is a filter, one aggregation and a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import k_hop, undirected
from quern.storage import settle

#: Treatments that count as negative, the least share of recent citers and the least citers of a rising case.
NEGATIVE = ("overruled", "not_followed", "per_incuriam", "distinguished")
RISING_SHARE, RISING_CITERS = 0.4, 5


def select_nodes(nodes: DataFrame, *, community: str | None = None, topic: str | None = None, section: str | None = None, sections: DataFrame | None = None, bench: str | None = None, disposal: str | None = None, years: tuple[int | None, int | None] = (None, None), reportable: bool | None = None) -> DataFrame:
    """The nodes that fit all filters given; ``section`` asks ``sections``(id, section) for a row."""
    asked: list[Column] = [F.col(c) == v for c, v in (("community", community), ("bench", bench), ("disposal", disposal), ("reportable", reportable)) if v is not None]
    if topic is not None:
        # A tag list is searched as text, so part of a tag will do.
        asked.append(F.contains(F.array_join("tags", ","), F.lit(topic)))
    first, last = years
    asked += [F.col("year") >= first] if first is not None else []
    asked += [F.col("year") <= last] if last is not None else []
    for condition in asked:
        nodes = nodes.where(condition)
    return nodes if section is None else nodes.join(sections.where(F.col("section") == section).select("id"), "id", "left_semi")


def most_cited(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.where("rank IS NOT NULL").orderBy(F.desc("rank"), "id").limit(limit)


def rising_cases(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.where((F.col("ratio") >= RISING_SHARE) & (F.col("cited_by") >= RISING_CITERS)).orderBy(F.desc("ratio"), F.desc("cited_by"), "id").limit(limit)


def recently_negative(edges: DataFrame, nodes: DataFrame, years: DataFrame, limit: int = 10) -> DataFrame:
    """(id, treatment, by, by_year) of the latest negative citations of ``nodes``; ``years``(id, year) are of all cases."""
    bad = edges.where(F.col("treatment").isin(*NEGATIVE)).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    dated = bad.join(years.select(F.col("id").alias("src"), F.col("year").alias("by_year")), "src")
    return dated.orderBy(F.desc("by_year"), "dst", "src", "treatment").limit(limit).select(F.col("dst").alias("id"), "treatment", F.col("src").alias("by"), "by_year")


def community_rollup(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """(label, members, communities): the largest labels with their number of cases and of different communities."""
    known = nodes.where("community_id IS NOT NULL")
    return known.groupBy("label").agg(F.count("*").alias("members"), F.count_distinct("community_id").alias("communities")).orderBy(F.desc("members"), "label").limit(limit)


def large_communities(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Nodes of communities with ``least`` members or more."""
    kept = nodes.groupBy("community").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return nodes.join(kept, "community")


def topic_counts(nodes: DataFrame, topics: str = "tags", category: str | None = None, limit: int = 50) -> DataFrame:
    """(topic, n): the most frequent topics, of one category (the part before ``:``) if named."""
    said = nodes.select("id", F.explode(F.array_distinct(topics)).alias("topic"))
    if category is not None:
        said = said.where(F.substring_index("topic", ":", 1) == category)
    return said.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(limit)


def evolution(edges: DataFrame, nodes: DataFrame, seed, forward: bool = True, limit: int = 50) -> DataFrame:
    """(id, year, treatment): the cases that cite a case (or that it cites), the oldest first."""
    here, there = ("dst", "src") if forward else ("src", "dst")
    near = edges.where(F.col(here) == seed).select(F.col(there).alias("id"), "treatment").join(nodes.select("id", "year"), "id")
    return near.orderBy(F.asc_nulls_last("year"), "id", "treatment").limit(limit).select("id", "year", "treatment")


def typed_neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1, kinds: Sequence[str] | None = None, direction: str = "both") -> DataFrame:
    """(seed, node, depth): what lies within ``depth`` steps over edges of some treatments, ``out``, ``in`` or ``both`` ways."""
    steps = edges if kinds is None else edges.where(F.col("treatment").isin(*kinds))
    steps = steps.select("src", "dst") if direction == "out" else steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if direction == "in" else undirected(steps)
    return k_hop(steps, seeds, depth, both_ways=False).where("depth > 0")


def equivalents(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of equivalent citations as edges both ways, each once, none to itself."""
    return undirected(pairs.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def class_links(rows: DataFrame, key: str, of: Sequence[str]) -> DataFrame:
    """rows(key, of) as edges both ways between all keys that share a class, the columns ``of``, each once, none to itself.

    Only two keys that both are in several classes can meet twice, so only their
    edges are compared; the rest, which is the square of each class, goes out as it
    is joined. Rows with a null key or a null in ``of`` have no edges.
    """
    known = settle(rows.select(F.col(key).alias("key"), *of).dropna().distinct(), "class-members")
    # No window: a key has a row a class, and a class may hold most keys.
    several = known.groupBy("key").agg((F.count("*") > 1).alias("several"))
    known = settle(known.join(several, "key"), "class-keys")
    a, b = (known.select(F.col("key").alias(n), *of, F.col("several").alias(f"{n}_several")) for n in ("src", "dst"))
    met = a.join(b.hint("merge"), list(of)).where("src <> dst")
    twice = F.col("src_several") & F.col("dst_several")
    once = met.where(~twice).select("src", "dst")
    if not known.where("several").take(1):
        return once
    return once.unionByName(met.where(twice).select("src", "dst").distinct())


def attribute_nodes(rows: DataFrame, key: str, attributes: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, name, cases) and edges (id, name) of what an array column names."""
    edges = rows.select(F.col(key).alias("id"), F.explode(attributes).alias("name")).where("name IS NOT NULL AND trim(name) <> ''").distinct()
    return edges.groupBy("name").agg(F.count("*").alias("cases")).select(F.lit(kind).alias("kind"), "name", "cases"), edges


def seeded_expansion(edges: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """(node, via, cited_by): what seeds(seed) cite, and what that cites, most cited first. ``via`` counts the steps."""
    near = k_hop(edges, seeds, 2, both_ways=False).where("depth > 0").groupBy("node").agg(F.min("depth").alias("via"))
    cited = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("cited_by"))
    return near.join(cited, "node").orderBy(F.desc("cited_by"), "node").limit(limit)


def community_retrieval(near: DataFrame, hits: DataFrame, members: DataFrame, by_meaning: int = 5, by_overlap: int = 3) -> DataFrame:
    """(community, reason): communities whose summaries are nearest, near(community, score), and those with most of hits(id) among members(id, community)."""
    first = near.orderBy(F.desc("score"), "community").limit(by_meaning).select("community", F.lit("meaning").alias("reason"))
    most = hits.join(members, "id").groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(by_overlap).select("community", F.lit("overlap").alias("reason"))
    return first.unionByName(most).groupBy("community").agg(F.array_join(F.sort_array(F.collect_set("reason")), "+").alias("reason"))


def graph_fields(rows: DataFrame, short: Sequence[str] = (), long: Sequence[str] = (), lists: Sequence[str] = (), key: str = "id") -> DataFrame:
    """Rows as node properties: texts cut to 200 or 500 characters, missing ones empty, lists as comma-separated text."""
    cut = [F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n).alias(c) for columns, n in ((short, 200), (long, 500)) for c in columns]
    return rows.select(key, *cut, *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in lists])
