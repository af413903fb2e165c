"""Precedents for issues: batches of ranked hits into maps with neighbours, overruled flags, strength and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.graph import SEVERE, k_hop


def top_per_issue(hits: DataFrame, most: int = 5) -> DataFrame:
    """hits(issue, case, score) with ``rank``: the best of each issue; a case counts once an issue, by its best score."""
    one = hits.groupBy("issue", "case").agg(F.max("score").alias("score"))
    w = Window.partitionBy("issue").orderBy(F.desc("score"), "case")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def diverse(chunks: DataFrame, per_case: int = 3) -> DataFrame:
    """chunks(case, chunk, score) without more than ``per_case`` of one case, the best ones staying."""
    w = Window.partitionBy("case").orderBy(F.desc("score"), "chunk")
    return chunks.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_case).drop("nth")


def precedent_map(chunks: DataFrame, cases: DataFrame, edges: DataFrame, *, per_case: int = 3, leading: int = 5) -> DataFrame:
    """(case, score, source, overruled, strength, ratio): what a search found, and what lies within two citations of its best cases.

    chunks(case, chunk, score); cases(case, court_rank, ratio), a lower court_rank
    being the higher court; edges(src, dst, treatment). Found cases are ``search``,
    the others ``graph`` with score 0. A case is BINDING from the highest court, else PERSUASIVE, and OVERRULED if a citer says so.
    """
    found = diverse(chunks, per_case).groupBy("case").agg(F.max("score").alias("score"))
    seeds = found.orderBy(F.desc("score"), "case").limit(leading).select(F.col("case").alias("seed"))
    near = k_hop(edges, seeds, 2).where("depth > 0").select(F.col("node").alias("case")).distinct().join(found, "case", "left_anti")
    every = found.select("case", "score", F.lit("search").alias("source")).unionByName(near.select("case", F.lit(0.0).alias("score"), F.lit("graph").alias("source")))
    bad = edges.where(F.col("treatment").isin(*SEVERE)).select(F.col("dst").alias("case")).distinct().withColumn("overruled", F.lit(True))
    rows = every.join(cases, "case").join(bad, "case", "left").withColumn("overruled", F.coalesce("overruled", F.lit(False)))
    strength = F.when(F.col("overruled"), "OVERRULED").when(F.col("court_rank") == 1, "BINDING").otherwise("PERSUASIVE")
    return rows.select("case", "score", "source", "overruled", strength.alias("strength"), "ratio")


def issue_scores(hits: DataFrame, cases: DataFrame, issues: DataFrame, *, issues_most: int = 3, hits_most: int = 5, least_top: int = 3, most: int = 10) -> DataFrame:
    """(issue, score, top_court): of the first issues(issue, ord, score), one more (``most`` at most) where ``least_top`` of their best hits are of the highest court."""
    asked = issues.orderBy("ord").limit(issues_most)
    best = top_per_issue(hits.join(asked.select("issue"), "issue", "left_semi"), hits_most).join(cases.select("case", "court_rank"), "case")
    counted = best.groupBy("issue").agg(F.count_if(F.col("court_rank") == 1).alias("top_court"))
    scored = asked.join(counted, "issue", "left").withColumn("top_court", F.coalesce("top_court", F.lit(0)))
    return scored.select("issue", F.when(F.col("top_court") >= least_top, F.least(F.col("score") + 1, F.lit(most))).otherwise(F.col("score")).alias("score"), "top_court")


def vector_rows(cases: DataFrame, chunks: DataFrame, *, chunk_chars: int = 2000, props_most: int = 25, notes_most: int = 5) -> DataFrame:
    """(id, case, kind, text): what is embedded of a case: chunks of 20 characters or more, propositions, the ratio and headnotes of 30 or more.

    chunks(case, n, text); cases(case, propositions array, ratio, headnotes array). Ids say what a row is: ``case_n``, ``case_prop_n``, ``case_ratio``, ``case_headnote_n``.
    """
    name = lambda *parts: F.concat_ws("_", F.col("case").cast("string"), *parts).alias("id")
    body = chunks.where(F.length(F.trim("text")) >= 20).select(name(F.col("n").cast("string")), "case", F.lit("chunk").alias("kind"), F.substring("text", 1, chunk_chars).alias("text"))

    def listed(column: str, kind: str, most: int) -> DataFrame:
        rows = cases.select("case", F.posexplode(F.slice(column, 1, most)).alias("n", "text")).where(F.length(F.trim("text")) >= 30)
        return rows.select(name(F.lit(kind), F.col("n").cast("string")), "case", F.lit("proposition" if kind == "prop" else kind).alias("kind"), F.substring("text", 1, chunk_chars).alias("text"))

    ratio = cases.where(F.length(F.trim("ratio")) >= 30).select(name(F.lit("ratio")), "case", F.lit("ratio").alias("kind"), F.substring("ratio", 1, chunk_chars).alias("text"))
    return body.unionByName(listed("propositions", "prop", props_most)).unionByName(ratio).unionByName(listed("headnotes", "headnote", notes_most))


def sample_check(rows: DataFrame, vectors: DataFrame, kinds: tuple[str, ...], *, least_confidence: float = 0.5) -> DataFrame:
    """rows(case, title, chunks, confidence) with the faults of each: missing fields, low confidence, kinds of vectors(case, kind) that lack, a wrong number of chunks."""
    found = vectors.groupBy("case").pivot("kind", list(kinds)).count()
    both = rows.join(found, "case", "left")
    n = lambda kind: F.coalesce(F.col(kind), F.lit(0))
    faults = [F.when(F.col("title").isNull() | (F.trim("title") == ""), "no_title"), F.when(F.coalesce("chunks", F.lit(0)) <= 0, "no_chunks"), F.when(F.coalesce("confidence", F.lit(0.0)) < least_confidence, "low_confidence")]
    faults += [F.when(n(kind) == 0, f"no_{kind}") for kind in kinds] + [F.when(n(kinds[0]) != F.coalesce("chunks", F.lit(0)), "chunk_count")]
    return both.select("case", F.array_join(F.array_compact(F.array(*faults)), ",").alias("faults"))


def capacity(limits: dict[str, tuple[DataFrame, int, float, float]]) -> DataFrame:
    """(store, held, status) of {store: (table, most, warn share, fail share)}: a store over a share of what it can hold warns or fails."""
    out = None
    for name, (rows, most, warn, fail) in limits.items():
        held = rows.agg(F.count("*").alias("held"))
        one = held.select(F.lit(name).alias("store"), "held", F.when(F.col("held") > most * fail, "fail").when(F.col("held") > most * warn, "warn").otherwise("pass").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def stage_stats(rows: DataFrame, stage: str, tier: str, conditions: dict) -> DataFrame:
    """(counter, value, n): rows by stage, by tier, and those that fit each named condition, from one aggregation."""
    counted = rows.groupBy(F.coalesce(stage, F.lit("none")).alias("stage"), F.coalesce(tier, F.lit("none")).alias("tier")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"c{k}") for k, c in enumerate(conditions.values())])
    pairs = [F.struct(F.lit("stage").alias("counter"), F.col("stage").alias("value"), F.col("n").alias("n")), F.struct(F.lit("tier").alias("counter"), F.col("tier").alias("value"), F.col("n").alias("n"))]
    pairs += [F.struct(F.lit(name).alias("counter"), F.lit("all").alias("value"), F.col(f"c{k}").alias("n")) for k, name in enumerate(conditions)]
    return counted.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.counter", "p.value").agg(F.sum("p.n").alias("n"))


def source_counts(results: DataFrame, source: str, items: str, read: str) -> DataFrame:
    """(source, results, items, read): results of each source, the sum of their list lengths, and how many were read in full."""
    return results.groupBy(source).agg(F.count("*").alias("results"), F.sum(F.greatest(F.size(items), F.lit(0))).alias("items"), F.count_if(F.col(read)).alias("read"))


def next_bounds(starts: DataFrame, key: str, start: str, total: str) -> DataFrame:
    """Each start with the ``end`` that the next one of its key sets; the last ends at ``total``."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return starts.withColumn("end", F.coalesce(after, F.col(total)))


def as_json(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, json): the rows of each key as one sorted JSON list of objects."""
    return rows.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("json"))
