"""Retrieval: postings and weighted full-text ranking, cosine neighbours, rank fusion, boosts, paging."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.storage import settle

WORD = r"[\p{L}\p{N}]+"
#: Weights of the field classes D, C, B, A.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
#: Fusion strategies: (weight of vectors, weight of words, k).
STRATEGIES = {"keyword_heavy": (1.0, 2.0, 30), "vector_heavy": (2.0, 1.0, 60), "balanced": (1.0, 1.0, 60), "hindi": (2.0, 0.0, 60)}


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(f"({WORD})"), 1)


# English words that searches leave out.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
#: The first step of the English Porter stemmer (plurals, -ed, -ing, -y) as (pattern, replacement), tried in this order on words that END fits.
STEM_STEPS = [
    (r"^(.*ss)es$", "1"), (r"^(..+i)(?:ed|es)$", "1"), (r"^(.ie)[ds]$", "1"), (r"^(.*[aeiouy].*[^su])s$", "1"), (r"^(.*[aeiouy][^aeiouy].*ee)d(?:ly)?$", "1"),
    (r"^(.*[aeiouy].*(?:at|bl|iz))(?:edly|ingly|ed|ing)$", "1e"), *[(rf"^(.*[aeiouy].*{c}){c}(?:edly|ingly|ed|ing)$", "1") for c in "bdfgmnprt"], (r"^([^aeiouy]*[aeiouy][^aeiouywx])(?:edly|ingly|ed|ing)$", "1e"),
    (r"^(.*[aeiouy].*[^e])(?:edly|ed)$", "1"), (r"^(.*[aiouy])(?:edly|ed)$", "1"), (r"^(.*[aeiouy].*)(?:ingly|ing)$", "1"), (r"^(.+[^aeiouy])y$", "1i"),
]
STEM_END = r"(?:s|ed|ing|ly|y)$"


def stem(token: Column) -> Column:
    """An English word without inflection; words without an ending that could be one are left at once."""
    return F.when(token.rlike(STEM_END), reduce(lambda t, s: F.regexp_replace(t, s[0], "$" + s[1]), STEM_STEPS, token)).otherwise(token)


def lexemes(text: Column | str, english: Column | bool = True) -> Column:
    """Words to search by: of English texts stems without stop words, of others the words as they are."""
    words = tokens(text)
    plain = F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), stem)
    return plain if english is True else words if english is False else F.when(english, plain).otherwise(words)


def postings(docs: DataFrame, key: str, fields: Mapping[str, str], english: Column | bool = False) -> DataFrame:
    """(key, term, weight): summed weights of a term's occurrences; fields maps columns to the classes A to D. ``english``: see ``lexemes``."""

    def weighed(column: str, weight: float) -> Column:
        return F.transform(lexemes(F.coalesce(F.col(column), F.lit("")), english), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    parts = F.concat(*[weighed(c, WEIGHTS[k]) for c, k in fields.items()])
    rows = docs.select(key, F.explode(parts).alias("p")).select(key, "p.term", "p.weight")
    # Weights are multiples of a tenth: counted as integers, sums come out alike in any order.
    return rows.groupBy(key, "term").agg((F.sum(F.round(F.col("weight") * 10).cast("long")) / 10).alias("weight"))


def query_lexemes(spark, query: str, english: bool = True) -> list[str]:
    """The lexemes of a search line."""
    return spark.range(1).select(F.array_distinct(lexemes(F.lit(query), english)).alias("w")).first().w


def section_search(sections: DataFrame, key: Sequence[str], text: str, terms: Sequence[str], where: Column | None = None, limit: int = 20, english: Column | bool = True) -> DataFrame:
    """(*key, score, snippet): sections with all terms, by how often they have them; the snippet is the first 500 characters. The filter runs first."""
    rows = sections if where is None else sections.where(where)
    words = lexemes(F.coalesce(F.col(text), F.lit("")), english)
    counted = rows.select(*key, F.substring(text, 1, 500).alias("snippet"), F.array_compact(F.transform(F.filter(words, lambda w: w.isin(*terms)), lambda w: w)).alias("hits"))
    fit = counted.where(F.size(F.array_distinct("hits")) == len(set(terms))) if terms else counted.limit(0)
    return fit.select(*key, F.size("hits").alias("score"), "snippet").orderBy(F.desc("score"), *key).limit(limit)


def merge_by_title(lists: Sequence[DataFrame], title: str) -> DataFrame:
    """Rows of several lists of hits, one for each title, that of the first list which has it; ``list`` counts the lists from 0."""
    every = reduce(DataFrame.unionByName, [df.withColumn("list", F.lit(n)) for n, df in enumerate(lists)])
    rest = [c for c in every.columns if c != title]
    return every.groupBy(F.lower(F.trim(title)).alias("of")).agg(F.min_by(F.struct(title, *rest), F.struct("list", title, *rest)).alias("r")).select("r.*")


def boost_kinds(hits: DataFrame, kind: str, kinds: Sequence[str] = ("proposition", "ratio", "headnote"), factor: float = 1.5) -> DataFrame:
    """Scores of hits on some kinds of vectors times ``factor``."""
    return hits.withColumn("score", F.when(F.col(kind).isin(*kinds), F.col("score") * factor).otherwise(F.col("score")))


def best_snippet(words: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, snippet): that of the word search, else the title, else the chunk of the vector search."""
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    both = words.select(key, "snippet").join(vectors.select(key, "title", "chunk"), key, "full")
    return both.select(key, F.coalesce(filled("snippet"), filled("title"), filled("chunk"), F.lit("")).alias("snippet"))


def parse_query(query: str) -> dict[str, list]:
    """A search line as {must: [[words that may stand for each other]], not: [words], phrases: [texts]}."""
    phrases = [p for p in re.findall(r'"([^"]+)"', query) if p.strip()]
    rest = re.sub(r'"[^"]*"', " ", query).split()
    must: list[list[str]] = []
    no: list[str] = []
    join = False
    for word in rest:
        bare = re.sub(r"[^\w]", "", word.lower())
        if word in ("OR", "or"):
            join = bool(must)
        elif bare and word.startswith("-"):
            no.append(bare)
        elif bare and word != "AND":
            if join:
                must[-1].append(bare)
            else:
                must.append([bare])
            join = False
    return {"must": must, "not": no, "phrases": [p.lower() for p in phrases]}


def matches(text: str, query: str) -> Column:
    """Whether a text fits a search line, over its words."""
    asked, words = parse_query(query), tokens(text)
    parts = [F.lit(True)]
    parts += [F.arrays_overlap(words, F.array(*[F.lit(w) for w in group])) for group in asked["must"]]
    parts += [~F.array_contains(words, w) for w in asked["not"]]
    parts += [F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(re.findall(r'\w+', p))} ")) for p in asked["phrases"]]
    return reduce(lambda a, b: a & b, parts)


def rank_terms(posted: DataFrame, key: str, terms: Sequence[str], limit: int = 20) -> DataFrame:
    """(key, score): the documents with the largest summed weights of the terms; blank queries find nothing."""
    hit = posted.where(F.col("term").isin(*[t.lower() for t in terms]) if terms else F.lit(False))
    return hit.groupBy(key).agg((F.sum(F.round(F.col("weight") * 10).cast("long")) / 10).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def cover_density(docs: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(key, score): over the shortest stretches that hold all terms, the sum of 1 / words of the stretch.

    A ranking of our own that rewards closeness; it makes no claim to equal any
    database's. One fold over the places of the terms: each hit ends the stretch
    that begins at the earliest of the terms' last places, and counts if no shorter one began there.
    """
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    listed = F.array(*map(F.lit, wanted))
    words = tokens(text)
    places = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(listed, w).cast("int").alias("term"), i.alias("at"))), lambda x: x["term"] > 0)
    hits = docs.where(F.size(F.array_intersect(words, listed)) == len(wanted)).select(key, places.alias("places"))
    nothing = F.struct(F.array(*[F.lit(-1)] * len(wanted)).alias("last"), F.lit(-1).alias("began"), F.lit(0.0).cast("double").alias("score"))

    def step(a: Column, x: Column) -> Column:
        last = F.transform(a["last"], lambda at, i: F.when(i == x["term"] - 1, x["at"]).otherwise(at))
        began = F.array_min(last)
        counts = (began >= 0) & (began != a["began"])
        return F.struct(last.alias("last"), F.when(counts, began).otherwise(a["began"]).alias("began"), (a["score"] + F.when(counts, F.lit(1.0) / (x["at"] - began + 1)).otherwise(0.0)).alias("score"))

    return hits.select(key, F.round(F.aggregate("places", nothing, step, lambda a: a["score"]), 9).alias("score"))


def headline(text: Column | str, terms: Sequence[str], before: int = 20, after: int = 30) -> Column:
    """The words around the first hit with hits between ``**``; the first 500 characters where there is none."""
    text = F.col(text) if isinstance(text, str) else text
    any_of = "|".join(re.escape(t) for t in terms)
    cut = F.regexp_extract(text, rf"(?is)((?:\S+\s+){{0,{before}}}\b(?:{any_of})\b(?:\s+\S+){{0,{after}}})", 1)
    return F.when(cut != "", F.regexp_replace(cut, rf"(?i)\b({any_of})\b", "**$1**")).otherwise(F.substring(text, 1, 500))


# Vectors.


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 10, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): the k rows most similar to one vector; the filter runs before any distance."""
    rows = vectors if where is None else vectors.where(where)
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(*[c for c in rows.columns if c != vector], F.round(score, 6).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


#: Query vectors that one batch of work may hold.
QUERY_BLOCK = 10_000
#: Queries and rows that a task scores at a time: 8 MB of scores, whatever the batch.
QUERY_SLICE, ROW_SLICE = 512, 2048


def batch_nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, score, rank) for many queries: each task keeps its k best a query, then the best of all tasks.

    Queries are taken in blocks of QUERY_BLOCK vectors, the most that the driver and
    any task hold; a block's answers are written before the next one is read.
    """
    import numpy as np

    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).select(key, vector).where(F.col(vector).isNotNull()).collect()
        if not own:
            continue
        ids, matrix = [r[0] for r in own], np.array([r[1] for r in own], np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def best(source, shared=shared):
            import pyarrow as pa

            names, asked = shared.value
            cuts = range(0, len(names), QUERY_SLICE)
            held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in cuts]  # query, score, key of the best
            least = np.full(len(names), -np.inf)  # the k-th score of each query, once it has k
            for batch in source:
                for at in range(0, batch.num_rows, ROW_SLICE):
                    own = batch.slice(at, ROW_SLICE)
                    keys = own.column(0).to_numpy(zero_copy_only=False)
                    rows = np.array(own.column(1).to_pylist(), np.float64)
                    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
                    for n, cut in enumerate(cuts):
                        scores = np.round(asked[cut : cut + QUERY_SLICE] @ rows.T, 6)
                        scores[np.isnan(scores)] = -np.inf  # last
                        bound = least[cut : cut + QUERY_SLICE]
                        if len(keys) > k and np.isneginf(bound).any():
                            bound = np.maximum(bound, np.partition(scores, -k, axis=1)[:, -k])
                        q, r = np.nonzero(scores >= bound[:, None])
                        if not len(q):
                            continue
                        q, s, x = (np.concatenate(p) for p in zip(held[n], (q, scores[q, r], keys[r]), strict=True))
                        order = np.lexsort((x, -s, q))
                        q, s, x = q[order], s[order], x[order]
                        nth = np.arange(len(q)) - np.searchsorted(q, q)
                        held[n] = tuple(p[nth < k] for p in (q, s, x))
                        full = nth == k - 1
                        least[cut + q[full]] = s[full]
            for cut, (q, s, x) in zip(cuts, held, strict=True):
                s[np.isneginf(s)] = np.nan
                yield pa.record_batch([pa.array([names[cut + i] for i in q.tolist()], pa.int64()), pa.array(x, pa.int64()), pa.array(s)], names=["query", key, "score"])

        part = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(best, f"query long, {key} long, score double")
        if blocks > 1:
            part = settle(part, "nearest")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query long, {key} long, score double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def roll_up(hits: DataFrame, group: str, key: str) -> DataFrame:
    """The best hit of each group with its payload; of equal scores the smaller key."""
    rest = [c for c in hits.columns if c != group]
    return hits.groupBy(group).agg(F.max_by(F.struct(*rest), F.struct("score", -F.col(key))).alias("b")).select(group, "b.*")


# Fusion.


def ranked(hits: DataFrame, name: str, key: str, most: int = 1000) -> DataFrame:
    """(key, list, rank) of the ``most`` best hits of one list, which is what its one window can get."""
    w = Window.partitionBy("list").orderBy(F.desc("score"), key)
    return hits.orderBy(F.desc("score"), key).limit(most).select(key, F.lit(name).alias("list"), "score").withColumn("rank", F.row_number().over(w)).select(key, "list", "rank")


def fuse(lists: Sequence[DataFrame], key: str, k: int = 60, weights: Sequence[float] | None = None) -> DataFrame:
    """(key, score): reciprocal rank fusion, the sum of weight / (k + rank) over ranked lists(key, rank)."""
    if weights is not None and len(weights) != len(lists):
        raise ValueError("one weight a list")
    parts = [df.select(key, (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for df, w in zip(lists, weights or [1.0] * len(lists), strict=True)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"))


def boost(merged: DataFrame, signals: DataFrame, key: str, factor: float = 1.0, denominator: float = 500.0) -> DataFrame:
    """Scores times 1 + factor x signal / denominator; rows without a signal keep theirs."""
    return merged.join(signals, key, "left").select(key, F.round(F.col("score") * (1 + factor * F.coalesce("signal", F.lit(0.0)) / denominator), 9).alias("score"))


def paged(merged: DataFrame, key: str, page: int = 1, size: int = 20) -> DataFrame:
    """One page of results with the total number found."""
    total = merged.agg(F.count("*").alias("total"))
    top = merged.orderBy(F.desc("score"), key).offset((page - 1) * size).limit(size)
    return top.join(F.broadcast(total))  # one row


def cache_hit(cached: DataFrame, query: Sequence[float], least: float = 0.92, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest cached row if it is near enough, else no row."""
    return nearest(cached, query, 1, None, key, vector).where(F.col("score") >= least)


def verify_holding(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with ``score`` and ``verdict``: accurate, partially_accurate under .75, misrepresented under .5. A missing or zero vector scores 0."""
    score = F.round(F.coalesce(cosine(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return pairs.withColumn("score", score).withColumn("verdict", F.when(score < 0.5, "misrepresented").when(score < 0.75, "partially_accurate").otherwise("accurate"))


def expand_query(query: str, replaced: Mapping[str, str], act: str) -> tuple[str, list[str]]:
    """A query with old section numbers of an act as they are, and the lines to search for besides."""
    extra = [f"Section {new}" for old, new in replaced.items() if re.search(rf"(?i)\b(?:section\s+)?{re.escape(old)}\b(?:\s+(?:of\s+)?(?:the\s+)?{re.escape(act)})", query)]
    return " OR ".join([query, *extra]), extra
