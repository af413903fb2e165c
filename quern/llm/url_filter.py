"""URL filters: fixed rules first, then association rules that Spark's FP-growth mines from labelled URLs.

A URL is a set of tokens (labels of its host, segments of its path with numbers
masked, names of its query). FP-growth finds token combinations that are
frequent together with a label; those of enough support and confidence that no
shorter combination already gives become the filter. It is matched by inverted
index: every token counts up the rules it belongs to, and a rule fits when all
its tokens were counted.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise

#: Fixed values: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LABELS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): the host with A-Z lower-cased; all empty where the url is null or has no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    behind = after.substr(F.length(host) + 1, F.length(after) + 1)
    path = F.regexp_extract(behind, r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, behind.substr(F.length(path) + 1, F.length(behind) + 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, rest: Column) -> Column:
    """Different tokens of a URL; runs of digits read as ``#``."""
    masked = lambda x: F.regexp_replace(x, r"[0-9]+", "#")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), masked(x)))
    names = F.transform(F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("query:"), masked(x)))
    return F.array_distinct(F.filter(F.concat(labels, segments, names), lambda x: ~x.isin("host:", "path:", "query:")))


@dataclass(frozen=True)
class UrlModel:
    """Association rules: (tokens, label, confidence, support), best first, and the tokens that others stand for."""

    rules: list[tuple[tuple[str, ...], str, float, float]]
    stands_for: dict[str, str] = field(default_factory=dict)

    def index(self) -> dict[str, list[int]]:
        held = defaultdict(list)
        for n, (tokens, *_) in enumerate(self.rules):
            for token in tokens:
                held[token].append(n)
        return held


def pruned(rules: DataFrame) -> DataFrame:
    """rules(tokens, label, confidence, support) without those of which a part of the tokens gives the same label with at least their confidence."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("tokens")).cast("int") - 2)
    longer = rules.where(F.size("tokens") > 1).withColumn("mask", F.explode(masks))
    parts = longer.withColumn("part", F.expr("filter(tokens, (t, i) -> (mask & shiftleft(1, i)) != 0)"))
    better = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("least"))
    worse = parts.join(better, ["part", "label"]).where("least >= confidence").select("tokens", "label").distinct()
    return rules.join(worse, ["tokens", "label"], "left_anti")


#: Frequent sets up to which FP-growth, which has no bound on their length, is left to find them.
MOST_SETS = 200_000


def _most_sets(merged: DataFrame, least: int) -> float:
    """An upper bound on the frequent sets: a row of n tokens has 2^n sets, and a frequent set is in ``least`` rows."""
    return (merged.agg(F.sum(F.pow(F.lit(2.0), F.size("tokens") + 1))).first()[0] or 0.0) / least


def _short_sets(merged: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """(tokens, label, confidence, support rows) of all sets of ``max_tokens`` tokens at most that ``least`` rows have with a label.

    For rows with many frequent tokens, whose sets of all lengths nobody could
    count: rows with the same tokens are one with a number, and each task sums up the
    sets of its rows before they are shuffled; a set of three or more is counted only
    if each pair in it is frequent.
    """
    held = materialise(merged.groupBy(F.array_sort("tokens").alias("tokens")).agg(*[F.sum((F.col("label") == x).cast("long")).alias(x) for x in LABELS]), "url-rows")

    def sets(sizes: range, pairs: frozenset):
        def counted(source):
            import pyarrow as pa

            total: dict[tuple, list[int]] = {}

            def rows():
                out = pa.record_batch([pa.array(map(list, total), pa.list_(pa.string())), *(pa.array([n[k] for n in total.values()], pa.int64()) for k in range(len(LABELS)))], names=["tokens", *LABELS])
                total.clear()
                return out

            for batch in source:
                for tokens, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for size in sizes:
                        for some in combinations(tokens, size):
                            if size > 2 and not all(p in pairs for p in combinations(some, 2)):
                                continue
                            own = total.setdefault(some, [0] * len(LABELS))
                            for k, n in enumerate(numbers):
                                own[k] += n
                    if len(total) > 500_000:
                        yield rows()
            yield rows()

        found = held.mapInArrow(counted, "tokens array<string>, " + ", ".join(f"{x} long" for x in LABELS))
        return found.groupBy("tokens").agg(*[F.sum(x).alias(x) for x in LABELS])

    frequent = F.greatest(*LABELS) >= least
    short = materialise(sets(range(1, min(2, max_tokens) + 1), frozenset()).where(frequent), "url-pairs")
    # As many as pairs of frequent tokens, which are at most the mean number of tokens over the least share.
    pairs = frozenset(tuple(r.tokens) for r in short.where(F.size("tokens") == 2).select("tokens").collect())
    longer = sets(range(3, max_tokens + 1), pairs).where(frequent) if max_tokens > 2 else short.limit(0)
    every = short.unionByName(longer)
    told = [F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in LABELS]
    rules = every.select("tokens", sum((F.col(x) for x in LABELS[1:]), F.col(LABELS[0])).alias("all"), F.explode(F.array(*told)).alias("of"))
    return rules.select("tokens", "of.label", (F.col("of.n") / F.col("all")).alias("confidence"), F.col("of.n").alias("n")).where(F.col("n") >= least)


def merged_tokens(rows: DataFrame, least: int) -> tuple[DataFrame, dict[str, str]]:
    """rows(tokens, label) with frequent tokens only (in ``least`` rows or more), one for those that always occur together.

    Tokens of one URL template come together in every row; each subset of them is
    an item set of the same rows, so that n of them would give 2^n. The first of
    them by name stands for all, and a rule fits where any of them is found, which
    is the same as a rule for each. Frequent tokens are at most the mean number of
    tokens over the least share, whatever the input.
    """
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    frequent = sorted(r.token for r in counts.collect())
    listed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    held = rows.withColumn("tokens", F.array_sort(F.array_intersect("tokens", listed(frequent))))
    # Tokens come in the same rows if their numbers of rows and the sums of their rows' hashes agree.
    marked = held.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").cast("decimal(20,0)").alias("row"))
    first: dict[tuple, str] = {}
    stands_for = {}
    for token, n, sums in sorted(map(tuple, marked.groupBy("token").agg(F.count("*"), F.sum("row")).collect())):
        stands_for[token] = first.setdefault((n, sums), token)
    return held.withColumn("tokens", F.array_intersect("tokens", listed(sorted(first.values())))), stands_for


def mine(labelled: DataFrame, *, min_support: float = 0.02, min_rows: int = 10, min_confidence: float = 0.9, max_tokens: int = 4) -> UrlModel:
    """Mine ``labelled``(tokens array<string>, label ``allow`` or ``block``).

    A rule has a share of ``min_support`` of the labelled rows, and ``min_rows`` of
    them at least, ``max_tokens`` tokens at most, and ``min_confidence``. All such
    rules that pruning leaves are kept; their number depends on the supports and
    not on the rows. FP-growth finds the sets; where rows have so many frequent
    tokens that sets of all lengths could be more than MOST_SETS, sets of the
    lengths that are asked for are counted instead, which gives the same rules.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where(F.col("label").isin(*LABELS) & (F.size("tokens") > 0)).select("tokens", "label")
    total = rows.count()
    least = max(min_rows, math.ceil(min_support * total))
    if total < least:
        return UrlModel([])
    merged, stands_for = merged_tokens(rows, least)
    merged = materialise(merged, "url-tokens")
    if _most_sets(merged, least) <= MOST_SETS:
        items = merged.select(F.concat("tokens", F.array(F.concat(F.lit("label="), "label"))).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=min_confidence).fit(items)
        found = model.associationRules.where((F.size("antecedent") <= max_tokens) & F.element_at("consequent", 1).startswith("label=") & ~F.exists("antecedent", lambda x: x.startswith("label=")))
        rules = found.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(F.element_at("consequent", 1), "=", -1).alias("label"), F.col("confidence").cast("double").alias("confidence"), F.col("support").cast("double").alias("support"))
    else:
        found = _short_sets(merged, least, max_tokens).where(F.col("confidence") >= min_confidence)
        rules = found.select("tokens", "label", "confidence", (F.col("n") / total).alias("support"))
    best = pruned(materialise(rules, "url-rules")).collect()
    return UrlModel(sorted(((tuple(r.tokens), r.label, r.confidence, r.support) for r in best), key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1])), stands_for)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules=RULES, default: str = "allow", **mining) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (the tokens of the mined rule that decided, or null).

    Rows that a fixed rule decides are the labelled sample from which the
    association rules are mined; the others get the verdict of the best mined rule
    that fits, or ``default``. Null urls and those without ``://`` have empty host
    and path and get ``default``. Rows that repeat are judged alike, urls may be of
    any length, of rules that are equally good the first by name decides. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = tokenised(pages, id_col, url_col, rules)
    return match_rules(rows, mine(rows.where("said IS NOT NULL").select("tokens", F.col("said").alias("label")), **mining), id_col, default)


def tokenised(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, said, tokens): each URL's parts, what the fixed rules say, and its tokens."""
    host, path, rest = url_parts(F.col("url"))
    rule, said = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    return rows.select("id", "host", "path", rule.alias("rule"), said.alias("said"), url_tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"))


def match_rules(rows: DataFrame, model: UrlModel, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """Verdicts of rows(id, host, path, rule, said, tokens): what is ``said``, else the best mined rule that fits, else ``default``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def matched(source):
        import pyarrow as pa

        mined, index, stands_for = shared.value.rules, shared.value.index(), shared.value.stands_for
        for batch in source:
            label, why = [], []
            for said, tokens in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                best = None
                if said is None:
                    counts: dict[int, int] = defaultdict(int)
                    for token in {stands_for.get(t, t) for t in tokens or ()}:
                        for n in index.get(token, ()):
                            counts[n] += 1
                    best = min((n for n, c in counts.items() if c == len(mined[n][0])), default=None)
                label.append(said if said is not None else default if best is None else mined[best][1])
                why.append(None if best is None else " ".join(mined[best][0]))
            yield pa.record_batch([*batch.columns[:4], pa.array(label, pa.string()), pa.array(why, pa.string())], names=["id", "host", "path", "rule", "verdict", "mined"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(matched, f"id {kind}, host string, path string, rule string, verdict string, mined string").withColumnRenamed("id", id_col)
