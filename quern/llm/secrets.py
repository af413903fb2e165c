"""Secret scans: fixed patterns, and character Markov models told apart by log-likelihood ratio.

Two first-order character models, one of random strings and one of ordinary
identifiers and words, are trained from labelled samples: (string, label) rows
with label ``random`` or ``ordinary``. A token whose log-likelihood ratio between
them is high enough is reported as a ``markov`` span besides what the patterns
find. The random model is mixed evenly with a uniform one, since a secret may be
of an alphabet that no sample has.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks_by_size

#: Kind, pattern, the group whose length counts, the least length.
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
#: A text without any of these, lower-cased, has no ``assign`` span.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: The same spans as PATTERNS' ``hex`` and ``access`` of the least length or more, found faster: their runs are maximal either way.
LONG_HEX, LONG_ACCESS = re.compile(r"[0-9a-f]{16,}"), re.compile(r"AKIA[A-Z0-9]{14,}")
KINDS = ["assign", "access", "hex", "markov"]
#: What the models judge: runs of these characters, which ordinary samples are made of as well.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SAMPLE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_NUMBER = {c: i for i, c in enumerate(ALPHABET)}
#: State of the edges of a string.
EDGE = len(ALPHABET)
STATES = EDGE + 1
#: The state of each ASCII character; all that are not in the alphabet read as an edge.
CODES = np.full(128, EDGE, np.uint8)
CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: Share of the uniform model in the random one.
UNIFORM_SHARE = 0.5
#: A token is a secret from this log-likelihood ratio on: the odds that it must outweigh, since few tokens are secrets.
MIN_RATIO = 12.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' spans in code points, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower() if len(text) < 1 << 24 else None
    if low is None or any(w in low for w in ASSIGN_WORDS):
        _, pattern, group, least = PATTERNS[0]
        found += [(*m.span(), "assign") for m in pattern.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in LONG_ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def transitions(string: str) -> np.ndarray:
    """Numbers of the string's character pairs, its edges included; characters outside the alphabet are left out."""
    at = np.array([EDGE, *(_NUMBER[c] for c in string if c in _NUMBER), EDGE])
    return at[:-1] * STATES + at[1:]


#: All ASCII characters that are no state of their own and do not part strings.
_LEFT_OUT = bytes(c for c in range(1, 128) if CODES[c] == EDGE)


def joined_transitions(strings: list[str]) -> np.ndarray:
    """The transitions of many strings, none of them empty, one after the other."""
    joined = "\x00".join(["", *strings, ""]).encode("ascii", "ignore").translate(None, _LEFT_OUT)
    at = CODES[np.frombuffer(joined, np.uint8)].astype(np.int64)
    return at[:-1] * STATES + at[1:]


@dataclass(frozen=True)
class MarkovModel:
    ratios: np.ndarray  # log(random / ordinary) of each transition

    def score(self, token: str) -> float:
        """Log-likelihood ratio of the token: positive if it reads like a random string."""
        return float(self.ratios[transitions(token)].sum())

    def scores(self, tokens: list[str]) -> np.ndarray:
        """The scores of many tokens, none of them empty, at once."""
        ratios = self.ratios[joined_transitions(tokens)]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        return np.add.reduceat(ratios, np.cumsum(lengths) - lengths)


def labelled_samples(docs: DataFrame, text_col: str = "text", *, max_texts: int = 50_000) -> DataFrame:
    """(string, label) rows from texts: what the patterns find is ``random``, other tokens are ``ordinary``.

    About ``max_texts`` different texts of ``docs`` are used, those with the smallest
    hashes, at any size each once; no other column has a part in it.
    """
    known = docs.where(F.col(text_col).isNotNull())
    total = known.count()
    rows = known.select(F.col(text_col).alias("text"))
    if total > max_texts:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * max_texts / total))
    rows = rows.dropDuplicates(["text"])

    def sampled(source):
        import pyarrow as pa

        for batch in source:
            out: list[tuple[str, str]] = []
            for text in batch.column(0).to_pylist():
                spans, end = base_spans(text), 0
                for a, b, kind in spans:
                    if a >= end:
                        out += [(w, "ordinary") for w in SAMPLE.findall(text[end:a])]
                    end = max(end, b)
                    out.append((PATTERNS[0][1].match(text[a:b])[2] if kind == "assign" else text[a:b], "random"))
                out += [(w, "ordinary") for w in SAMPLE.findall(text[end:])]
            if out:
                strings, labels = zip(*out, strict=True)
                yield pa.record_batch([pa.array(strings, pa.string()), pa.array(labels, pa.string())], names=["string", "label"])

    return rows.mapInArrow(sampled, "string string, label string")


def train(samples: DataFrame) -> MarkovModel:
    """Count transitions of labelled strings; unseen ones count a half. Without samples of a label its model is uniform."""

    def counted(source):
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[str, np.ndarray] = {}
        for batch in source:
            for label in ("random", "ordinary"):
                own = batch.column(0).filter(pc.equal(batch.column(1), label)).drop_null().to_pylist()
                if own := [s for s in own if s]:
                    held[label] = held.get(label, 0) + np.bincount(joined_transitions(own), minlength=STATES * STATES)
        for label, n in held.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["label", "pair", "n"])

    # At most two labels x STATES^2 rows.
    table = samples.mapInArrow(counted, "label string, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).toPandas()
    shares = {}
    for label in ("random", "ordinary"):
        n = np.full(STATES * STATES, 0.5)
        own = table[table.label == label]
        n[own.pair.to_numpy(np.int64)] += own.n.to_numpy(np.float64)
        n = n.reshape(STATES, STATES)
        shares[label] = (n / n.sum(axis=1, keepdims=True)).ravel()
    return MarkovModel(np.log((1 - UNIFORM_SHARE) * shares["random"] + UNIFORM_SHARE / STATES) - np.log(shares["ordinary"]))


def evaluate(samples: DataFrame, model: MarkovModel, min_ratio: float = MIN_RATIO) -> dict[str, float]:
    """``recall`` of random and share of ``false_positives`` among ordinary labelled strings that are long enough to be judged."""

    def judged(source):
        import pyarrow as pa

        for batch in source:
            strings, labels = ([x for x, s in zip(batch.column(i).to_pylist(), batch.column(0).to_pylist(), strict=True) if s and TOKEN.fullmatch(s)] for i in (0, 1))
            found = model.scores(strings) >= min_ratio if strings else np.zeros(0, bool)
            yield pa.record_batch([pa.array(labels, pa.string()), pa.array(found)], names=["label", "found"])

    shares = {r.label: r.share for r in samples.mapInArrow(judged, "label string, found boolean").groupBy("label").agg(F.avg(F.col("found").cast("int")).alias("share")).collect()}
    return {"recall": shares.get("random", 0.0), "false_positives": shares.get("ordinary", 0.0)}


def markov_spans(text: str, model: MarkovModel, taken: list[tuple[int, int, str]], min_ratio: float = MIN_RATIO) -> list[tuple[int, int, str]]:
    """Tokens of 12 characters or more that read like random strings and touch no span of ``taken``, which are sorted by start."""
    tokens = [(*m.span(), m[0]) for m in TOKEN.finditer(text)]
    if not tokens:
        return []
    good = np.flatnonzero(model.scores([t for _, _, t in tokens]) >= min_ratio).tolist()
    if not good:
        return []
    # The furthest end among the spans that start before a place tells whether one of them reaches it.
    starts, ends = [a for a, _, _ in taken], np.maximum.accumulate([0, *(b for _, b, _ in taken)])
    return [(a, b, "markov") for a, b, _ in (tokens[i] for i in good) if ends[bisect_left(starts, b)] <= a]


def find_secrets(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text", *, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, end, kind) sorted by start, then kind.

    Positions are code points of the whole text, ends exclusive. A null text
    counts as an empty one; rows that repeat are scanned alike; texts may be of any
    length; other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batches(source):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in source:
            for a, b in chunks_by_size(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), 4 << 20, int):
                out = []
                for text in batch.column(1).slice(a, b - a).fill_null("").to_pylist():
                    base = base_spans(text)
                    every = sorted(base + markov_spans(text, shared.value, base, min_ratio), key=lambda x: (x[0], KINDS.index(x[2])))
                    out.append([{"start": s, "end": e, "kind": k} for s, e, k in every])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(out, kind)], names=["id", "spans"])

    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string>>").withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", *, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(id, text) with every span replaced by ``mask``; overlapping spans give one mask."""
    found = find_secrets(docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("id"), F.col(text_col).alias("text")), model, "id", "text", min_ratio=min_ratio)
    text = F.coalesce(F.col("id.text"), F.lit(""))
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.when(x["end"] <= a["at"], a)
        .when(x["start"] < a["at"], F.struct(a["out"].alias("out"), x["end"].alias("at")))
        .otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), F.lit(mask)).alias("out"), x["end"].alias("at"))),
    )
    done = found.withColumn("cut", cut)
    return done.select(F.col("id.id").alias(id_col), F.concat(F.col("cut.out"), F.substring(text, F.col("cut.at").cast("int") + 1, F.length(text))).alias(text_col))
