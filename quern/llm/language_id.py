"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans.

The model is learnt from labelled texts: for every language the counts of hashed
character trigrams of words, and of the scripts that words are written in. Its
size is languages x (2^HASH_BITS + scripts), whatever the corpus. To a word, a
language gives the sum of its trigrams' log-probabilities; languages that hardly
write its script are out. Labels of a text's words are the best path under a
penalty for each change of language, so that stray words don't break spans.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks_by_size, released, with_payload

HASH_BITS = 16
#: The first code points of script ranges, with the script's number; letters elsewhere are of script 0.
SCRIPT_RANGES = [(0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 0), (0x0590, 4), (0x0600, 5), (0x0700, 0), (0x0900, 6), (0x0980, 0), (0x0E00, 7), (0x0E80, 0), (0x10A0, 8), (0x1100, 9), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 10), (0x3100, 0), (0x3400, 11), (0xA000, 0), (0xAC00, 9), (0xD7B0, 0)]
#: Names of the scripts by number.
SCRIPTS = ["other", "latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "georgian", "hangul", "kana", "han"]
#: A language is a candidate for a script if at least this share of its words is written in it.
CANDIDATE_SHARE = 0.001
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 150_000
#: Words of texts whose paths are found together.
BLOCK_WORDS = 400_000
MAX_LANGUAGES = 1000
_OUT = -1e3


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words with their edges marked, each word's number of them, and its script."""
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    hashed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    hashed = (hashed * np.uint64(0x27D4EB2F) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - HASH_BITS)
    inside = np.ones(len(points) - 2, bool)
    inside[(starts[1:, None] - [2, 1]).ravel()] = False  # those that reach into the next word
    firsts, numbers = (np.array(x) for x in zip(*SCRIPT_RANGES, strict=True))
    scripts = numbers[np.searchsorted(firsts, points[starts + 1].astype(np.int64), side="right") - 1]
    return hashed[inside].astype(np.int64), lengths, scripts


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # 2^HASH_BITS x languages
    candidates: np.ndarray  # scripts x languages: 0, or _OUT if the language hardly uses the script

    def word_scores(self, words: list[str]) -> np.ndarray:
        hashed, lengths, scripts = _features(words)
        sums = np.add.reduceat(self.logs[hashed], np.cumsum(lengths) - lengths, axis=0)
        return (sums + self.candidates[scripts]).astype(np.float32)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, max_texts: int = 5_000) -> LanguageModel:
    """Learn from ``labelled``(text, lang); null texts and languages are left out.

    About ``max_texts`` different texts of each language are used, those with the
    smallest hashes of the text: enough for trigram counts, fewer where many rows
    repeat a text, and all texts of a language that has few. Texts that repeat are
    learnt from once, at any size. No other column has a part in it.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    language = F.col(lang_col).cast("string")
    totals = dict(map(tuple, known.groupBy(language.alias("of")).count().limit(MAX_LANGUAGES + 1).collect()))
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = [x for lang, n in totals.items() if n > max_texts for x in (F.lit(lang), F.lit(int((1 << 30) * max_texts / n)))]
    rows = known.select(F.col(text_col).alias("text"), language.alias("lang"))
    if shares:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.coalesce(F.create_map(*shares)[F.col("lang")], F.lit(1 << 30)))
    rows = rows.dropDuplicates(["text", "lang"])

    def counted(source):
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for batch in source:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                if words:
                    hashed, _, scripts = _features(words)
                    own = held.setdefault(lang, np.zeros((1 << HASH_BITS) + len(SCRIPTS), np.int64))
                    own += np.bincount(np.concatenate((hashed, scripts + (1 << HASH_BITS))), minlength=len(own))
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "feature", "n"])

    found = rows.mapInArrow(released(counted), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = found.toPandas()  # at most MAX_LANGUAGES x (2^HASH_BITS + scripts) rows
    languages = sorted(set(table.lang))
    counts = np.zeros(((1 << HASH_BITS) + len(SCRIPTS), max(1, len(languages))))
    if languages:
        counts[table.feature.to_numpy(np.int64), np.searchsorted(languages, table.lang.to_numpy(str))] = table.n.to_numpy(np.float64)
    grams, scripts = counts[: 1 << HASH_BITS] + 0.1, counts[1 << HASH_BITS :]
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    candidates = np.where(share >= CANDIDATE_SHARE, 0.0, _OUT)
    candidates[(share < CANDIDATE_SHARE).all(axis=1)] = 0.0  # a script nobody uses rules nobody out
    return LanguageModel(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), candidates.astype(np.float32))


def viterbi(scores: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of many texts at once. numbers: the words' rows in ``scores``, texts one after the other, the longest first."""
    starts = np.cumsum(lengths) - lengths
    labels = np.zeros(len(numbers), np.int8 if scores.shape[1] < 127 else np.int16)
    if not len(numbers):
        return labels
    # How many texts are longer than t words; texts are sorted, so these come first.
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    stay, came = np.zeros((len(numbers), scores.shape[1]), bool), np.zeros(len(numbers), labels.dtype)
    best = scores[numbers[starts[: active[0]]]].astype(np.float32)
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        own = best[: active[t]]
        top = own.max(axis=1) - np.float32(penalty)
        stay[at] = own >= top[:, None]
        came[at] = own.argmax(axis=1)
        np.maximum(own, top[:, None], out=own)
        own += scores[numbers[at]]
    current = best.argmax(axis=1)
    last = lengths - 1
    for t in range(len(active) - 1, -1, -1):
        own = np.arange(active[t])
        at = starts[own] + t
        labels[at] = current[own]
        if t:
            current[own] = np.where(stay[at, current[own]], current[own], came[at])
    assert (last >= -1).all()
    return labels


class Labeller:
    """Labels texts with a model; remembers words' scores."""

    def __init__(self, model: LanguageModel, penalty: float):
        self.model, self.penalty = model, penalty
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int32)  # trigrams of a word

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[dict], float]]:
        """Language, its share, spans and margin of each text."""
        out: list = [("und", 0.0, [], 0.0)] * len(texts)
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        order = sorted((i for i in range(len(texts)) if words[i]), key=lambda i: -len(words[i]))
        if not order or not self.model.languages:
            return out
        if len(self.numbers) > REMEMBERED:
            self.numbers, self.scores, self.letters, self.sizes = {}, self.scores[:0], self.letters[:0], self.sizes[:0]
        numbers = self.numbers
        new = list(set().union(*words).difference(numbers))
        if new:
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, self.model.word_scores(new)))
            own = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]  # signs like a raised 2 are no letters
            self.letters = np.concatenate((self.letters, np.array(own, np.int32)))
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, new), np.int32, len(new))))
        lengths = np.array([len(words[i]) for i in order], np.int64)
        at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words[i] for i in order)), np.int64, int(lengths.sum()))
        letters = self.letters[at]
        labels = viterbi(self.scores, at, lengths, self.penalty).astype(np.int64)
        text = np.repeat(np.arange(len(order)), lengths)
        size = len(self.model.languages)
        share = np.bincount(text * size + labels, letters, len(order) * size).reshape(-1, size)
        best = share.argmax(axis=1)
        # What the path gives a trigram on average, against one of all hashes that are equally likely.
        fits = np.bincount(text, self.scores[at, labels], len(order)) / np.bincount(text, self.sizes[at], len(order)) + HASH_BITS * math.log(2)
        total = share.sum(axis=1)
        score = share[np.arange(len(order)), best] / np.maximum(total, 1)
        ends = np.flatnonzero(np.concatenate(((labels[1:] != labels[:-1]) | (text[1:] != text[:-1]), [True]))) + 1
        begin = np.cumsum(lengths) - lengths
        spans: list[list[dict]] = [[] for _ in order]
        for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
            n = text[a]
            spans[n].append({"from": a - int(begin[n]), "to": b - int(begin[n]), "lang": self.model.languages[labels[a]]})
        for n, i in enumerate(order):
            if total[n]:
                out[i] = (self.model.languages[best[n]], float(score[n]), spans[n], float(fits[n]))
        return out


def _chunks(column):
    """Parts of an Arrow array of texts with a bounded number of words, as (from, to, texts); one text at least."""
    import pyarrow.compute as pc

    for a, b in chunks_by_size(pc.binary_length(column).fill_null(0).to_pylist(), 6 * BLOCK_WORDS, int):
        yield a, b, column.slice(a, b - a).to_pylist()


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *, penalty: float = 12.0) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, ``spans``, ``margin``.

    ``spans`` are runs of words (letters in a row; end exclusive) in one language;
    ``lang_pred`` is the language with the most letters (of equal ones the first by
    name) and ``score`` its share of them. ``margin`` is the mean log-likelihood of
    the text's trigrams under its labels, over that of trigrams drawn evenly: below
    zero, no language explains the text better than chance. Null texts and texts
    without a letter are ``und`` with score and margin 0 and no spans. Only the
    text is looked at, whatever other columns there are; rows that repeat are
    judged alike, and an empty table gives an empty result. Whole texts are
    labelled; texts are taken together up to a number of words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batches(source):
        import pyarrow as pa

        labeller = Labeller(shared.value, penalty)
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("lang", pa.string())]))
        for batch in source:
            for a, b, texts in _chunks(batch.column(1)):
                lang, score, spans, margin = zip(*labeller(texts), strict=True)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span), pa.array(margin, pa.float64())], names=["id", "lang_pred", "score", "spans", "margin"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(batches), f"id {kind}, lang_pred string, score double, spans array<struct<from:long,to:long,lang:string>>, margin double").withColumnRenamed("id", id_col)


def keep_languages(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", *, penalty: float = 12.0, least_margin: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a known language, with all their columns, whatever their names.

    A text goes if it is null or has no letter, or if its ``margin`` (see
    ``identify``) is below ``least_margin``. Where no language was learnt every
    text with a letter stays. Rows that repeat are judged alike; texts may be of
    any length; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(training), text_col, lang_col))
    place = docs.columns.index(text_col)
    # One struct, so that no column's name or type is Arrow's or SQL's concern.
    rows = with_payload(docs)

    def batches(source):
        import pyarrow as pa

        labeller = Labeller(shared.value, penalty)
        for batch in source:
            for a, b, texts in _chunks(batch.column(0).field(place)):
                if shared.value.languages:
                    stays = [lang != "und" and margin >= least_margin for lang, _, _, margin in labeller(texts)]
                else:
                    stays = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                yield batch.slice(a, b - a).filter(pa.array(stays))

    return rows.mapInArrow(released(batches), rows.schema).select("payload.*")
