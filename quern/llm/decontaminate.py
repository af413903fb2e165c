"""Benchmark decontamination with one FM-index for each shard of training documents.

A task gathers its documents into shards of a bounded number of words, indexes
each shard's word ids, and looks all test phrases up by backward search; the
occurrences' spans are merged per document. Nothing is shuffled and no document
meets another task, so a hot source or a group of copies makes no task larger.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_bytes, materialise, released, with_payload

#: Maps A-Z to a-z and every ASCII character but a-z and 0-9 to a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Windows:
    """All windows of some items: stretches of the items' words, which are kept once."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import numpy as np

        self.known: dict[bytes, int] = {}
        self.names, words, starts, lengths, owners = [], [], [], [], []
        held = 0
        for name, text in items:
            own = [self.known.setdefault(w, len(self.known)) for w in words_of(text)]
            if own:
                n = max(1, len(own) - width + 1)
                words.append(np.array(own, np.int32))
                starts.append(np.arange(held, held + n))
                lengths.append(np.full(n, min(width, len(own))))
                owners.append(np.full(n, len(self.names)))
                held += len(own)
                self.names.append(name)
        whole = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        self.words, self.starts, self.lengths, self.owners = (whole(x).astype(np.int64) for x in (words, starts, lengths, owners))


def _pieces(words: list[bytes], most: int, overlap: int):
    """(from, piece): a text over ``most`` words in pieces that overlap by ``overlap``."""
    if len(words) <= most:
        yield 0, words
        return
    for at in range(0, len(words) - overlap, most - overlap):
        yield at, words[at : at + most]


def _search_shard(pieces: list[list[bytes]], windows: Windows):
    """Occurrences of the windows in the pieces: arrays (piece, from, window)."""
    import numpy as np

    from quern.llm.fm_index import FMIndex, Phrases

    known: dict[bytes, int] = {}
    parts, starts, total = [], [], 0
    for words in pieces:
        starts.append(total)
        parts.append(np.array([known.setdefault(w, len(known) + 2) for w in words] + [1], np.int32))  # 1 ends a piece
        total += len(words) + 1
    none = np.zeros(0, np.int64)
    if not len(windows.starts) or not known:
        return none, none, none
    symbols = np.array([known.get(w, -1) for w in windows.known], np.int64)[windows.words]
    index = FMIndex(np.concatenate(parts), len(known) + 2)
    lo, hi = index.search(Phrases(symbols, windows.starts, windows.lengths))
    counts = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]
    spots = index.locate(rows)
    piece = np.searchsorted(starts, spots, side="right") - 1
    return piece, spots - np.array(starts)[piece], which


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"from": a, "to": b} for a, b in out]


#: Rows whose results a task holds before it sends them on.
HELD_ROWS = 50_000


def _pass(rows: DataFrame, items: list[tuple[str, bytes]], width: int, shard_words: int) -> DataFrame:
    """rows(id, hash, text) -> (id, hash, n_words, spans, items) for one block of test items."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, hash long, n_words long, spans array<struct<from:long,to:long>>, items array<string>"

    def batches(source):
        import pyarrow as pa

        windows = Windows(shared.value, width)

        def flush(texts: dict[bytes, list]):
            """texts: to each distinct text its (id, hash) pairs."""
            pieces, owner, words_in = [], [], []
            for n, text in enumerate(texts):
                words = words_of(text)
                words_in.append(len(words))
                for at, piece in _pieces(words, shard_words, width - 1):
                    pieces.append(piece)
                    owner.append((n, at))
            spans: list[list] = [[] for _ in words_in]
            hit: list[set] = [set() for _ in words_in]
            # A shard holds one text at least; the pieces of a very long one are shards of their own.
            at, held = 0, 0
            for end in range(1, len(pieces) + 1):
                held += len(pieces[end - 1])
                if end == len(pieces) or held + len(pieces[end]) > shard_words + (shard_words >> 1):
                    for piece, start, window in zip(*(x.tolist() for x in _search_shard(pieces[at:end], windows)), strict=True):
                        n, shift = owner[at + piece]
                        spans[n].append((shift + start, shift + start + int(windows.lengths[window])))
                        hit[n].add(windows.names[windows.owners[window]])
                    at, held = end, 0
            found = [(key, own, words_in[n], _merge(spans[n]), sorted(hit[n])) for n, keys in enumerate(texts.values()) for key, own in keys]
            columns = list(zip(*found, strict=True))
            return pa.record_batch([pa.array(columns[0], id_type[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(columns[4], pa.list_(pa.string()))], names=["id", "hash", "n_words", "spans", "items"])

        texts: dict[bytes, list] = {}
        held, kept, id_type = 0, 0, [None]
        for batch in source:
            id_type[0] = batch.column(0).type
            for key, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch, "text"), strict=True):
                if text not in texts:
                    held += len(text) // 6 + 1
                texts.setdefault(text, []).append((key, own))
                kept += 1
                if held >= shard_words or kept >= HELD_ROWS:
                    yield flush(texts)
                    texts, held, kept = {}, 0, 0
        if texts:
            yield flush(texts)

    return rows.mapInArrow(released(batches), schema)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _merged(spans: Column) -> Column:
    """Sorted spans of several blocks with those that touch made one."""

    def add(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when((F.size(out) > 0) & (x["from"] <= last["to"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, width: int = 13, shard_words: int = 1 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: id, ``text_hash``, ``n_words``, ``n_hit``, ``items``, ``spans``, ``contaminated``.

    A window is ``width`` consecutive words of an item, or the whole of a shorter
    one; a document word inside any occurrence of a window is hit, and ``spans``
    (word positions, end exclusive) is their union, to be cut out. A document is
    contaminated if at least one word in twenty is hit. Null or empty texts have
    no words; a null item id counts as an empty one; rows that repeat are judged
    alike. Other columns are ignored, whatever their names; empty tables work on
    either side.

    The driver and each task hold at most about ``block_bytes`` of the benchmark's
    text at a time: a larger one is written as a table of blocks, cut by hash, and
    all documents are searched for one block after the other, each pass's findings
    written before the next begins. Texts may be of any length.
    """
    rows = docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    shard_words = min(shard_words, 1 << 20)
    gathered = lambda part: [(r.item, r.text.encode()) for r in part.toLocalIterator()]
    if blocks == 1:
        found = _pass(rows, gathered(items), width, shard_words)
    else:
        items = materialise(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark-blocks")
        parts = [materialise(_pass(rows, gathered(items.where(F.col("block") == block)), width, shard_words).where((F.lit(block) == 0) | (F.size("items") > 0)), "benchmark-hits") for block in range(blocks)]
        # Rows are known by id and text; those that repeat both come back by the join.
        mark = F.struct("id", "hash")
        hits = reduce(DataFrame.unionByName, parts).groupBy(mark.alias("mark")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        hits = hits.withColumn("spans", _merged(F.col("spans")))
        found = parts[0].select("id", "hash", mark.alias("own")).join(hits, F.col("own") == F.col("mark"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["to"]).alias("to"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["to"] - F.greatest(x["from"], a["to"]))).alias("n")),
        lambda a: a["n"],
    )
    judged = found.withColumn("n_hit", covered)
    return judged.select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names.

    Rows are known by id and a hash of their text, which any reading of the table
    gives alike; rows that repeat both go or stay together. Null and empty texts
    stay; an empty benchmark drops nothing; an empty table gives an empty result.
    """
    bad = find_contamination(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).alias("bad")).distinct()
    rows = with_payload(docs, F.struct(F.col(id_col).alias("id"), _text_hash(text_col).alias("hash")).alias("mark"))
    return rows.join(materialise(bad, "contaminated"), F.col("mark") == F.col("bad"), "left_anti").select("payload.*")
