"""Alignment of two tokenizers' ids by the bytes that they stand for.

Both tokenizers spell the same bytes, so each token ends at a byte offset. A
dictionary of each side leads from an end to the token that ends there; the ends
that both have, sorted, slice the two id lists into groups, and the last tokens of
a group end together: a link.

Neither tokenizer has a token across a single space between two characters that
are not white space, so both end a token there, whatever is around it. Texts are
cut at these places, and the alignment of a stretch is remembered. A text is thus
never encoded as a whole, unless it has no such place.

Links are counted over all documents by blocks: a block numbers its different id
pairs, sends each pair once with its count, and gets back the pair's total. What
is shuffled is a row for each pair of a block, and the blocks' compressed numbers.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks_by_size, materialise, released
from quern.llm.token_output import BYTE_SIGNS

SPACE = "▁"
#: A space that both tokenizers begin a token with. White space is meant in Python's sense, which has all that a tokenizer splits at.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Stretches that a worker remembers.
REMEMBERED = 200_000
#: ASCII signs, of which a run is one word for byte-level BPE.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A block of links is closed at this many.
BLOCK_LINKS = 1 << 21
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def slices(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the groups of two token lists over the same bytes end, from the tokens' sizes in bytes: numbers of tokens of a and of b up to each end that both have."""

    def ends(sizes: np.ndarray) -> dict[int, int]:
        return dict(zip(np.cumsum(sizes).tolist(), range(1, len(sizes) + 1), strict=True))

    left, right = ends(a_sizes), ends(b_sizes)
    common = sorted(left.keys() & right.keys())
    return [left[e] for e in common], [right[e] for e in common]


class Aligned(NamedTuple):
    """Texts one after the other: ids of a and b, ends of groups in both (counted from a text's first id), and the number of each for every text."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray


class Side:
    """What is remembered of one tokenizer: for each stretch its ids, each as 2 * id + 1 where a group ends with it."""

    def __init__(self):
        self.values, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.values, self.sizes = np.concatenate([self.values, values]), np.concatenate([self.sizes, sizes])

    def of(self, stretches: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of stretches one after the other, and the number of each; none of those that are not ``used``."""
        sizes = np.where(used, self.sizes[stretches], 0)
        ends = np.cumsum(sizes)
        return self.values[np.repeat(self.starts[stretches] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def keep(self, stretches: np.ndarray) -> None:
        values, sizes = self.of(stretches, np.ones(len(stretches), bool))
        self.values, self.starts, self.sizes = values, np.cumsum(sizes) - sizes, sizes


class Aligner:
    """Encodes with a byte-level BPE (a) and a SentencePiece model that adds a space (b), and aligns their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        signs = {s: bytes([n]) for n, s in enumerate(BYTE_SIGNS)}
        names = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        # Tokens outside the alphabet, such as special ones, never come from a text.
        self.a_bytes = [b"".join(signs.get(s, b"?") for s in names.get(i, "?")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a token stands for no bytes: ends would not tell tokens apart")
        # A piece that holds a space behind another character could reach across a cut: then texts are not cut.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.at: dict[str, int] = {}
        self.sides = Side(), Side()
        self.spelt, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the stretches that were used most since the last time: at most half of what is remembered, and short ones only."""
        most = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        short = (self.sides[0].sizes < 64) & (self.uses > 1)
        kept = np.sort(most[short[most]])
        for side in self.sides:
            side.keep(kept)
        names = list(self.at)  # in the order of their numbers
        self.at = {names[n]: k for k, n in enumerate(kept.tolist())}
        self.spelt, self.uses = self.spelt[kept], np.zeros(len(kept), np.int64)

    def _a_ids(self, new: list[str]) -> list[list[int]]:
        """a's ids of a space and each stretch. A word and signs behind it are told apart before merges, which alone decide the rest."""
        out: list[list[int] | None] = []
        rest, words, tokenize = [], {"": []}, self.model.tokenize
        for n, x in enumerate(new):
            word = x.rstrip(SIGNS)
            if not (word.isalpha() and max(word) < "\u0250"):
                rest.append(n)
                out.append(None)
                continue
            ids, tail = words.get(word), x[len(word) :]
            if ids is None:
                spelt = word if word.isascii() else "".join(map(BYTE_SIGNS.__getitem__, word.encode()))
                ids = words[word] = [t.id for t in tokenize(BYTE_SIGNS[32] + spelt)]
            signs = words.get(tail)
            if signs is None:
                signs = words[tail] = [t.id for t in tokenize(tail)]
            out.append(ids + signs)
        for n, found in zip(rest, self.a.encode_batch_fast([" " + new[n] for n in rest], add_special_tokens=False), strict=True):
            out[n] = found.ids
        return out

    def _learn(self, new: list[str]) -> None:
        """Aligns new stretches, one behind the other: each begins and ends where tokens of both do."""
        ids = self._a_ids(new), self.b.encode(new, num_threads=1)
        sizes = [np.fromiter(map(len, x), np.int64, len(new)) for x in ids]
        flat = [list(chain.from_iterable(x)) for x in ids]
        bytes_of = self.a_bytes, self.b_bytes
        spelt = np.ones(len(new), bool)
        whole = "".join(" " + x for x in new).encode()
        if any(b"".join(map(names.__getitem__, x)) != whole for names, x in zip(bytes_of, flat, strict=True)):
            for n, x in enumerate(new):
                spelt[n] = all(b"".join(map(names.__getitem__, own[n])) == (" " + x).encode() for names, own in zip(bytes_of, ids, strict=True))
            good = np.flatnonzero(spelt).tolist()
            flat = [[i for n in good for i in x[n]] for x in ids]
            sizes = [np.where(spelt, n, 0) for n in sizes]
        if "" in new:
            spelt[new.index("")] = False
        flat = [np.array(x, np.int64) for x in flat]
        for side, x, n, ends in zip(self.sides, flat, sizes, slices(self.a_sizes[flat[0]], self.b_sizes[flat[1]]), strict=True):
            values = (2 * x).astype(np.int32)
            values[np.array(ends, np.int64) - 1] += 1
            side.add(values, n)
        self.at.update(zip(new, range(len(self.spelt), len(self.spelt) + len(new)), strict=True))
        self.spelt, self.uses = np.concatenate([self.spelt, spelt]), np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def __call__(self, texts: list[str]) -> Aligned:
        """Whole texts, one at least; an empty one and one that a side does not spell byte for byte have no ids."""
        if len(self.at) > REMEMBERED or max(len(s.values) for s in self.sides) > 16 * REMEMBERED:
            self.forget()
        split = [CUT.split(t) if self.cuts else [t] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        stretches = list(chain.from_iterable(split))
        if new := list(set(stretches).difference(self.at)):
            self._learn(new)
        at = np.fromiter(map(self.at.__getitem__, stretches), np.int64, len(stretches))
        self.uses += np.bincount(at, minlength=len(self.uses))
        first = np.cumsum(counts) - counts
        used = np.repeat(np.logical_and.reduceat(self.spelt[at], first), counts)
        ids, ends, numbers = [], [], []
        for side in self.sides:
            values, sizes = side.of(at, used)
            own = np.add.reduceat(sizes, first)
            last = np.flatnonzero(values & 1)
            before = np.cumsum(own) - own
            groups = np.diff(np.searchsorted(last, np.append(before, len(values))))
            ids.append(values >> 1)
            ends.append((last + 1 - np.repeat(before, groups)).astype(np.int32))
            numbers.append((own, groups))
        return Aligned(*ids, *ends, numbers[0][0], numbers[1][0], numbers[0][1])


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    return Aligner(a_path, b_path)


ALIGNED = ("a_ids", "b_ids", "a_ends", "b_ends")
#: Text that is encoded at once.
CHUNK = 2 << 20


def _chunks(source, a_path: str, b_path: str):
    """(ids, Aligned) of Arrow batches (id, text), about CHUNK characters or one longer text at a time."""
    own = _aligner(a_path, b_path)
    for batch in source:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for start, to in chunks_by_size(texts, CHUNK):
            yield batch.column(0).slice(start, to - start), own(texts[start:to])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``a_ids``, ``b_ids``, ``a_ends``, ``b_ends`` (arrays of int).

    Texts are encoded with a space before them, special tokens taken as plain text.
    Group g has the ids of a from place a_ends[g - 1] (0 for the first) up to
    a_ends[g], and those of b likewise; its last two tokens are linked. A null or
    empty text, and one that a tokenizer does not spell byte for byte, has empty
    arrays. Rows that repeat are aligned alike, null ids stay; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batches(source):
        import pyarrow as pa

        for ids, x in _chunks(source, a_path, b_path):
            sizes = x.n_a, x.n_b, x.n_groups, x.n_groups
            arrays = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(v, pa.int32())) for v, n in zip(x[:4], sizes, strict=True)]
            yield pa.record_batch([ids, *arrays], names=["id", *ALIGNED])

    lists = ", ".join(f"{c} array<int>" for c in ALIGNED)
    return rows.mapInArrow(released(batches), f"id {rows.schema['id'].dataType.simpleString()}, {lists}").withColumnRenamed("id", id_col)


def rendered(x: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each text: its groups, the ids of a and of b in order; '' without ids."""
    ends, texts = [], len(x.n_groups)
    for e, n in ((x.a_ends, x.n_a), (x.b_ends, x.n_b)):
        ends.append(e + np.repeat(np.cumsum(n) - n, x.n_groups))
    # A group's ids of a, then those of b: where each id comes in the whole.
    a_group, b_group = (np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in ends)
    a_at = np.arange(len(x.a)) + np.concatenate(([0], ends[1]))[a_group]
    b_at = np.arange(len(x.b)) + ends[0][b_group]
    codes = np.zeros(len(x.a) + len(x.b), np.int64)
    codes[a_at], codes[b_at] = 3 * x.a.astype(np.int64), 3 * x.b.astype(np.int64)
    codes[a_at[ends[0] - 1]] += 1
    codes[b_at[ends[1] - 1]] += 2
    signs = _signs(int(codes.max(initial=0)) // 3 >> 16)
    bounds = np.concatenate(([0], np.cumsum(x.n_a + x.n_b))).tolist()
    return ["".join(map(signs.__getitem__, codes[bounds[k] : bounds[k + 1]].tolist()))[:-1] for k in range(texts)]


@lru_cache(maxsize=1)
def _signs(pages: int) -> list[str]:
    """Three strings for each id below (pages + 1) * 65536: followed by a comma, a bar, a semicolon."""
    return [f"{i}{sign}" for i in range((pages + 1) << 16) for sign in ",|;"]


def _blocks(rows: DataFrame, a_path: str, b_path: str, id_type: str) -> DataFrame:
    """Materialised (block, ids, n_a, n_b, n_groups, digests, pairs, counts, places): aligned texts in blocks of about BLOCK_LINKS links.

    ``pairs`` are the block's different pairs in order, a in the high 32 bits, with
    their ``counts``; ``places`` leads from each link to its pair, compressed.
    """

    def batches(source):
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        held, codes, links, block = [], [], 0, 0
        task = TaskContext.get().partitionId() << 32
        listed = lambda values, kind: pa.array([np.concatenate(values)], pa.list_(kind))

        def close():
            pairs, places, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            places = places.astype(np.min_scalar_type(max(len(pairs) - 1, 0))).tobytes()
            ids = pa.concat_arrays([x[0] for x in held])
            numbers = {name: listed([x[k] for x in held], pa.int64()) for k, name in enumerate(("n_a", "n_b", "n_groups"), 1)}
            columns = {"block": pa.array([task + block]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), **numbers}
            columns |= {"digests": pa.array([[d for x in held for d in x[4]]], pa.list_(pa.string())), "pairs": listed([pairs], pa.int64()), "counts": listed([counts], pa.int64())}
            return pa.RecordBatch.from_pydict(columns | {"places": pa.array([pa.Codec("zstd").compress(places, asbytes=True)], pa.binary())})

        for ids, x in _chunks(source, a_path, b_path):
            digests = [hashlib.sha256(said.encode()).hexdigest() if said else "" for said in rendered(x)]
            a, b = (v[e + np.repeat(np.cumsum(n) - n, x.n_groups) - 1] for v, e, n in ((x.a, x.a_ends, x.n_a), (x.b, x.b_ends, x.n_b)))
            held.append((ids, x.n_a, x.n_b, x.n_groups, digests))
            codes.append(a.astype(np.int64) << 32 | b)
            links += len(a)
            if links >= BLOCK_LINKS:
                yield close()
                held, codes, links, block = [], [], 0, block + 1
        if held:
            yield close()

    schema = f"block long, ids array<{id_type}>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, pairs array<long>, counts array<long>, places binary"
    return materialise(rows.mapInArrow(released(batches), schema), "link-blocks")


def score_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Texts are aligned as ``align`` does, with the same rule for odd rows. A pair's
    count is how often all rows hold it linked. ``n_best`` are the links whose count
    is the highest of their id of b (ties too), ``count_sum`` the sum of the links'
    counts, ``groups_sha256`` the digest of ``rendered`` ('' without ids).

    Counts are exact and cover all rows. A task holds a block of about BLOCK_LINKS
    links, or one longer document. A pair comes once a block however frequent it
    is. What is broadcast is a number for each id of b.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    blocks = _blocks(rows, a_path, b_path, id_type)
    sent = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("of")).select("block", F.col("of.pairs").alias("pair"), F.col("of.counts").alias("n"))
    pairs = materialise(sent.groupBy("pair").agg(F.sum("n").alias("total")), "link-pairs")
    b_of = F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")
    best = pairs.groupBy(b_of).agg(F.max("total").alias("best"))
    totals = sent.join(pairs, "pair").withColumn("b", b_of).join(F.broadcast(best), "b")
    carried = ["ids", "n_a", "n_b", "n_groups", "digests", "places"]
    none = lambda columns, schema: [F.lit(None).cast(schema[c].dataType).alias(c) for c in columns]
    said = totals.select("block", *none(carried, blocks.schema), "pair", "total", (F.col("total") == F.col("best")).alias("is_best"))
    both = blocks.select("block", *carried, *none(["pair", "total", "is_best"], said.schema)).unionByName(said)

    def scored(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        of_block = pc.is_null(table.column("pair"))
        own, told = table.filter(of_block), table.filter(pc.invert(of_block)).sort_by("pair")
        total, top = told.column("total").to_numpy(), told.column("is_best").to_numpy(zero_copy_only=False).astype(np.int64)
        lists = {c: own.column(c).combine_chunks().flatten() for c in carried[:-1]}
        sizes = lists["n_groups"].to_numpy()
        width = np.min_scalar_type(max(len(total) - 1, 0))
        raw = pa.Codec("zstd").decompress(own.column("places")[0].as_py(), int(sizes.sum()) * width.itemsize, asbytes=True)
        at, ends = np.frombuffer(raw, width), np.concatenate(([0], np.cumsum(sizes)))
        summed = lambda values: np.diff(np.concatenate(([0], np.cumsum(values[at])))[ends])
        return pa.table({"id": lists["ids"], "n_a": lists["n_a"], "n_b": lists["n_b"], "n_groups": sizes, "n_links": sizes, "n_best": summed(top), "count_sum": summed(total), "groups_sha256": lists["digests"]})

    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return both.groupBy("block").applyInArrow(scored, schema).withColumnRenamed("id", id_col)
