"""Token-id output: documents as token ids in compressed, checksummed blocks, and back.

The files are Parquet tables of blocks, so that any store Spark writes to will
do and a lost task leaves no half-written file. Folder layout:

* ``frequencies``: one row (id, freq) for each id that occurs, shared by all blocks.
* ``blocks``: one row per block: file (number of the range of document ids),
  block, first (ids of the file before it), documents (doc ids), counts (their
  numbers of ids), n, stream, places, states (see rans.py), crc32s of the ids
  from each checkpoint to the next.

A block holds whole documents and decodes without any other block. A reader goes
by checkpoints: the documents that begin in a stretch are decoded from its
checkpoint on, and every stretch is held against its checksum, so memory is
bounded by a stretch and the longest document.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise
from quern.llm.rans import CHECKPOINT_STEPS, LANES, Coder, scale

END_ID = 1
#: A block is closed at this many ids; one longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Ids from one checkpoint to the next.
STRETCH = LANES * CHECKPOINT_STEPS
#: ASCII signs that this tokenizer never joins to a letter before them.
SIGNS = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: The sign by which byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = [chr(b) if b in _PRINTABLE else chr(0x100 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)]
#: Different white-space-free pieces whose ids a worker remembers.
REMEMBERED = 400_000


def _plain_letter(last: str) -> bool:
    """A Latin letter whose small form is one letter as well: not, for one, the capital I with a dot, which becomes two signs."""
    return last < "\u0250" and len(last.lower()) == 1 and last.lower().isalpha()


class PieceEncoder:
    """Encodes texts piece by piece: this tokenizer lower-cases, drops white space and never reaches across it.

    ``kind`` is the NumPy type of the ids it gives, of two bytes where the vocabulary allows.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        code, model, rest = self.kind[-2:].replace("u2", "H").replace("u4", "I"), self.tokenizer.model, []
        for piece in new:
            # Small Latin letters are one word that normalising leaves as it is: the library's merges alone decide.
            word = piece.decode()
            if not (piece.isalpha() and piece.islower()):
                if not (word.isalpha() and max(word) < "\u0250" and word == word.lower() and unicodedata.is_normalized("NFC", word)):
                    rest.append(piece)
                    continue
                word = "".join(map(BYTE_SIGNS.__getitem__, piece))
            self.known[piece] = array(code, [t.id for t in model.tokenize(word)]).tobytes()
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for piece, found in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                self.known[piece] = array(code, found.ids).tobytes()

    def pieces(self, new: list[bytes]) -> list[bytes]:
        """The ids of pieces without white space."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        found = list(map(known.get, new))
        missing = {p for p, ids in zip(new, found, strict=True) if ids is None}
        if missing:
            # Signs after a letter are split from it before anything is merged, so both parts are encoded alone.
            bare = {p: b for p in missing if (b := p.rstrip(SIGNS)) and b != p and b"<|" not in p and _plain_letter(b.decode()[-1])}
            parts = {*missing.difference(bare), *bare.values(), *(p[len(b) :] for p, b in bare.items())}
            self._learn(list(parts.difference(known)))
            for piece, word in bare.items():
                known[piece] = known[word] + known[piece[len(word) :]]
            found = [known[p] if ids is None else ids for p, ids in zip(new, found, strict=True)]
        return found

    def __call__(self, texts) -> list[bytes]:
        """The ids of an Arrow array of whole texts, none of them null."""
        import pyarrow.compute as pc

        # Special tokens are told from other text by their case.
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        ids = self.pieces(coded.dictionary.cast(pa.binary()).to_pylist())
        flat = np.frombuffer(b"".join(ids), self.kind)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
        starts, at = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        own = sizes[at]
        ends = np.concatenate(([0], np.cumsum(own)))
        out = flat[np.repeat(starts[at] - ends[:-1], own) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    return PieceEncoder(path)


def id_kind(tokenizer: str) -> str:
    return _encoder(tokenizer).kind


def ranges_by_size(texts, limit: int) -> list[tuple[int, int]]:
    """Ranges (from, to) of consecutive texts of an Arrow array with about ``limit`` bytes; one text at least."""
    import pyarrow.compute as pc

    block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = (np.flatnonzero(np.diff(block)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(texts)], strict=True)) if len(texts) else []


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID) -> DataFrame:
    """(id, ids): the ids of each whole text and an end id, as little-endian unsigned integers of ``id_kind(tokenizer)``."""
    end = np.array([end_id], id_kind(tokenizer)).tobytes()

    def batches(source):
        for batch in source:
            texts = batch.column(1).fill_null("").cast(pa.string())
            for a, b in ranges_by_size(texts, 8 << 20):
                ids = [x + end for x in _encoder(tokenizer)(texts.slice(a, b - a))]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


def count_ids(encoded: DataFrame, kind: str) -> DataFrame:
    """(token, n): how often each id occurs in all documents."""

    def counted(source):

        total = np.zeros(0, np.int64)
        for batch in source:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            own = np.bincount(held)
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return encoded.select("ids").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(encoded: DataFrame, path: str, kind: str = "<u4", files: int | None = None) -> None:
    """Write ``encoded``(id, ids binary of NumPy type ``kind``) under ``path`` in ascending id order, null ids first.

    Ids are range-partitioned, so files follow each other in order; rows with the
    same id follow each other by their ids' bytes. The frequency table has as
    many rows as the tokenizer has ids that occur, so the driver can hold it.
    """
    spark = encoded.sparkSession
    counts = count_ids(encoded, kind).toPandas()
    table = np.zeros(int(counts.token.max()) + 1 if len(counts) else 1, np.int64)
    table[counts.token.to_numpy(np.int64)] = counts.n.to_numpy(np.int64)
    freq = scale(table)
    at = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in at], "token long, freq long").coalesce(1).write.parquet(f"{path}/frequencies")

    def blocks(source):
        from pyspark import TaskContext

        coder, width, file = Coder(freq), np.dtype(kind).itemsize, TaskContext.get().partitionId()
        docs, parts, held, first, block = [], [], 0, 0, 0

        def close():
            raw = b"".join(parts)
            ids = np.frombuffer(raw, kind).astype("<u4")
            stream, places, states = coder.encode(ids.astype(np.int64))
            sums = [zlib.crc32(ids[at : at + STRETCH].tobytes()) for at in range(0, len(ids), STRETCH)]
            row = {"file": file, "block": block, "first": first, "documents": docs, "counts": [len(p) // width for p in parts], "n": len(ids), "stream": stream, "places": places, "states": states, "crc32s": sums}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = None
        for batch in source:
            if schema is None:
                key_type = batch.column(0).type
                schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("documents", pa.list_(key_type)), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("stream", pa.binary()), ("places", pa.list_(pa.int64())), ("states", pa.binary()), ("crc32s", pa.list_(pa.int64()))])
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(key)
                parts.append(ids)
                held += len(ids) // width
                if held >= BLOCK_IDS:
                    yield close()
                    docs, parts, first, held, block = [], [], first + held, 0, block + 1
        if docs:
            yield close()

    ranged = encoded.repartitionByRange(files, "id") if files else encoded.repartitionByRange("id")
    key_kind = encoded.schema["id"].dataType.simpleString()
    ranged.sortWithinPartitions("id", "ids").mapInArrow(blocks, f"file int, block long, first long, documents array<{key_kind}>, counts array<long>, n long, stream binary, places array<long>, states binary, crc32s array<long>").write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark, path: str) -> DataFrame:
    """(id, start, ids): the documents of the files; ``start`` counts the ids of all documents before.

    Raises if a block's ids do not have the checksum that was written.
    """
    table = spark.read.parquet(f"{path}/frequencies").toPandas()
    freq = np.zeros(int(table.token.max()) + 1 if len(table) else 1, np.int64)
    freq[table.token.to_numpy(np.int64)] = table.freq.to_numpy(np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    # A row per file, of which there are as many as partitions, whatever their size.
    sizes = {r.file: r.n for r in blocks.groupBy("file").agg(F.sum("n").alias("n")).collect()}
    before, total = {}, 0
    for file in sorted(sizes):
        before[file], total = total, total + sizes[file]
    kind = blocks.schema["documents"].dataType.elementType.simpleString()

    def decoded(source):

        coder = Coder(freq)
        for batch in source:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                # The documents that begin in a stretch, and the stretches up to the end of the last of them.
                bounds = np.searchsorted(starts, np.arange(len(row["places"]) + 1) * STRETCH)
                held, upto, raw = 0, 0, b""  # raw: the ids from stretch ``held`` to ``upto``
                for part in range(len(row["places"])):
                    a, b = int(bounds[part]), int(bounds[part + 1])
                    if a == b:
                        continue
                    raw = raw[4 * STRETCH * (part - held) :] if upto > part else b""
                    held, upto = part, max(part, upto)
                    got = [raw]
                    while upto * STRETCH < ends[b - 1]:
                        got.append(coder.decode(row["n"], row["stream"], row["places"], row["states"], upto).astype("<u4").tobytes())
                        if zlib.crc32(got[-1]) != row["crc32s"][upto]:
                            raise ValueError(f"file {row['file']}, block {row['block']}, checkpoint {upto}: checksum differs")
                        upto += 1
                    raw, shift = b"".join(got), part * STRETCH
                    ids = pa.array([raw[4 * (x - shift) : 4 * (y - shift)] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], pa.binary())
                    yield pa.record_batch([pa.array(row["documents"][a:b], batch.schema.field("documents").type.value_type), pa.array(starts[a:b] + (before[row["file"]] + row["first"])), ids], names=["id", "start", "ids"])

    return blocks.select("file", "block", "first", "documents", "counts", "n", "stream", "places", "states", "crc32s").mapInArrow(decoded, f"id {kind}, start long, ids binary")


def save_documents(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode all of ``docs`` once into the shared folder, then write them under ``path``.

    A null text counts as an empty one, which has the end id alone. Other columns
    are ignored, whatever their names; an empty table gives files without blocks.
    """
    write_tokens(materialise(encode(docs, tokenizer, id_col, text_col, end_id=end_id), "token-ids"), path, id_kind(tokenizer), files)
