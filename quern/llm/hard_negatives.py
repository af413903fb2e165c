"""Hard-negative mining: for each anchor and each of its best positives, the best rows of other labels inside a window of scores.

Scores are inner products of integer vectors. Anchors are taken a block at a time
and sent to all tasks; a task multiplies tiles of anchors with tiles of rows by
Strassen's recursion and keeps, for each anchor, a heap of the best positives,
then, once these are known from all tasks, a heap for the window of each positive.
Heaps of tiles are merged in the task, heaps of tasks by a window over
(anchor, positive), so a task sends on as many rows as the heaps have places.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import materialise, released, shared_dir

#: Anchors that are multiplied with all rows in one pass, and the sides of a tile. ROWS must be a power of two.
BLOCK, ANCHORS, ROWS = 8192, 256, 2048
#: The recursion ends when a side has this length or less.
LEAF = 16
#: Integers up to here are exact as doubles.
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min
#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b: in doubles where no partial sum can leave the integers that these hold exactly."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if levels == 0:
        return _product(a, b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _strassen(a11 + a22, b11 + b22, levels - 1)
    p2 = _strassen(a21 + a22, b11, levels - 1)
    p3 = _strassen(a11, b12 - b22, levels - 1)
    p4 = _strassen(a22, b21 - b11, levels - 1)
    p5 = _strassen(a11 + a12, b22, levels - 1)
    p6 = _strassen(a21 - a11, b11 + b12, levels - 1)
    p7 = _strassen(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, exact if the result fits int64: additions in between may wrap around, which cancels out."""
    (m, k), n = a.shape, b.shape[1]
    levels = max(0, math.ceil(math.log2(max(1, min(m, k, n)) / leaf)))
    step = 1 << levels
    pad = lambda x, rows, columns: np.pad(x, ((0, -rows % step), (0, -columns % step)))
    return _strassen(pad(a, m, k), pad(b, k, n), levels)[:m, :n]


def quantised(vectors: list, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of an Arrow list column without nulls as an int64 matrix; shorter vectors are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() >= 1 << 62:
        raise OverflowError(f"a component is beyond {(1 << 62) // scale}: its scores do not fit 64 bits")
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.astype(np.int64)
    return out


def merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` best of two heaps along the last axis: larger scores first, of equal ones the smaller id; NONE marks free places."""
    scores, ids = np.concatenate([scores, more], -1), np.concatenate([ids, more_ids], -1)
    best = np.lexsort((ids, ~scores), axis=-1)[..., :size]
    return np.take_along_axis(scores, best, -1), np.take_along_axis(ids, best, -1)


class Tiles:
    """The scores of a block's anchors with rows, a tile at a time."""

    def __init__(self, ids, labels, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors

    def keys(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, headroom: int):
        """For each tile: its anchors, the rows' ids in order, keys that sort by score and then by smaller id, and whether labels agree and ids differ.

        A key is score * ROWS + a place that falls as ids rise. ``headroom`` is the largest factor that scores are multiplied with later.
        """
        order = np.argsort(ids, kind="stable")
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        width = max(vectors.shape[1], self.vectors.shape[1])
        most = width * int(np.abs(vectors).max(initial=0)) * int(np.abs(self.vectors).max(initial=0))
        if most * max(headroom, ROWS) >= 1 << 63:
            raise OverflowError("components are too large: scores do not fit 64 bits")
        right = np.ascontiguousarray(np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))).T)
        place = ROWS - 1 - np.arange(len(ids))
        for at in range(0, len(self.ids), ANCHORS):
            own = slice(at, at + ANCHORS)
            left = np.pad(self.vectors[own], ((0, 0), (0, width - self.vectors.shape[1])))
            same = self.labels[own, None] == labels
            yield own, ids, strassen(left, right) * ROWS + place, same & (self.ids[own, None] != ids), ~same

    def read(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of keys; NONE stays."""
        free = keys == NONE
        if not len(ids):
            return keys, np.full(keys.shape, NO_ID)
        return np.where(free, NONE, keys >> (ROWS.bit_length() - 1)), np.where(free, NO_ID, ids[np.where(free, 0, ROWS - 1 - (keys & (ROWS - 1)))])


def _best(keys: np.ndarray, size: int) -> np.ndarray:
    """The largest ``size`` keys of each row, filled up with NONE."""
    if keys.shape[1] < size:
        keys = np.pad(keys, ((0, 0), (0, size - keys.shape[1])), constant_values=NONE)
    return np.partition(keys, keys.shape[1] - size, axis=1)[:, keys.shape[1] - size :]


def _windows(keys: np.ndarray, floors: np.ndarray, ceilings: np.ndarray, size: int) -> np.ndarray:
    """For each row of sorted keys and each of its windows of scores (floor to ceiling) the largest ``size`` keys, filled up with NONE."""
    ends = np.stack([np.searchsorted(row, c * ROWS + ROWS - 1, side="right") for row, c in zip(keys, ceilings, strict=True)])
    at = ends[:, :, None] - 1 - np.arange(size)
    found = keys[np.arange(len(keys))[:, None, None], np.maximum(at, 0)]
    return np.where((at >= 0) & (found != NONE) & (found >= floors[:, :, None] * ROWS), found, NONE)


def _rows(batches, scale: int):
    """Ids, labels and vectors of at most ROWS rows of Arrow batches (id, label, vector)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0).fill_null(NO_ID).to_numpy(), part.column(1).to_numpy(), quantised(part.column(2), scale)


def mine_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchors`` holds.

    A component x counts as floor(scale * x). An anchor's positives are the
    ``positives`` rows of its label with the largest inner products, the window of
    a positive the rows of other labels with low % to high % of its score; of these
    the best ``negatives`` are returned, ranks from 1. Of equal scores the smaller
    id comes first. Ids are longs, labels whole numbers.

    Rows with a null label or vector, or with a null or non-finite component, take
    no part. A null id comes after all others; such a row is no anchor unless
    ``anchors`` says so. An anchor's own id is not among its positives; rows that
    repeat count each, also as anchors. Vectors of different lengths meet with
    zeros at the shorter one's end. An anchor without positives, or a window
    without rows, gives no row. Components so large that scores leave 64 bits
    raise OverflowError. Other columns are ignored, whatever their names; an empty
    table gives an empty result.

    Every row is scored against every anchor, BLOCK anchors a pass; a block and its
    positives are all that the driver holds. Passes run one after the other.
    """
    spark = rows.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    of = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")]
    every = valid.select(*of)
    chosen = materialise(valid.where(anchors).select(*of), "anchors")
    blocks = math.ceil(chosen.count() / BLOCK)
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    dealt = materialise(chosen.repartition(blocks).withColumn("block", F.spark_partition_id()), "anchor-blocks") if blocks else None
    for block in range(blocks):
        held = dealt.where(F.col("block") == block).select("id", "label", "vector").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        vectors = held.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if hasattr(vectors, "chunk") else vectors
        sent = spark.sparkContext.broadcast((held.column("id").fill_null(NO_ID).to_numpy(), held.column("label").to_numpy(), quantised(vectors, scale)))
        best = _positives(every, sent, scale, positives, max(low, high, 100))
        found = _negatives(every, sent, best, scale, negatives, low, high)
        null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        found.select(null("anchor_id"), null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(schema).parquet(path)


def _positives(every: DataFrame, sent, scale: int, size: int, headroom: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best ``size`` positives of each anchor of a block, over all rows."""

    def heaps(batches):
        import pyarrow as pa

        ids, labels, vectors = sent.value
        tiles, scores, held = Tiles(ids, labels, vectors), np.full((len(ids), size), NONE), np.full((len(ids), size), NO_ID)
        for part in _rows(batches, scale):
            for own, row_ids, keys, positive, _ in tiles.keys(*part, headroom):
                more = tiles.read(_best(np.where(positive, keys, NONE), size), row_ids)
                scores[own], held[own] = merge(scores[own], held[own], *more, size)
        anchor, nth = np.nonzero(scores != NONE)
        yield pa.record_batch([pa.array(anchor), pa.array(scores[anchor, nth]), pa.array(held[anchor, nth])], names=["anchor", "score", "id"])

    found = every.mapInArrow(released(heaps), "anchor long, score long, id long")
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    top = found.withColumn("nth", nth).where(F.col("nth") <= size).toPandas()
    scores, ids = np.full((len(sent.value[0]), size), NONE), np.full((len(sent.value[0]), size), NO_ID)
    at = top.anchor.to_numpy(np.int64), top.nth.to_numpy(np.int64) - 1
    scores[at], ids[at] = top.score.to_numpy(np.int64), top.id.to_numpy(np.int64)
    return scores, ids


def _negatives(every: DataFrame, sent, best: tuple[np.ndarray, np.ndarray], scale: int, size: int, low: int, high: int) -> DataFrame:
    """The best ``size`` rows in the window of each anchor and positive, over all rows."""
    known = best[0] != NONE
    told = np.where(known, best[0], 0)
    # An empty window where there is no positive.
    floors, ceilings = np.where(known, -((-low * told) // 100), 1), np.where(known, (high * told) // 100, 0)
    more = every.sparkSession.sparkContext.broadcast((*best, floors, ceilings))

    def heaps(batches):
        import pyarrow as pa

        ids, labels, vectors = sent.value
        told, told_ids, least, most = more.value
        shape = (*told.shape, size)
        tiles, scores, held = Tiles(ids, labels, vectors), np.full(shape, NONE), np.full(shape, NO_ID)
        for part in _rows(batches, scale):
            for own, row_ids, keys, _, negative in tiles.keys(*part, max(low, high, 100)):
                ordered = np.sort(np.where(negative, keys, NONE), axis=1)
                found = tiles.read(_windows(ordered, least[own], most[own], size), row_ids)
                scores[own], held[own] = merge(scores[own], held[own], *found, size)
        a, p, k = np.nonzero(scores != NONE)
        columns = {"anchor": a, "nth": p, "anchor_id": ids[a], "positive_id": told_ids[a, p], "positive_score": told[a, p], "negative_id": held[a, p, k], "negative_score": scores[a, p, k]}
        yield pa.record_batch([pa.array(x) for x in columns.values()], names=list(columns))

    found = every.mapInArrow(released(heaps), "anchor long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= size)
