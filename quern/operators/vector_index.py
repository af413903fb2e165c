"""An inverted-file index of vectors: cells of k-means, residuals as bytes, exact scores for the best.

Vectors count by direction (cosine). Centres are fitted on a bounded sample; every
vector then goes to its nearest centre's cell and is kept there as one byte a
component of what the centre leaves over, beside the vector itself. Rows are packed
into tiles of at most TILE vectors, so that a cell with most of all vectors is many
tiles.

A search scores the tiles of each query's ``probes`` nearest cells by their bytes,
keeps the best ``rerank`` and gives these their exact scores. Tiles meet queries in
blocks of BLOCK rows and PART queries or so, however many rows or queries a cell has;
a block keeps a query's ``rerank`` best of all its tiles, so what is left to sort
follows the blocks, not the cells, in partitions of at most MERGED rows. For the exact
scores a tile comes once for each PART of the queries that ask for it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.storage import settle

#: Cells at most, rows of the sample for each cell, vectors in a tile, queries in a group, folders of the tiles.
MAX_CELLS, SAMPLE, TILE, PART, SHELVES = 4096, 64, 2048, 4096, 64
#: Rows of the index in a block, queries that a block scores at a time, candidates in a partition where blocks are merged.
BLOCK, SLICE, MERGED = 1 << 16, 512, 1 << 19
#: Blocks and parts of the queries that small tables are cut into as well, if these have so many rows or queries each.
SPREAD, SPREAD_ROWS, SPREAD_QUERIES = 8, 4096, 256
#: Probed cells up to which a search names them to the scan.
NAMED = 1024
TILES = "cell int, tile long, n int, keys array<long>, codes binary, scales binary, vectors binary, shelf int"


def _raw(column) -> np.ndarray:
    """An Arrow list column without nulls, whose lists have one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return _unit(_raw(column)).astype(np.float32)


def _directed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the rows that have a direction: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return rows.where(good).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"))


def fit_centres(rows: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """``cells`` centres at most by k-means on about SAMPLE * cells of ``rows``(key, vector), chosen by a hash of the key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = rows.count()
    share = min(1.0, SAMPLE * cells / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    held = sample.persist()  # k-means reads it again and again; it is bounded, so memory can hold it
    model = KMeans(k=max(2, cells), seed=seed, maxIter=15, distanceMeasure="cosine").fit(held)
    held.unpersist()
    return np.array(model.clusterCenters(), np.float32)


def build_vectors(rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> int:
    """Write an index of ``rows`` under ``path``; returns its number of cells.

    About the square root of the rows is the number of cells if none is given.
    Rows without a key or without a direction are left out, since no cosine is
    defined for them; all others are indexed. Keys are longs, vectors of one length.
    """
    spark = rows.sparkSession
    good = _directed(rows, key, vector)
    total = good.count()
    wanted = min(MAX_CELLS, cells or math.ceil(math.sqrt(total)))
    centres = fit_centres(good, wanted) if total else np.zeros((0, 1), np.float32)
    spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "cell int, centre array<float>").coalesce(1).write.parquet(f"{path}/centres")

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cell = np.argmax(_matrix(part.column(1)) @ centres.T, axis=1).astype(np.int32)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cell)], names=["key", "vector", "cell"])

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, n, held, own = TaskContext.get().partitionId() << 32, 0, [], None

        def close():
            keys, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            left = _unit(vectors) - centres[own]
            scales = np.maximum(np.abs(left).max(axis=1), 1e-12) / 127
            codes = np.rint(left / scales[:, None]).astype(np.int8)
            columns = [[own], [task + n], [len(keys)], [keys.tolist()], [codes.tobytes()], [scales.astype("<f4").tobytes()], [vectors.astype("<f4").tobytes()], [own % SHELVES]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        names = ["cell", "tile", "n", "keys", "codes", "scales", "vectors", "shelf"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        for batch in batches:
            cell, keys, rows = batch.column(2).to_numpy(), batch.column(0).to_numpy(), _raw(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and cell[a] != own:
                    yield close()
                    held, n = [], n + 1
                own = int(cell[a])
                for at in range(a, b, TILE):
                    held.append((keys[at : min(b, at + TILE)], rows[at : min(b, at + TILE)]))
                    if sum(len(x[0]) for x in held) >= TILE:
                        yield close()
                        held, n = [], n + 1
        if held:
            yield close()

    # Dealt by cell and a salt, so that no task gets all rows of a large cell.
    salt = F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(total / (64 * TILE)))))
    cut = good.mapInArrow(placed, "key long, vector array<float>, cell int").repartition("cell", salt).sortWithinPartitions("cell", "key")
    tiles = cut.mapInArrow(packed, TILES)
    tiles.write.partitionBy("shelf").parquet(f"{path}/tiles")
    return len(centres)


def search_vectors(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", *, probes: int = 8, rerank: int = 100) -> DataFrame:
    """(query, rank, key, score): the k rows of the index most similar to each query by cosine (6 digits; of equal ones the smaller key).

    Looks at the ``probes`` nearest cells of a query, scores their rows by bytes and
    the ``rerank`` best exactly; with all cells probed only the bytes' rounding can
    hide a row. Queries without a direction find nothing. A query that is in the
    index finds itself. Keys of queries are unique.
    """
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], np.float32)
    asked = _directed(queries, key, vector)
    empty = "query long, rank int, key long, score double"
    if not len(centres):
        return spark.createDataFrame([], empty)
    most = min(probes, len(centres))

    tiles = spark.read.schema(TILES).parquet(f"{path}/tiles")
    total, wide = tiles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], asked.count()
    over = max(1, math.ceil(total / BLOCK), min(SPREAD, total // SPREAD_ROWS))  # cells share a block by their number
    least = max(1, min(SPREAD, wide // SPREAD_QUERIES))

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scores = _matrix(part.column(1)) @ centres.T
                cells = np.argpartition(-scores, most - 1, axis=1)[:, :most].astype(np.int32)
                cells = np.take_along_axis(cells, np.argsort(cells % over, axis=1, kind="stable"), 1).ravel()
                row = np.repeat(np.arange(part.num_rows), most)
                cuts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(cells % over) != 0)]) if len(row) else row
                lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(row)], pa.int32()), pa.array(cells))
                yield pa.record_batch([part.column(0).take(pa.array(row[cuts])), part.column(1).take(pa.array(row[cuts])), pa.array(cells[cuts] % over, pa.int32()), lists], names=["query", "vector", "block", "cells"])

    probed = settle(asked.mapInArrow(nearest, "query long, vector array<float>, block int, cells array<int>"), "probes")
    named = [r.cell for r in probed.select(F.explode("cells").alias("cell")).distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        tiles = tiles.where(F.col("cell").isin(*named) & F.col("shelf").isin(*{c % SHELVES for c in named}) if named else F.lit(False))
    # A block with a large cell is cut by tiles, one that many queries probe by queries.
    held = tiles.groupBy((F.col("cell") % over).alias("block")).agg(F.ceil(F.sum("n") / (2 * BLOCK)).cast("int").alias("cuts"))
    sizes = settle(probed.groupBy("block").agg(F.count("*").alias("asked")).join(held, "block").select("block", "asked", "cuts", F.greatest(F.ceil(F.col("asked") / PART), F.lit(least)).cast("int").alias("parts")), "blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    coded = ["cell", "tile", "n", "keys", "codes", "scales"]
    none = lambda names: [F.lit(None).cast(tiles.schema[c].dataType).alias(c) for c in names]
    meets = probed.join(sizes, "block").select("block", upto("cuts").alias("cut"), F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"), "query", "vector", "cells", *none(coded))
    of_tiles = tiles.withColumn("block", F.col("cell") % over).join(sizes, "block").select("block", F.pmod(F.xxhash64("tile"), F.col("cuts")).cast("int").alias("cut"), upto("parts").alias("part"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("array<int>").alias("cells"), *coded)

    def scored(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        own, told = table.filter(pc.is_valid(table.column("n"))), table.filter(pc.is_valid(table.column("query")))
        if not told.num_rows or not own.num_rows:
            return schema.empty_table()
        lists, here = told.column("cells").combine_chunks(), np.unique(own.column("cell").to_numpy())
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(here, flat), len(here) - 1)
        probes_cell = np.zeros((told.num_rows, len(here)), bool)
        probes_cell[row[here[at] == flat], at[here[at] == flat]] = True
        vectors, asked = _matrix(told.column("vector").combine_chunks()), told.column("query").to_numpy()
        opened = []
        for r in own.select(coded).to_batches():
            for cell, tile, n, keys, codes, scales in zip(*(r.column(c) for c in range(6)), strict=True):
                codes = np.frombuffer(codes.as_buffer(), np.int8).reshape(n.as_py(), -1)
                opened.append((int(np.searchsorted(here, cell.as_py())), cell.as_py(), tile.as_py(), keys.values.to_numpy(), codes, np.frombuffer(scales.as_buffer(), "<f4")))
        def merged(best, pending, bound):
            best = [np.concatenate(p) for p in zip(best, *pending, strict=True)]
            order = np.lexsort((best[3], -best[4], best[0]))
            nth = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
            best = [p[order[nth < rerank]] for p in best]
            full = nth[nth < rerank] == rerank - 1
            bound[best[0][full]] = best[4][full]
            return best

        out = []
        for cut in range(0, len(asked), SLICE):
            mine = vectors[cut : cut + SLICE]
            best, pending, waiting = [np.zeros(0, f.type.to_pandas_dtype()) for f in schema], [], 0
            bound = np.full(len(mine), -np.inf, np.float32)  # the rerank-th score of each query, once it has as many
            for place, cell, tile, keys, codes, scales in opened:
                some = np.flatnonzero(probes_cell[cut : cut + SLICE, place])
                if not len(some):
                    continue
                scores = mine[some] @ centres[cell][:, None] + (mine[some] @ codes.astype(np.float32).T) * scales
                low = bound[some]
                if len(keys) > rerank and np.isneginf(low).any():
                    low = np.maximum(low, np.partition(scores, -rerank, axis=1)[:, -rerank])
                q, x = np.nonzero(scores >= low[:, None])
                if not len(q):
                    continue
                pending.append([some[q], np.full(len(q), tile), x, keys[x], scores[q, x]])
                waiting += len(q)
                if waiting >= rerank * len(mine):  # sorted as seldom as that, since a bound still lets some through
                    best, pending, waiting = merged(best, pending, bound), [], 0
            best = merged(best, pending, bound)
            out.append(pa.table([pa.array(c, f.type) for c, f in zip([asked[cut + best[0].astype(np.int64)], *best[1:]], schema, strict=True)], schema=schema))
        return pa.concat_tables(out)

    import pyarrow as pa

    schema = pa.schema([("query", pa.int64()), ("tile", pa.int64()), ("at", pa.int32()), ("key", pa.int64()), ("near", pa.float64())])
    found = meets.unionByName(of_tiles).groupBy("block", "cut", "part").applyInArrow(scored, "query long, tile long, at int, key long, near double")
    rows = sizes.agg(F.coalesce(F.sum(F.col("asked") * F.col("cuts")), F.lit(0))).first()[0] * rerank
    dealt = found.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / MERGED)), "query")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "key"))
    best = settle(dealt.withColumn("nth", nth).where(F.col("nth") <= rerank).select("query", "tile", "at", "key"), "candidates")
    # Exact scores: a tile's vectors meet the queries that it has candidates for, again in parts.
    parts = settle(best.groupBy("tile").agg(F.ceil(F.count("*") / PART).cast("int").alias("slots")), "slots")
    wanted = best.groupBy("tile", "query").agg(F.collect_list(F.struct("at", "key")).alias("rows")).join(asked.select(F.col("key").alias("query"), "vector"), "query")
    wanted = wanted.join(parts, "tile").withColumn("slot", F.pmod(F.xxhash64("query"), F.col("slots")).cast("int"))
    full = tiles.join(parts, "tile").select("tile", upto("slots").alias("slot"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("array<struct<at:int,key:long>>").alias("rows"), "n", "vectors")
    both = wanted.select("tile", "slot", "query", "vector", "rows", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("vectors")).unionByName(full)

    def exact(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        own, told = table.filter(pc.is_valid(table.column("n"))), table.filter(pc.is_valid(table.column("query")))
        if not told.num_rows:  # no query of the tile fell into this slot
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "key", "score"])
        rows = np.frombuffer(own.column("vectors")[0].as_py(), "<f4").reshape(own.column("n")[0].as_py(), -1)
        lists = told.column("rows").combine_chunks()
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        vectors = np.repeat(_unit(_raw(told.column("vector").combine_chunks())), sizes, axis=0)
        scores = np.einsum("ij,ij->i", _unit(rows[flat.field("at").to_numpy()]), vectors)
        return pa.table([pa.array(np.repeat(told.column("query").to_numpy(), sizes)), flat.field("key"), pa.array(np.round(scores, 6))], names=["query", "key", "score"])

    scores = both.groupBy("tile", "slot").applyInArrow(exact, "query long, key long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def probes_for(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", *, target: float = 0.95, sample: int = 100) -> int:
    """The least number of probes that finds ``target`` of the k nearest rows, measured on about ``sample`` of ``queries``.

    The sample is searched in all cells; each row found counts at the rank that its
    cell has among the centres by nearness to the query. How many cells a search has
    to look at depends on how far the vectors fall into clusters at all.
    """
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], np.float32)
    asked = _directed(queries, key, vector)
    share = min(1.0, sample / max(1, asked.count()))
    some = settle(asked.where(F.pmod(F.xxhash64("key", F.lit("probe")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1), "probe-sample")
    if not len(centres) or not some.take(1):
        return 1
    nearest = search_vectors(spark, path, some, k, "key", "vector", probes=len(centres))
    cells = spark.read.schema(TILES).parquet(f"{path}/tiles").select("cell", F.explode("keys").alias("key"))
    found = nearest.select("query", "key").join(cells, "key").join(some.select(F.col("key").alias("query"), "vector"), "query")
    rows = found.select("vector", "cell").toPandas()  # about sample * k
    scores = _unit(np.array(rows.vector.tolist(), np.float32)).astype(np.float32) @ centres.T
    ranks = (scores > scores[np.arange(len(rows)), rows.cell.to_numpy()][:, None]).sum(axis=1)
    return int(np.quantile(ranks, target, method="higher")) + 1
