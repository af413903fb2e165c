"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every (key, shard) pair has a pseudo-random draw u in (0, 1) from an MD5 hash;
a row goes to the shard with the largest ln(u) / weight. A further shard leaves
the other draws as they are, so it only takes rows, and takes its share of them
from all shards alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType
from pyspark.sql.window import Window

from quern.llm.common import materialise, text_or_empty, with_payload

#: Hex digits of a draw: 52 bits, which a double holds exactly.
DRAW_DIGITS = 13
#: Hex digits of the bucket in which slots are numbered: 4096 buckets a shard.
BUCKET_DIGITS = 3


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def draws(key: Column, weights: Sequence[float]) -> list[Column]:
    """For each shard a struct (score, -shard); the largest wins, of equal scores the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one a shard")
    even = len(set(weights)) == 1
    out = []
    for shard, weight in enumerate(weights):
        drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DRAW_DIGITS), 16, 10).cast("long")
        score = drawn if even else F.log((drawn + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))) / F.lit(float(weight))
        out.append(F.struct(score.alias("score"), F.lit(-shard).alias("minus")))
    return out


def _best(scores: list[Column]) -> Column:
    return -F.array_max(F.array(*scores))["minus"]


def shard_columns(key: Column, weights: Sequence[float], grown_weight: float | None = None) -> Column:
    """A struct of ``shard`` and, with ``grown_weight``, ``grown_shard``: the shard if one more of that weight is added."""
    scores = draws(key, [*weights, grown_weight] if grown_weight is not None else list(weights))
    best = F.array_max(F.array(*scores[: len(weights)]))
    if grown_weight is None:
        return F.struct((-best["minus"]).alias("shard"))
    # Draws are an array that is evaluated once and passed on, so that no hash is made twice.
    every = F.transform(F.array(F.array(*scores)), lambda x: F.struct(F.array_max(F.slice(x, 1, len(weights))).alias("old"), F.array_max(x).alias("new")))[0]
    return F.transform(F.array(every), lambda x: F.struct((-x["old"]["minus"]).alias("shard"), (-x["new"]["minus"]).alias("grown_shard")))[0]


def assign_shards(rows: DataFrame, id_col: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Adds ``shard`` and, with ``grown_weight``, ``grown_shard``; columns of these names in ``rows`` are an error."""
    names = ["shard"] if grown_weight is None else ["shard", "grown_shard"]
    if clash := {c.lower() for c in rows.columns}.intersection(names):
        raise ValueError(f"rename the columns {sorted(clash)} first")
    held = with_payload(rows, shard_columns(_key(id_col), weights, grown_weight).alias("drawn"))
    return held.select("payload.*", *[F.col(f"drawn.{n}") for n in names])


def shard_documents(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float | None = 1.0) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 16. Slots count from
    0 within a shard without gaps: rows are numbered within buckets of their key's
    hash, and each bucket starts where those before it end. The table of starts
    has ``len(weights)`` x 4096 rows at most, whatever the input, so it is fit to
    broadcast. Shards are drawn once and written with ids, sizes and checksums. A
    null id is a key of its own, rows that repeat an id share its shard and bucket
    and are sorted there on disk. Texts may be of any length. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.md5(_key(id_col)), 1, BUCKET_DIGITS).alias("bucket"), shard_columns(_key(id_col), weights, grown_weight).alias("drawn"))
    rows = materialise(rows.select("id", "size", "text_crc32", "bucket", "drawn.*"), "placed")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32")
    numbered = rows.withColumn("within", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("within")).cast("long").alias("slot"),
        F.col("grown_shard") if grown_weight is not None else F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id", files_per_shard: int = 8, name: str = "shard") -> None:
    """Write the rows of ``docs`` under ``path/<name>=N``, each shard in ``files_per_shard`` files or fewer.

    ``name`` must not be a column of ``docs``. Null ids share a shard, an empty table writes no shard.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name}: choose another name")
    hashed = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]  # maps and variants have no hash
    salt = F.pmod(F.xxhash64(_key(id_col), *hashed), F.lit(files_per_shard))
    placed = with_payload(docs, shard_columns(_key(id_col), weights)["shard"].alias("at"), salt.alias("salt"))
    placed.repartition(len(weights) * files_per_shard, "at", "salt").select("payload.*", F.col("at").alias(name)).write.partitionBy(name).parquet(path)


def brute_shard(key: str, weights: Sequence[float]) -> int:
    """The shard of a key by the definition, for tests."""
    import hashlib
    import math

    def better(best: tuple, shard: int) -> tuple:
        u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:DRAW_DIGITS], 16) + 0.5) / 16**DRAW_DIGITS
        return max(best, (math.log(u) / weights[shard], -shard))

    return -reduce(better, range(len(weights)), (-math.inf, 0))[1]
