"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by the length of the text, within a length by a hash of its
first characters, and rows of those groups that have two rows or more by the
SHA-256 of the whole text. So whole texts are hashed only where two texts of one
length begin alike.

One scan writes narrow rows (id, length, prefix hash), on which the surviving
groups are counted exactly, at any size. Texts are read a second time only to
hash the rows of surviving groups, and never shuffled for it unless the table
of surviving groups is too large for Spark to broadcast it.

Groups that hold very many rows are joined by broadcast (see quern/skew.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import materialise, text_or_empty, with_payload
from quern.skew import join_groups, without_groups


def _sized(text: Column, prefix_chars: int) -> list[Column]:
    size = F.octet_length(text)
    return [size.alias("size"), F.xxhash64(size, F.substring(text, 1, prefix_chars)).alias("prefix")]


def _surviving(narrow: DataFrame) -> DataFrame:
    """Materialised (of_size, of_prefix, n): groups of one length and prefix hash with two rows or more."""
    groups = narrow.groupBy("size", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(groups.select(F.col("size").alias("of_size"), F.col("prefix").alias("of_prefix"), "n"), "dedup-groups")


def _groups(hashed: DataFrame) -> DataFrame:
    """Materialised (hash, keep, n) of texts that more than one row of ``hashed``(full_hash, id, m) has."""
    counted = hashed.groupBy("full_hash").agg(F.max("id").alias("keep"), F.sum("m").alias("n"))
    return materialise(counted.where("n > 1").select(F.col("full_hash").alias("hash"), "keep", "n"), "dedup-copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = 256, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``full_hash``.

    Of equal texts the row with the largest id stays. A null text counts as an
    empty one, a null id as smaller than any. Of rows that repeat both id and
    text one stays. ``full_hash`` is null where an earlier round already proved
    the text unique. ``digest`` adds ``text_sha256`` of every text; it is taken
    with the first scan, and the texts are then read once. Texts may be of any
    length. Other columns of ``docs`` are ignored, whatever their names; an empty
    table gives an empty result.
    """
    text = text_or_empty(text_col)
    sha = [F.sha2(text, 256).alias("text_sha256")] if digest else []
    narrow = materialise(docs.select(F.col(id_col).alias("id"), *_sized(text, prefix_chars), *sha), "dedup-rows")
    total = narrow.count()
    surviving = _surviving(narrow)
    same = (F.col("size") == F.col("of_size")) & (F.col("prefix") == F.col("of_prefix"))
    if digest:
        source, full = narrow, F.col("text_sha256")
    else:
        source, full = docs.select(F.col(id_col).alias("id"), *_sized(text, prefix_chars), text.alias("text")), F.sha2("text", 256)
    # Rows that repeat id and text differ in nothing that is returned: they are one row with their number until the end.
    hashed = join_groups(source, surviving, same, total).select("id", full.alias("full_hash"))
    hashed = materialise(hashed.groupBy("full_hash", "id").agg(F.count("*").alias("m")), "dedup-hashes")
    groups = _groups(hashed)
    found = join_groups(hashed, groups, F.col("full_hash") == F.col("hash"), total)
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("nth")
    copies = found.select("id", "keep", "n", "full_hash", nth).select("id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep").eqNullSafe(F.col("id")) & (F.col("nth") == 1)).alias("kept"), "full_hash", *([F.col("full_hash").alias("text_sha256")] if digest else []))
    own = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    single = without_groups(hashed, groups, F.col("full_hash") == F.col("hash"), total).select("id", *own, "full_hash", *([F.col("full_hash").alias("text_sha256")] if digest else []))
    alone = without_groups(narrow, surviving, same, total).select("id", *own, F.lit(None).cast("string").alias("full_hash"), *(["text_sha256"] if digest else []))
    return copies.unionByName(single).unionByName(alone).withColumnRenamed("id", id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts the row with the largest id stays (null is smaller than any
    id), of rows that repeat both id and text any one. A null text counts as an
    empty one. Texts may be of any length; an empty table gives an empty result.
    Only rows of surviving groups meet the join that drops copies; its key has the
    id, so a large group of copies is dealt evenly.
    """
    text = text_or_empty(text_col)
    narrow = materialise(docs.select(F.col(id_col).alias("id"), *_sized(text, prefix_chars)), "dedup-rows")
    total = narrow.count()
    surviving = _surviving(narrow)
    same = (F.col("size") == F.col("of_size")) & (F.col("prefix") == F.col("of_prefix"))
    rows = with_payload(docs, F.col(id_col).alias("id"), *_sized(text, prefix_chars), text.alias("text"))
    hashed = join_groups(rows.drop("payload"), surviving, same, total).select("id", F.sha2("text", 256).alias("full_hash"))
    hashed = materialise(hashed.groupBy("full_hash", "id").agg(F.count("*").alias("m")), "dedup-hashes")
    groups = _groups(hashed)
    found = join_groups(hashed, groups, F.col("full_hash") == F.col("hash"), total)
    stays = F.col("keep").eqNullSafe(F.col("id"))
    dropped = materialise(found.where(~stays | (F.col("m") > 1)).select(F.struct("full_hash", "id").alias("of"), stays.alias("stays")), "dedup-dropped")
    shared = join_groups(rows, surviving, same, total).select("payload", F.struct(F.sha2("text", 256).alias("full_hash"), F.col("id").alias("id")).alias("mark"))
    kept = without_groups(rows, surviving, same, total).select("payload").unionByName(shared.join(dropped, F.col("mark") == F.col("of"), "left_anti").select("payload"))
    repeated = dropped.where("stays")
    if repeated.take(1):
        # Rows that repeat id and text: each task sends one of each on.
        first = F.row_number().over(Window.partitionBy("mark").orderBy(F.lit(1)))
        kept = kept.unionByName(shared.join(repeated, F.col("mark") == F.col("of"), "left_semi").withColumn("nth", first).where("nth = 1").select("payload"))
    return kept.select("payload.*")
