"""Line dedup, with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed; the distinct
documents of each hash are counted; lines whose hash too many documents share
are dropped except in the last of these documents; the lines that stay are put
together again by position.

Lines are normalised once; only their hashes, ids and positions are written and
shuffled. Texts meet the positions of their dropped lines once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, text_or_empty
from quern.skew import join_groups

#: What is stripped from both ends of a line, and the letters that are made small.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, in small letters."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), CAPITALS, SMALL)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, digest, pos, low, high) of every line whose key is long enough; the key's hash has 128 bits."""
    text = text_or_empty(text_col)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), _lines(text).alias("lines"))
    lines = lines.select("id", "digest", F.posexplode("lines").alias("pos", "line")).where(F.char_length("line") >= min_chars)
    keyed = lines.select("id", "digest", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("id", "digest", "pos", F.xxhash64("key").alias("low"), F.xxhash64(F.lit(1), "key").alias("high"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(of_low, of_high, last, n) of each hash that ``min_docs`` ids or more have; n is its number of lines.

    Lines of one id are one before documents are counted, so no task gets a line
    as often as documents have it: counts are summed up in each task first.
    """
    once = lines.groupBy("low", "high", "id").agg(F.count("*").alias("m"))
    counted = once.groupBy("low", "high").agg(F.count("*").alias("documents"), F.max("id").alias("last"), F.sum("m").alias("n"))
    return counted.where(F.col("documents") >= min_docs).select(F.col("low").alias("of_low"), F.col("high").alias("of_high"), "last", "n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    r"""One row per row of ``docs``: id, ``text`` without its dropped lines, ``n_lines``, ``n_dropped``.

    A text is split at \n. A line's key is the line without white space at both
    ends and with A-Z in small letters. Keys of ``min_chars`` code points or more
    that ``min_docs`` documents or more have lose all their lines except in the
    document with the largest id; there all of them stay.

    A document is an id: rows that repeat an id count as one document, are judged
    each by its own text, and both keep what the last document keeps. A null id is
    one document and smaller than any other. A null text counts as an empty one,
    which has one empty line. Texts may be of any length: a row's own lines are
    held at once, never those of several rows. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    lines = materialise(_hashed_lines(docs, id_col, text_col, min_chars), "hashed-lines")
    repeated = materialise(repeated_lines(lines, min_docs), "repeated-lines")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    same = (F.col("low") == F.col("of_low")) & (F.col("high") == F.col("of_high"))
    lost = join_groups(lines, repeated, same, total).where(~F.col("id").eqNullSafe(F.col("last")))
    dropped = lost.groupBy(F.col("id").alias("of_id"), F.col("digest").alias("of_digest")).agg(F.collect_set("pos").alias("dropped"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    found = rows.join(dropped, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    # The lines are bound once as x, so that a text is not split again for every position.
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda p: x[p]), "\n")
    parts = F.transform(F.array(_lines(F.col("text"))), lambda x: F.struct(F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept(x)).alias("text"), F.size(x).cast("long").alias("n_lines")))[0]
    out = found.select("id", parts.alias("parts"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(F.col("id").alias(id_col), "parts.text", "parts.n_lines", "n_dropped")
