"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits.

Candidates come from pigeonring filtering. A fingerprint is a ring of four
16-bit segments. If two differ in at most 3 bits, then from some segment on
every chain of l consecutive segments differs in at most floor(3 l / 4) bits:
none in the first, one in the first two, two in the first three. So the first
two segments make a 32-bit key that is equal but for one bit of its second
half: one side of the join lists its keys, the other also the keys with one bit
cleared, and the longer chains prune before the full Hamming check.

A key shared by very many fingerprints (a large group of near copies) would
make pairs in the square of its size. Such keys are split by a third segment
that must agree but for one bit, which leaves 16 free bits, and each part
yields a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import column_bytes, materialise, with_payload
from quern.llm.components import connected_components
from quern.skew import by_shuffle

BITS, SEGMENTS, WIDTH = 64, 4, 16
#: Words hashed at a time, so that a very long text needs no more memory than this many shingles.
BLOCK = 1 << 16
SEED = 42
#: Copies of a component's row that its fingerprints are dealt over.
SALTS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is set if it is set in over half the shingles' XXH64 hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. A null text counts as an empty one, of fingerprint 0."""

    def batches(source):
        import numpy as np
        import pyarrow as pa

        for batch in source:
            found = np.array([fingerprint(x, shingle) for x in column_bytes(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _turned(fp: Column, segment: int) -> Column:
    """The ring read from a segment on."""
    return fp if segment == 0 else F.shiftleft(fp, WIDTH * segment).bitwiseOR(F.shiftrightunsigned(fp, BITS - WIDTH * segment))


def _keys(fps: DataFrame) -> DataFrame:
    """(fp, segment, key): four rows a fingerprint; the key is the first two segments from there on."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(_turned(F.col("fp"), i), 32).alias("key")) for i in range(SEGMENTS)])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.i", "k.key")


def _packed(key: Column) -> Column:
    return F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(key)


def link(fps: DataFrame, max_bits: int = 3, hot: int = 200) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps``(fp long): enough of them to keep every component whole.

    Keys with up to ``hot`` fingerprints give all their pairs within ``max_bits``;
    others a spanning forest of them.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the 16-bit segments serve up to 3 bits")
    keys = _keys(fps)
    index = keys.select("fp", _packed(F.col("key")).alias("k"))
    # The fingerprint with the bit set clears it to meet the other; equal keys meet as they are.
    cleared = F.array(F.lit(0), *[F.when(F.col("key").bitwiseAND(F.lit(1 << b)) != 0, F.lit(1 << b)) for b in range(WIDTH)])
    probe = keys.select("fp", "i", "key", F.explode(cleared).alias("bit")).where("bit IS NOT NULL").select("fp", _packed(F.col("key").bitwiseXOR(F.col("bit").cast("long"))).alias("k"))
    hot_keys = materialise(index.groupBy("k").count().where(F.col("count") > hot).select("k"), "hot-keys")
    any_hot = bool(hot_keys.take(1))

    i = F.shiftrightunsigned(F.col("p.k"), 32)
    ring = lambda fp: F.when(i == 0, fp).when(i == 1, _turned(fp, 1)).when(i == 2, _turned(fp, 2)).otherwise(_turned(fp, 3))
    differ = F.col("p.fp").bitwiseXOR(F.col("x.fp"))
    three = F.bit_count(F.shiftrightunsigned(ring(differ), WIDTH)) <= (3 * max_bits) // SEGMENTS
    linked = (F.col("p.k") == F.col("x.k")) & (F.col("p.fp") != F.col("x.fp")) & three & (F.bit_count(differ) <= max_bits)
    cold = index.join(hot_keys, "k", "left_anti") if any_hot else index
    pairs = probe.alias("p").join(by_shuffle(cold.alias("x")), linked).select(F.col("p.fp").alias("a"), F.col("x.fp").alias("b"))
    if any_hot:
        members = index.withColumn("role", F.lit(0)).unionByName(probe.withColumn("role", F.lit(1)))
        pairs = pairs.unionByName(_hot_links(members.join(hot_keys, "k", "left_semi"), max_bits))
    return pairs


def _hot_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links among the members (fp, k, role) of hot keys, by a third segment that agrees but for one bit.

    Of the up to ``max_bits`` bits left for the last two segments one has at most
    one, so each member goes to a part for either segment; the second role also
    to the parts one bit away. A part leaves 16 bits free, so it has at most
    2^16 fingerprints of the first role, however large the table.
    """
    spot = F.shiftrightunsigned(F.col("k"), 32).cast("int")
    parts = members.withColumn("j", F.explode(F.array(F.lit(2), F.lit(3))))
    turn = F.pmod(spot + F.col("j"), F.lit(SEGMENTS))
    value = F.when(turn == 0, F.shiftrightunsigned("fp", 48)).when(turn == 1, F.shiftrightunsigned("fp", 32)).when(turn == 2, F.shiftrightunsigned("fp", 16)).otherwise(F.col("fp")).bitwiseAND(F.lit((1 << WIDTH) - 1))
    flips = F.when(F.col("role") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), *[F.lit(1 << b) for b in range(WIDTH)]))
    parts = parts.withColumn("value", value).withColumn("bit", F.explode(flips)).select("k", "j", F.col("value").bitwiseXOR(F.col("bit").cast("long")).alias("part"), "role", "fp")
    sizes = parts.groupBy("k", "j", "part").agg(F.min("role").alias("least"), F.max("role").alias("most"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    live = sizes.where("least = 0 AND most = 1 AND low <> high").select("k", "j", "part")
    return parts.join(by_shuffle(live), ["k", "j", "part"], "left_semi").groupBy("k", "j", "part").applyInPandas(lambda pdf: _forest(pdf, max_bits), "a long, b long")


def _forest(pdf, max_bits: int):
    """A spanning forest of the links between roles 0 and 1 of one part, as rows a, b."""
    import numpy as np
    import pandas as pd

    sides = [np.unique(pdf.fp.to_numpy()[pdf.role.to_numpy() == r]).view(np.uint64) for r in (0, 1)]
    left = [np.arange(len(s)) for s in sides]
    out_a, out_b = [], []
    while len(left[0]) and len(left[1]):
        side, front = 0, left[0][:1]
        left[0] = left[0][1:]
        while len(front):
            reached = []
            for at in range(0, len(front), 64):
                rest = left[1 - side]
                if not len(rest):
                    break
                near = np.bitwise_count(sides[side][front[at : at + 64], None] ^ sides[1 - side][rest][None, :]) <= max_bits
                hit = near.any(axis=0)
                out_a.append(sides[side][front[at : at + 64]][near.argmax(axis=0)[hit]])
                out_b.append(sides[1 - side][rest[hit]])
                reached.append(rest[hit])
                left[1 - side] = rest[~hit]
            front, side = np.concatenate(reached) if reached else np.array([], np.int64), 1 - side
    a, b = (np.concatenate(x).view(np.int64) if x else np.array([], np.int64) for x in (out_a, out_b))
    return pd.DataFrame({"a": a, "b": b})[a != b]


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 3, hot: int = 200) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits), ``component_id``.

    Two documents are linked if their fingerprints differ in at most ``max_bits``
    bits; ``component_id`` is the smallest id that links reach, the document's own
    included. Null, empty and blank texts have fingerprint 0 and are linked like
    any other. Repeated rows stay repeated and share a component; null ids never
    are a component's id unless it has no other. Texts may be of any length. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = materialise(connected_components(link(distinct.select("fp"), max_bits, hot)), "roots")
    reached = roots.join(distinct, F.col("node") == F.col("fp"))
    ids = reached.groupBy("root").agg(F.min("least").alias("component"))
    # Very many fingerprints can share a root, so they are dealt over salted copies of the roots.
    salted = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(by_shuffle(salted), ["root", "salt"]).select("node", "component")
    by_fp = distinct.join(named, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    by_fp = materialise(by_fp, "components").withColumnRenamed("fp", "of")
    # Both sides are fresh reads, so adaptive execution can split a hot fingerprint.
    return rows.join(by_fp, F.col("fp") == F.col("of"), "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, components: Callable[..., DataFrame] = simhash_dedup, **options) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns, whatever their names.

    Of each component the row of the smallest id stays; a null id is larger than
    any, so a row without one stays only where no other has one, as in
    ``simhash_dedup``. Of equal ids the smaller text hash stays, of rows that repeat
    id and text any one. Null, empty and blank texts are near copies of each other.
    Texts may be of any length; an empty table gives an empty result.

    ``components`` is the rule that gives rows their ``component_id``. Rows are known by id and a hash of their text, which any reading of the table gives alike.
    """
    mark = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    found = components(docs.select(mark.alias("mark"), F.col(text_col).alias("text")), "mark", "text", **options)
    found = materialise(found.groupBy("mark").agg(F.first(F.col("mark") == F.col("component_id")).alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1").withColumnRenamed("mark", "of"), "dropped")
    rows = with_payload(docs, mark.alias("mark"))
    kept = rows.join(found.select("of"), F.col("mark") == F.col("of"), "left_anti").select("payload")
    repeated = found.where("stays")
    if repeated.take(1):
        # Rows that repeat id and text: each task sends one of each on.
        first = F.row_number().over(Window.partitionBy("mark").orderBy(F.lit(1)))
        kept = kept.unionByName(rows.join(repeated.select("of"), F.col("mark") == F.col("of"), "left_semi").withColumn("nth", first).where("nth = 1").select("payload"))
    return kept.select("payload.*")
