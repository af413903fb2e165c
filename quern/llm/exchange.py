"""Counting keys of blocks by exchange, with answers to each block.

A block (a row with some arrays in binary columns) sends each of its different
keys once, with its number, to the slot of its hash; the slot adds up the blocks
and answers each with the totals of its keys. Slots are made in proportion to
the keys, and a key comes once a block however frequent it is, so no task grows
with the input or with a hot key. Keys are 64-bit hashes, spread evenly over
their whole range, since slots are ranges of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN, HELD = 0, 1
REPLIES = "block long, part int, slot long, n int, distinct long, main binary, held binary"


def packed(values: np.ndarray) -> bytes:
    """Counts in the least width that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def exchange(blocks: DataFrame, keys_of: Callable, slots: int) -> DataFrame:
    """The totals of every block's keys, in blocks of part MAIN and of part HELD, as REPLIES.

    ``keys_of(batch, i)`` gives the sorted different keys (uint64) of row i of
    ``blocks``(block, part, ..) and their numbers. A slot is a range of hashes, so a
    block's replies by slot are in the order of its keys. ``distinct`` has, on one
    reply of each slot, its number of different keys in the two parts.
    """

    def packets(source):
        import pyarrow as pa

        for batch in source:
            for i in range(batch.num_rows):
                keys, counts = keys_of(batch, i)
                if not len(keys):
                    continue
                slot = ((keys >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
                cuts = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(keys)]))
                n = len(cuts) - 1
                sent = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(keys.tobytes())])
                numbers = pa.array([packed(counts[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
                yield pa.record_batch([pa.array(np.full(n, batch.column("block")[i].as_py())), pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)), pa.array(slot[cuts[:-1]].astype(np.int64)), sent, numbers], names=["block", "part", "slot", "keys", "counts"])

    def answer(table):
        import pyarrow as pa

        raw = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        counts = np.concatenate([unpacked(c, k) for c, k in zip(table.column("counts").to_pylist(), n.tolist(), strict=True)])
        part = np.repeat(table.column("part").to_numpy(), n)
        different, at = np.unique(np.concatenate(raw), return_inverse=True)
        main, late = (np.bincount(at, np.where(part == kind, counts, 0), len(different)).astype(np.int64) for kind in (MAIN, HELD))
        distinct = np.zeros(len(raw), np.int64)
        distinct[0] = np.count_nonzero(main + late)
        ends = np.cumsum(n)[:-1]
        replies = [pa.array([packed(x) for x in np.split(total[at], ends)], pa.binary()) for total in (main, late)]
        return pa.table([table.column("block"), table.column("part"), table.column("slot"), pa.array(n.astype(np.int32)), pa.array(distinct), *replies], names=["block", "part", "slot", "n", "distinct", "main", "held"])

    sent = blocks.mapInArrow(packets, "block long, part int, slot long, keys binary, counts binary")
    return sent.groupBy("slot").applyInArrow(answer, REPLIES)


def gather(blocks: DataFrame, carried: Sequence[str], replies: Sequence[DataFrame], of: Callable, schema: str) -> DataFrame:
    """Hands ``of`` each block with its replies.

    ``of`` gets the columns ``carried`` of a block as Arrow scalars by name, and for
    each of ``replies`` the totals (main, held) of the block's keys; it returns arrays by name, as in ``schema``.
    """
    kinds = [(c, blocks.schema[c].dataType.simpleString()) for c in carried]
    none = lambda pairs: [F.lit(None).cast(kind).alias(c) for c, kind in pairs]
    rows = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("n"), *carried, *none([("main", "binary"), ("held", "binary")]))
    for k, said in enumerate(replies, 1):
        rows = rows.unionByName(said.select("block", F.lit(k).alias("kind"), "slot", "n", *none(kinds), "main", "held"))

    count, names = len(replies), list(carried)

    def gathered(table):
        import pyarrow as pa

        kind, slots, n = (table.column(x).to_numpy() for x in ("kind", "slot", "n"))
        (at,) = np.flatnonzero(kind == 0).tolist()

        def totals(k: int) -> list[np.ndarray]:
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(slots[own])].tolist()
            return [np.concatenate([np.zeros(0, np.int64), *(unpacked(table.column(x)[i].as_py(), int(n[i])) for i in own)]) for x in ("main", "held")]

        return pa.table(of({c: table.column(c)[at] for c in names}, *(totals(k) for k in range(1, count + 1))))

    return rows.groupBy("block").applyInArrow(gathered, schema)


def exchange_values(blocks: DataFrame, sent_of: Callable, answer_of: Callable, slots: int) -> DataFrame:
    """As ``exchange``, with values beside the keys: (block, slot, n, told) for every block and slot.

    ``sent_of(batch, i)`` gives the sorted different keys (uint64) of row i of
    ``blocks``(block, ..) and a list of unsigned arrays beside them. A slot holds
    what all blocks sent of its keys: ``answer_of(at, m, values)`` gets for each
    entry which of the m different keys it has, and returns a flag for each of these
    and a list of unsigned arrays. ``told`` has a block's flags as bits, then the
    arrays for its flagged keys alone.
    """

    def packets(source):
        import pyarrow as pa

        for batch in source:
            for i in range(batch.num_rows):
                keys, values = sent_of(batch, i)
                if not len(keys):
                    continue
                slot = ((keys >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
                cuts = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(keys)])).tolist()
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                columns = [
                    pa.array([batch.column("block")[i].as_py()] * len(spans), pa.int64()),
                    pa.array(slot[cuts[:-1]].astype(np.int64)),
                    pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([[packed(v[a:b]) for v in values] for a, b in spans], pa.list_(pa.binary())),
                ]
                yield pa.record_batch(columns, names=["block", "slot", "keys", "sent"])

    def answer(table):
        import pyarrow as pa

        raw = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        n = [len(x) for x in raw]
        values = [np.concatenate([unpacked(x, k) for x, k in zip(column, n, strict=True)]) for column in zip(*table.column("sent").to_pylist(), strict=True)]
        different, at = np.unique(np.concatenate(raw), return_inverse=True)
        flags, told = answer_of(at, len(different), values)
        replies = [[np.packbits(flags[own]).tobytes(), *(packed(t[own[flags[own]]]) for t in told)] for own in np.split(at, np.cumsum(n)[:-1])]
        return pa.table([table.column("block"), table.column("slot"), pa.array(n, pa.int32()), pa.array(replies, pa.list_(pa.binary()))], names=["block", "slot", "n", "told"])

    sent = blocks.mapInArrow(packets, "block long, slot long, keys binary, sent array<binary>")
    return sent.groupBy("slot").applyInArrow(answer, "block long, slot long, n int, told array<binary>")


def gather_values(blocks: DataFrame, carried: Sequence[str], replies: DataFrame, of: Callable, schema: str) -> DataFrame:
    """Hands ``of`` each block (its columns ``carried`` as Arrow scalars by name) with the flags of its keys and the arrays told of the flagged ones."""
    kinds = [(c, blocks.schema[c].dataType.simpleString()) for c in carried]
    rows = blocks.select("block", F.lit(None).cast("long").alias("slot"), F.lit(0).alias("n"), F.lit(None).cast("array<binary>").alias("told"), *carried)
    rows = rows.unionByName(replies.select("block", "slot", "n", "told", *[F.lit(None).cast(kind).alias(c) for c, kind in kinds]))
    names = list(carried)

    def gathered(table):
        import pyarrow as pa

        slots = table.column("slot").to_pylist()
        at = slots.index(None)
        own = sorted((s, i) for i, s in enumerate(slots) if s is not None)
        n = [table.column("n")[i].as_py() for _, i in own]
        told = [table.column("told")[i].as_py() for _, i in own]
        flags = [np.unpackbits(np.frombuffer(t[0], np.uint8), count=k).astype(bool) for t, k in zip(told, n, strict=True)]
        marked = [int(f.sum()) for f in flags]
        columns = [np.concatenate([unpacked(x, k) if k else np.zeros(0, np.int64) for x, k in zip(c, marked, strict=True)]) for c in list(zip(*told, strict=True))[1:]]
        return pa.table(of({c: table.column(c)[at] for c in names}, np.concatenate([np.zeros(0, bool), *flags]), columns))

    return rows.groupBy("block").applyInArrow(gathered, schema)
