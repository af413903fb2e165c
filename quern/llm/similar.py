"""Near-duplicates by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash, completed by an exact similarity join, so that no pair is missed. In one order
of all shingles, two sets that are similar enough share a shingle among the
first n - ceil(0.8 n) + 1 of each. Any order serves; frequent shingles of a
sample come last in it, so that common passages seldom are in a prefix.

0. SimHash proposes first: fingerprints of the same shingles that differ in 3 bits
   or fewer link their texts. It misses pairs and has others that are not similar
   enough, so what it proposes is verified, and the join below finds the rest.
1. Prefixes are packed into blocks, and an exchange tells which of their shingles
   another text has as well, and in which text each of these comes first.
2. The sets that share a shingle (a large group of near copies, maybe) are held
   against that one only: a text that copies were made from has fewer rare
   shingles than they.
3. A second exchange finds the shingles whose sets these links did not bring
   together. Only those become rows, and what is outside the largest component
   of its group is held against all others of the group.

Pairs go that sizes, places in the prefix, or a bitmap rule out (with each shingle
of a set one of 512 bits is turned over, and sets that differ in d shingles have
bitmaps that differ in d bits at most); the rest is verified on the texts.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks_by_size, column_bytes, materialise, released
from quern.llm.components import connected_components
from quern.llm.exchange import exchange_values, gather_values
from quern.llm.simhash import BITS, BLOCK, SALTS, SEED, link
from quern.skew import by_shuffle, join_groups

#: Texts of which one is sampled for frequent shingles, and the most shingles that are put last. Neither changes results.
SAMPLE, LAST = 16, 1 << 16
#: Shingles of prefixes at which a block is closed, and different ones of blocks that one slot adds up.
BLOCK_TOKENS, SLOT_KEYS = 1 << 18, 1 << 19
LONGS = 8  # of the bitmap
#: An odd factor, so that no two hashes become equal.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Most rows (a hash and an id each) that are broadcast, about 50 MB; more are joined by shuffles, with the same result.
SENT_ROWS = 1 << 19


def shingles(text: bytes, size: int = 5) -> set[bytes]:
    """The different runs of ``size`` words; all words of a shorter text, and nothing of a text without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    size = min(size, len(words))
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def _hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted different hashes of the shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    found = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True))
    return np.unique(np.fromiter(found, np.uint64, len(starts)))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Jaccard similarity of 0.8 or more; two empty sets are alike."""
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def _frequent(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent shingles in a sample of the texts."""

    def batches(source):
        import pyarrow as pa

        for batch in source:
            for a, b in chunks_by_size(texts := column_bytes(batch, "text"), 4 << 20):
                yield pa.record_batch([pa.array(np.concatenate([_hashes(t, size) for t in texts[a:b]]).view(np.int64))], names=["token"])

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(released(batches), "token long")
    found = sample.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(LAST).select("token").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _node(tokens: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(tokens.tobytes(), SEED)


def _fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes: a bit is set if it is set in over half of them; 0 for an empty set."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(own), BLOCK):
        total += np.unpackbits(own[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(own), bitorder="little").view("<i8")[0]


def _prefixes(rows: DataFrame, size: int) -> DataFrame:
    """(id, node, n, fp, bits, tokens): of every row its set's hash, size, SimHash and bitmap, and the hashes of the set's prefix.

    A prefix has the smallest hashes, a fifth of their range. Slots of an exchange
    are ranges, so tokens are these hashes times SPREAD, which fill all slots alike.
    """
    last = rows.sparkSession.sparkContext.broadcast(_frequent(rows, size))

    def batches(source):
        import pyarrow as pa

        late = last.value
        for batch in source:
            nodes, sizes, fps, bitmaps, prefixes = [], [], [], [], []
            for text in column_bytes(batch, "text"):
                own = _hashes(text, size)
                nodes.append(_node(own))
                sizes.append(len(own))
                fps.append(_fingerprint(own))
                bitmaps.append(np.packbits(np.bincount((own & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS).astype(np.uint8) & 1).view(np.int64))
                spot = np.minimum(np.searchsorted(late, own), max(0, len(late) - 1))
                put_last = late[spot] == own if len(late) else np.zeros(len(own), bool)
                prefixes.append((np.concatenate((own[~put_last], own[put_last]))[: len(own) - (4 * len(own) + 4) // 5 + 1] * SPREAD).tobytes())
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, LONGS * (len(nodes) + 1), LONGS), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bitmaps])))
            yield pa.record_batch([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.int64)), bits, pa.array(prefixes, pa.binary())], names=["id", "node", "n", "fp", "bits", "tokens"])

    return rows.mapInArrow(released(batches), f"id {rows.schema['id'].dataType.simpleString()}, node long, n int, fp long, bits array<long>, tokens binary")


def _packed(one: DataFrame) -> DataFrame:
    """Blocks of sets: nodes and sizes as int64, lengths of prefixes as int32, tokens as uint64."""

    def batches(source):
        import pyarrow as pa
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close():
            nodes, sizes, tokens = zip(*held, strict=True)
            columns = [np.array(nodes, np.int64), np.array(sizes, np.int64), np.array([len(t) // 8 for t in tokens], np.int32)]
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([0], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([b"".join(tokens)], pa.binary())], names=["block", "part", "nodes", "sizes", "lengths", "tokens"])

        for batch in source:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.append(row)
                size += len(row[2]) // 8 + 1
                if size >= BLOCK_TOKENS:
                    yield close()
                    block, held, size = block + 1, [], 0
        if held:
            yield close()

    return one.select("node", "n", "tokens").mapInArrow(released(batches), "block long, part int, nodes binary, sizes binary, lengths binary, tokens binary")


def _arrays(row, **kinds: str) -> list[np.ndarray]:
    """Columns of a block as arrays; ``row`` gives Arrow scalars by name."""
    return [np.frombuffer(row[c].as_py(), kind) for c, kind in kinds.items()]


def _row(batch, i: int) -> dict:
    return {c: batch.column(c)[i] for c in batch.schema.names}


def _slots(blocks: DataFrame) -> int:
    total = blocks.agg(F.coalesce(F.sum(F.octet_length("tokens") / 8), F.lit(0)).cast("long")).first()[0]
    return max(blocks.sparkSession.sparkContext.defaultParallelism, -(-total // SLOT_KEYS))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return first, np.concatenate((first[1:], [len(keys)])).astype(np.int64) - 1 if len(keys) else first


SHARED = "block long, nodes binary, sizes binary, lengths binary, tokens binary, places binary, a binary, b binary"


def _shared(blocks: DataFrame) -> DataFrame:
    """The blocks with those tokens only that another set has in its prefix, and pairs (a, b) of sets with the leaders of these tokens: SHARED.

    A token's leader is the set in which it comes first. An exchange tells a block
    the leaders of its shared tokens, so a set is paired within its block, once with
    each leader, and tokens become no rows.
    """

    def opened(row):
        nodes, sizes, lengths, tokens = _arrays(row, nodes="<i8", sizes="<i8", lengths="<i4", tokens="<u8")
        owner = np.repeat(np.arange(len(nodes)), lengths)
        return nodes, sizes, tokens, owner, np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def sent_of(batch, i):
        nodes, sizes, tokens, owner, place = opened(_row(batch, i))
        order = np.lexsort((nodes[owner], place, tokens))
        first, end = _runs(tokens[order])
        best = order[first]
        return tokens[best], [nodes[owner[best]].view(np.uint64), place[best], sizes[owner[best]], end - first + 1]

    def answer_of(at, m, values):
        node, place, n, count = values
        order = np.lexsort((node, place, at))
        best = order[_runs(at[order])[0]]
        return np.bincount(at, count, m) > 1, [node[best].view(np.uint64), place[best], n[best]]

    def of(row, flags, told):
        nodes, sizes, tokens, owner, place = opened(row)
        keys = np.unique(tokens, return_inverse=True)[1]
        kept = np.flatnonzero(flags[keys]) if len(tokens) else np.zeros(0, np.int64)
        at = (np.cumsum(flags) - 1)[keys[kept]]
        own = owner[kept]
        lead, lead_place, lead_size = (t[at] for t in told) if told else (np.zeros(0, np.int64),) * 3
        n = sizes[own]
        room = (nodes[own] != lead) & (9 * np.minimum(n - place[kept], lead_size - lead_place) >= 4 * (n + lead_size))
        pairs = np.unique(np.sort(np.stack([nodes[own[room]], lead[room]], 1), 1), axis=0)
        users, lengths = np.unique(own, return_counts=True)
        columns = {"nodes": nodes[users], "sizes": sizes[users], "lengths": lengths.astype(np.int32), "tokens": tokens[kept], "places": place[kept].astype(np.int32), "a": pairs[:, 0], "b": pairs[:, 1]}
        return {"block": [row["own"].as_py()]} | {c: [x.tobytes()] for c, x in columns.items()}

    replies = exchange_values(blocks.select("block", "nodes", "sizes", "lengths", "tokens"), sent_of, answer_of, _slots(blocks))
    return gather_values(blocks.withColumn("own", F.col("block")), ["own", "nodes", "sizes", "lengths", "tokens"], replies, of, SHARED)


def _listed(blocks: DataFrame, names: dict[str, str], schema: str) -> DataFrame:
    """Rows of int64 arrays of blocks: ``names`` gives each output column's block column; ``block`` and ``at`` are the block and the place in it."""

    def batches(source):
        import pyarrow as pa

        for batch in source:
            for i in range(batch.num_rows):
                found = {out: np.frombuffer(batch.column(c)[i].as_py(), "<i8") for out, c in names.items()}
                n = len(next(iter(found.values())))
                found |= {"block": np.full(n, batch.column("block")[i].as_py(), np.int64), "at": np.arange(n, dtype=np.int32)}
                yield pa.record_batch([pa.array(found[c.split()[0]]) for c in schema.split(", ")], names=[c.split()[0] for c in schema.split(", ")])

    return blocks.select("block", *names.values()).mapInArrow(released(batches), schema)


def _parted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, node, size, place, root) of the tokens whose sets have different roots; a set without a root is its own. By exchange, as above."""
    known = _listed(shared, {"node": "nodes"}, "block long, at int, node long").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
    known = known.groupBy("block").agg(F.collect_list(F.struct("at", "root")).alias("known"))  # a block has 2^18 sets at most
    blocks = materialise(shared.drop("a", "b").join(known, "block", "left"), "rooted-blocks")

    def opened(row):
        nodes, sizes, lengths, tokens, places = _arrays(row, nodes="<i8", sizes="<i8", lengths="<i4", tokens="<u8", places="<i4")
        root, owner = nodes.copy(), np.repeat(np.arange(len(nodes)), lengths)
        if row["known"].is_valid:
            found = row["known"].values
            root[found.field("at").to_numpy()] = found.field("root").to_numpy()
        return nodes[owner], sizes[owner], tokens, places, root[owner]

    def sent_of(batch, i):
        _, _, tokens, _, root = opened(_row(batch, i))
        order = np.lexsort((root, tokens))
        first, end = _runs(tokens[order])
        low, high = root[order[first]], root[order[end]]
        return tokens[order[first]], [low.view(np.uint64), (low != high).astype(np.uint8)]

    def answer_of(at, m, values):
        root, mixed = values
        order = np.lexsort((root, at))
        first, end = _runs(at[order])
        return (np.bincount(at, mixed, m) > 0) | (root[order[first]] != root[order[end]]), []

    def of(row, flags, told):
        node, size, tokens, places, root = opened(row)
        kept = np.flatnonzero(flags[np.unique(tokens, return_inverse=True)[1]]) if len(tokens) else np.zeros(0, np.int64)
        return {"token": tokens[kept].view(np.int64), "node": node[kept], "size": size[kept].astype(np.int32), "place": places[kept], "root": root[kept]}

    replies = exchange_values(blocks.select("block", "nodes", "sizes", "lengths", "tokens", "places", "known"), sent_of, answer_of, _slots(blocks))
    return gather_values(blocks, ["nodes", "sizes", "lengths", "tokens", "places", "known"], replies, of, "token long, node long, size int, place int, root long")


def _possible(a: str, b: str) -> Column:
    """Whether sizes, and places of the first shared shingle, leave room for the similarity."""
    left = lambda x: F.col(f"{x}.n") - F.col(f"{x}.place")
    return 9 * F.least(left(a), left(b)) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _near(a: str, b: str) -> Column:
    """Whether the bitmaps leave room: similar sets differ in a ninth of their sizes at most."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(LONGS)])
    return 9 * differ <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _texts(nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(node, text) of nodes(node, least), from rows(id, text). Ids may repeat with other texts, so a text is known by the hash of its own set."""

    def batches(source):
        import pyarrow as pa

        for batch in source:
            own = np.array([_node(_hashes(x, size)) for x in column_bytes(batch, "text")], np.uint64).view(np.int64)
            yield batch.filter(pa.array(own == batch.column(0).to_numpy(zero_copy_only=False)))

    # Texts asked for are few against all texts, which are shuffled only if these are more than a broadcast holds.
    asked = materialise(nodes, "asked")
    asked = F.broadcast(asked) if asked.count() <= SENT_ROWS else asked
    found = rows.join(asked, F.col("id") == F.col("least")).select("node", "text")
    return materialise(found.mapInArrow(released(batches), "node long, text string").dropDuplicates(["node"]), "candidate-texts")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Those of the materialised pairs(a, b) of nodes whose texts are similar."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = _texts(nodes.join(asked, "node", "left_semi").select("node", "least"), rows, size)
    text = lambda end, name: by_shuffle(own.select(F.col("node").alias(end), F.col("text").alias(name)))
    both = pairs.join(text("a", "x"), "a").join(text("b", "y"), "b")

    def checked(source):
        import pyarrow as pa

        own = lru_cache(32)(lambda text: shingles(text, size))
        for batch in source:
            alike = [similar(own(x), own(y)) for x, y in zip(column_bytes(batch, "x"), column_bytes(batch, "y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return materialise(both.select("a", "b", "x", "y").mapInArrow(released(checked), "a long, b long"), "links")


def _proposed(nodes: DataFrame) -> DataFrame:
    """(a, b): the nodes that SimHash links at 3 bits or fewer, enough of them to keep its components whole.

    Of nodes with one fingerprint the smallest stands for them.
    """
    known = materialise(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")), "fingerprints")
    alike = join_groups(nodes.select("node", "fp"), known.where("n > 1").withColumnRenamed("fp", "of"), F.col("fp") == F.col("of"), nodes.count())
    lead = lambda end: known.select(F.col("fp").alias(end), F.col("lead").alias(f"{end}_lead"))
    linked = link(known.select("fp")).distinct().join(lead("a"), "a").join(lead("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    pairs = alike.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).unionByName(linked)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _links(blocks: DataFrame, nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between nodes, enough of them to keep every component whole."""
    pair = lambda p, q: [F.least(f"{p}.node", f"{q}.node").alias("a"), F.greatest(f"{p}.node", f"{q}.node").alias("b")]
    marks = nodes.select("node", "n", "bits")
    # First what SimHash proposes, and each set with the leaders of its tokens.
    shared = materialise(_shared(blocks), "shared-blocks")
    stars = _listed(shared, {"a": "a", "b": "b"}, "a long, b long").unionByName(_proposed(nodes)).distinct()
    stars = stars.join(marks.alias("p"), F.col("a") == F.col("p.node")).join(marks.alias("q"), (F.col("b") == F.col("q.node")) & _near("p", "q")).select("a", "b")
    stars = materialise(stars, "candidates")
    links = _verified(stars, nodes, rows, size)
    # Then, in groups that these links did not bring together, what is outside the largest component with all others.
    rooted = materialise(_parted(shared, materialise(connected_components(links), "star-roots")), "rooted")
    total = rooted.count()
    counted = rooted.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("n"))
    apart = materialise(counted.select(F.col("token").alias("of"), "main", "n"), "apart")
    split = join_groups(rooted, apart, F.col("token") == F.col("of"), total).select("token", "node", "size", "place", "root", "main")
    split = materialise(split.join(marks.select(F.col("node").alias("own"), "bits"), F.col("node") == F.col("own")).select("token", "node", F.col("size").alias("n"), "place", "bits", "root", "main"), "split")
    other = split.where("root <> main").alias("p").join(by_shuffle(split.alias("q")), (F.col("p.token") == F.col("q.token")) & (F.col("p.root") != F.col("q.root")) & ((F.col("q.root") == F.col("q.main")) | (F.col("p.node") < F.col("q.node"))) & _possible("p", "q") & _near("p", "q"))
    other = other.select(*pair("p", "q")).distinct().join(stars, ["a", "b"], "left_anti")
    return links.union(_verified(materialise(other, "rest"), nodes, rows, size))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5) -> DataFrame:
    """One row per document: its id and ``component_id``, the smallest id that links of 0.8 or more reach, its own included.

    Texts without words, null ones too, are alike. A null id is larger than any.
    Repeated rows stay repeated; texts may be of any length; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    # Known by id and text, no key is null, and hardly any is frequent.
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    rows = docs.select(own.alias("id"), F.col(text_col).alias("text"))
    found = materialise(_prefixes(rows, shingle), "prefixes")
    nodes = materialise(found.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.count("*").alias("copies")), "nodes")
    repeated = materialise(nodes.where("copies > 1").select("node"), "repeated")
    once = found.select("node", "n", "tokens").join(repeated, "node", "left_anti")
    one = once.union(found.select("node", "n", "tokens").join(repeated, "node", "left_semi").dropDuplicates(["node"]))
    roots = materialise(connected_components(_links(materialise(_packed(one), "prefix-blocks"), nodes, rows, shingle)), "roots")
    ids = roots.join(nodes.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).groupBy("root").agg(F.min("least").alias("component"))
    # Very many sets can share a root, so they are dealt over salted copies of the roots.
    salted = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(by_shuffle(salted), ["root", "salt"]).select(F.col("node").alias("of"), "component")
    by_node = nodes.join(named, F.col("node") == F.col("of"), "left").select(F.col("node").alias("of"), F.coalesce("component", "least").alias("component_id"))
    by_node = materialise(by_node, "components")
    return found.select("id", "node").join(by_node, F.col("node") == F.col("of"), "left").select(F.col("id.id").alias(id_col), F.col("component_id.id").alias("component_id"))
