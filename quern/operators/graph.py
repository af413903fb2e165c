"""Citation graphs as edge tables (src, dst, ..): neighbourhoods, paths, authority, ranks, communities.

Walks advance one frontier a level: each level is one join of the frontier with
the edges, and only nodes not yet seen go on. Iterations settle their state in
the shared folder, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.components import connected_components
from quern.skew import join_groups
from quern.storage import settle

POSITIVE = ("affirmed", "followed", "referred_to", "explained")
#: The batch variant counts ``applied`` and leaves out mere references.
POSITIVE_BATCH = ("followed", "affirmed", "applied", "explained")
SEVERE = ("overruled",)
#: Nodes up to which their labels are broadcast, or hashed in each shuffle partition; links of a node that one task may take.
FEW_NODES, HASHED_NODES, TASK_LINKS = 1 << 17, 1 << 19, 1 << 20


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, each once."""
    one = edges.select("src", "dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, both_ways: bool = True) -> DataFrame:
    """(seed, node, depth): nodes within ``depth`` steps of each of seeds(seed), itself at 0, at their least depth."""
    steps = undirected(edges) if both_ways else edges.select("src", "dst").distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for level in range(1, depth + 1):
        reached = front.join(steps, front.node == steps.src).select("seed", F.col("dst").alias("node")).distinct()
        front = settle(reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(level)), "hop")
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes(node), each pair once."""
    ids = nodes.select("node").distinct()
    inner = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inner.select("src", "dst").distinct()


def chain(edges: DataFrame, seed, depth: int) -> DataFrame:
    """Edges on directed walks of up to ``depth`` steps from a node, each once."""
    seeds = edges.sparkSession.range(1).select(F.lit(seed).cast(edges.schema["src"].dataType).alias("seed"))
    near = k_hop(edges, seeds, depth - 1, both_ways=False)
    return edges.join(near.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst").distinct()


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cited_by): incoming edges, 0 for none."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("cited_by"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def authorities(edges: DataFrame, seed, limit: int = 20) -> DataFrame:
    """(node, cited_by): what lies within two steps and was never overruled, most cited first."""
    seeds = edges.sparkSession.range(1).select(F.lit(seed).cast(edges.schema["src"].dataType).alias("seed"))
    near = k_hop(edges, seeds, 2).where("depth > 0")
    cited = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("cited_by"), F.max(F.col("treatment").isin(*SEVERE).cast("int")).alias("bad"))
    found = near.join(cited, "node", "left").where("coalesce(bad, 0) = 0").select("node", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))
    return found.orderBy(F.desc("cited_by"), "node").limit(limit)


def shortest_path(edges: DataFrame, start, goal, max_depth: int = 6) -> DataFrame:
    """(step, node) of a shortest directed path, of several the one whose nodes come first in order. No rows if there is none.

    Each node of the frontier carries the one path to it, of ``max_depth`` + 1
    nodes at most, so the path is there as soon as the goal is.
    """
    steps = settle(edges.select("src", "dst").distinct(), "steps")
    kind = steps.schema["src"].dataType
    front = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
    seen, found = front.select("node"), front.where(F.col("node") == goal)
    for _ in range(max_depth):
        if found.take(1):
            break
        reached = front.join(steps, front.node == steps.src).groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        front = settle(reached.join(seen, "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path")), "front")
        seen, found = seen.unionByName(front.select("node")), front.where(F.col("node") == goal)
        if not front.take(1):
            break
    return found.select(F.posexplode("path").alias("step", "node"))


def shortest_paths(edges: DataFrame, one, other, max_depth: int = 6) -> DataFrame:
    """(direction, step, node): a shortest path from ``one`` to ``other``, ``forward``, and one back, ``reverse``; each where there is one."""
    there, back = (shortest_path(edges, a, b, max_depth).select(F.lit(name).alias("direction"), "step", "node") for name, a, b in (("forward", one, other), ("reverse", other, one)))
    return there.unionByName(back)


def treatment_verdict(edges: DataFrame) -> DataFrame:
    """(id, incoming, positive_pct, verdict) for every cited node; a missing treatment counts as a reference."""
    kind = F.coalesce("treatment", F.lit("referred_to"))
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"), F.count_if(kind.isin(*POSITIVE)).alias("good"), F.count_if(kind.isin(*SEVERE)).alias("bad"))
    share = F.round(F.col("good") / F.col("incoming"), 4)
    verdict = F.when(F.col("bad") > 0, "Overruled").when(share < 0.5, "Cautionary").when(share >= 0.8, "Followed").otherwise("Mixed")
    return counted.select("id", "incoming", share.alias("positive_pct"), verdict.alias("verdict"))


def treatment_shares(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, positive_pct): share of favourable treatments among those that are known; 1.0 where none is."""
    known = edges.where("treatment IS NOT NULL").groupBy(F.col("dst").alias("id")).agg(F.round(F.avg(F.col("treatment").isin(*POSITIVE_BATCH).cast("double")), 4).alias("positive_pct"))
    return nodes.select("id").join(known, "id", "left").select("id", F.coalesce("positive_pct", F.lit(1.0)).alias("positive_pct"))


def rising(edges: DataFrame, nodes: DataFrame, since: int) -> DataFrame:
    """(id, citers, rising): share of citers from year ``since`` on; citers without a year count as old."""
    years = nodes.select(F.col("id").alias("src"), "year")
    cited = edges.join(years, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("citers"), F.round(F.avg(F.coalesce((F.col("year") >= since).cast("double"), F.lit(0.0))), 4).alias("rising"))
    return nodes.select("id").join(cited, "id", "left").select("id", F.coalesce("citers", F.lit(0)).alias("citers"), F.coalesce("rising", F.lit(0.0)).alias("rising"))


def page_rank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 200) -> DataFrame:
    """(id, rank): power iteration with the rank of nodes without outgoing edges spread over all; ranks add up to 1.

    Ends when the ranks change by no more than ``tolerance`` in all, or after
    ``max_rounds``. Each round is written to the shared folder, so its plan has
    the same size as the first one's; two sums reach the driver. A much cited
    node's shares are added up before the shuffle.
    """
    links = settle(edges.select("src", "dst").distinct(), "links")
    degree = links.groupBy("src").agg(F.count("*").alias("out"))
    ids = settle(nodes.select("id").distinct().join(degree, F.col("id") == F.col("src"), "left").select("id", "out"), "nodes")
    n = ids.count()
    ranks = ids.select("id", "out", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(max_rounds if n else 0):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        sent = links.join(ranks.where("out IS NOT NULL").select("id", (F.col("rank") / F.col("out")).alias("share")), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("share").alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) / n)
        ranks = settle(ranks.join(sent, F.col("id") == F.col("dst"), "left").select("id", "out", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "ranks")
        if ranks.agg(F.sum("change")).first()[0] <= tolerance:
            break
    return ranks.select("id", "rank")


def page_rank_within(edges: DataFrame, members: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 200) -> DataFrame:
    """(id, community, rank): the ranks of members(id, community) in the graph of their own community; they add up to 1 in each.

    All communities iterate together until their ranks change by no more than ``tolerance`` in all.
    """
    one = settle(members.select("id", "community").distinct(), "members")
    ends = lambda name: one.select(F.col("id").alias(name), F.col("community").alias(f"{name}_of"))
    links = settle(edges.select("src", "dst").distinct().join(ends("src"), "src").join(ends("dst"), "dst").where("src_of = dst_of").select("src", "dst"), "links")
    sizes = settle(one.groupBy(F.col("community").alias("of")).agg(F.count("*").alias("n")), "sizes")
    total = one.count()
    degree = links.groupBy("src").agg(F.count("*").alias("out"))
    ranks = join_groups(one, sizes, F.col("community") == F.col("of"), total).join(degree, F.col("id") == F.col("src"), "left")
    ranks = settle(ranks.select("id", "community", "out", F.col("n").alias("size"), (1.0 / F.col("n")).alias("rank")), "ranks")
    for _ in range(max_rounds if total else 0):
        lost = ranks.groupBy(F.col("community").alias("of")).agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"), F.count("*").alias("n"))
        sent = links.join(ranks.where("out IS NOT NULL").select("id", (F.col("rank") / F.col("out")).alias("share")), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("share").alias("got"))
        new = (1 - damping) / F.col("size") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("size"))
        both = join_groups(ranks.join(sent, F.col("id") == F.col("dst"), "left"), lost, F.col("community") == F.col("of"), total)
        ranks = settle(both.select("id", "community", "out", "size", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "ranks")
        if ranks.agg(F.sum("change")).first()[0] <= tolerance:
            break
    return ranks.select("id", "community", "rank")


def max_normalise(ranks: DataFrame, per: str | None = None, digits: int = 2) -> DataFrame:
    """Ranks as parts of 100 of the largest, of all or of each group."""
    keys = [per] if per else []
    top = ranks.groupBy(*keys).agg(F.max("rank").alias("top"))
    both = ranks.join(top, per) if per else ranks.join(F.broadcast(top))
    return both.withColumn("score", F.round(100 * F.col("rank") / F.col("top"), digits)).drop("top")


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that edges between the nodes reach; an error if ``max_rounds`` do not settle it."""
    inner = induced(edges, nodes.select(F.col("id").alias("node")))
    roots = connected_components(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")), max_rounds)
    return nodes.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of links(src, dst, w), both ways, and labels(id, label): the share of weight inside labels over what chance would put there."""
    total = links.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    if not total:
        return 0.0
    degree = links.groupBy("src").agg(F.sum("w").alias("k"))
    known = settle(labels.select("id", "label").join(degree, F.col("id") == F.col("src")), "known")
    return _modularity(links, known, total, resolution, known.count())


def _modularity(links: DataFrame, labels: DataFrame, total: float, resolution: float, held: int) -> float:
    """The same with labels(id, label, k) of the ``held`` nodes that have links; a link is looked at one way, as the other way counts the same."""
    own = lambda name: _met(labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label")), held)
    one = links.where("src <= dst").select("src", "dst", F.when(F.col("src") < F.col("dst"), 2 * F.col("w")).otherwise(F.col("w")).alias("w"))
    inside = one.join(own("src"), "src").join(own("dst"), "dst").where("src_label = dst_label").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    chance = labels.groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - resolution * chance / total**2


def louvain(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, levels: int = 4, sweeps: int = 5) -> DataFrame:
    """(id, community): communities of high modularity, by rounds of local moves and merging of communities into nodes.

    In a sweep the nodes of one half (by a hash with the sweep's number), then those
    of the other, move to the neighbouring community of the largest gain, of equal
    gains the smallest label, if that is a gain over their own; as half of the nodes
    stand still, most moves are gains together as well. A sweep that does not raise
    the modularity is undone and ends the level, and such a level the whole.
    Communities are named by their smallest node. Like every method of this kind it
    finds a good partition, not the best.
    """
    kind, pairs = nodes.schema["id"].dataType, edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    for end in ("src", "dst"):
        pairs = pairs.join(nodes.select(F.col("id").alias(end)), end, "left_semi").withColumn(end, F.col(end).cast(kind))
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    links = settle(pairs.select(ways.alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("w")), "links")
    found = settle(nodes.select("id", F.col("id").alias("community")).distinct(), "found")
    total = links.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    best = None
    for level in range(levels if total else 0):
        degree = settle(links.groupBy("src").agg(F.sum("w").alias("k"), F.count("*").alias("n")), "degree")
        held, most = degree.agg(F.count("*"), F.max("n")).first()
        labels = degree.select(F.col("src").alias("id"), F.col("src").alias("label"), "k")
        links = settle(links.join(labels.select(F.col("id").alias("src"), "k"), "src").select("src", "dst", "w", "k"), "links")
        best = _modularity(links, labels, total, resolution, held) if best is None else best
        reached = best
        for sweep in range(sweeps):
            moved = labels
            for turn in (0, 1):
                moved = settle(_moves(links, moved, total, resolution, 2 * (level * sweeps + sweep) + turn, held, most), "labels")
            value = _modularity(links, moved, total, resolution, held)
            if value <= reached + 1e-6:
                break
            labels, reached = moved, value
        if reached <= best + 1e-9:
            break
        best = reached
        name = settle(labels.groupBy("label").agg(F.min("id").alias("name")), "names")
        named = settle(labels.join(name, "label").select(F.col("id").alias("of"), "name"), "named")
        found = settle(found.join(named, F.col("community") == F.col("of"), "left").select("id", F.coalesce("name", "community").alias("community")), "found")
        ends = lambda end: named.select(F.col("of").alias(end), F.col("name").alias(f"{end}_name"))  # noqa: B023, E731
        links = settle(links.join(ends("src"), "src").join(ends("dst"), "dst").groupBy(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")).agg(F.sum("w").alias("w")), "links")
    return found


def _met(labels: DataFrame, held: int) -> DataFrame:
    """``held`` labels for a join with links: broadcast if few, hashed without a sort if a partition's part is small."""
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.broadcast(labels) if held <= FEW_NODES else labels.hint("shuffle_hash") if held <= HASHED_NODES * parts else labels


def _moves(links: DataFrame, labels: DataFrame, total: float, resolution: float, turn: int, held: int, most: int) -> DataFrame:
    """labels(id, label, k) after those of ``held`` nodes whose turn it is have moved, by links(src, dst, w, k of src), ``most`` of a node.

    Only links of these nodes are looked at. A neighbour's label comes with that
    label's sum, so links meet the nodes once and are dealt once, by their node;
    where a node has too many for one task, by node and label first.
    """
    turns = lambda node: F.pmod(F.xxhash64(node, F.lit(turn // 2)), F.lit(2)) == turn % 2
    known = labels.join(labels.groupBy("label").agg(F.sum("k").alias("tot")), "label")
    near = links.where("src <> dst").where(turns("src")).join(_met(known.select(F.col("id").alias("dst"), "label", "tot"), held), "dst")
    # A node's own label stands among the choices even where no neighbour has it.
    own = known.where(turns("id")).select(F.col("id").alias("src"), "label", F.lit(0.0).alias("w"), "k", "tot", F.lit(True).alias("own"))
    choices = near.select("src", "label", "w", "k", "tot", F.lit(False).alias("own")).unionByName(own)
    rated = (choices if most > TASK_LINKS else choices.repartition("src")).groupBy("src", "label").agg(F.sum("w").alias("to"), F.max("k").alias("k"), F.max("tot").alias("tot"), F.max("own").alias("own"))
    gain = F.col("to") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / total
    picked = rated.select("src", "label", "own", F.round(gain, 9).alias("gain")).groupBy("src").agg(F.min_by("label", F.struct(-F.col("gain"), F.col("label"))).alias("to"), F.max("gain").alias("top"), F.max(F.when(F.col("own"), F.col("gain"))).alias("stay"))
    both = labels.join(picked, F.col("id") == F.col("src"), "left")
    return both.select("id", F.when(F.col("top") > F.col("stay"), F.col("to")).otherwise(F.col("label")).alias("label"), "k")


def label_groups(members: DataFrame, group: str, word: str, triggers: DataFrame) -> DataFrame:
    """(group, name): the trigger set (name, ord, word) with most of the group's words, first of equal; else its two most frequent words."""
    words = members.groupBy(group, word).agg(F.count("*").alias("n"))
    hits = words.join(triggers, words[word] == triggers["word"]).groupBy(group, "name", "ord").agg(F.count("*").alias("k"))
    named = hits.groupBy(group).agg(F.max_by("name", F.struct("k", -F.col("ord"))).alias("name"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), word)
    top = words.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(word)), " / ").alias("other"))
    return top.join(named, group, "left").select(group, F.coalesce("name", "other").alias("name"))


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, cited nodes."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("cited")))


def build_edges(cites: DataFrame, targets: DataFrame, key: Column) -> DataFrame:
    """cites(src, cited, ..) resolved against targets(key, id): self-citations go, of equal pairs the last treatment stays."""
    lookup = targets.groupBy("key").agg(F.max("id").alias("dst"))
    found = cites.withColumn("ask", key).join(lookup, F.col("ask") == F.col("key")).where("src <> dst")
    return found.groupBy("src", "dst").agg(F.max_by("treatment", "ord").alias("treatment"))
