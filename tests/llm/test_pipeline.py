"""The corpus pipeline against a version without Spark."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest

from quern import skew
from quern.llm import similar
from quern.llm.similar import similar_components
from tests.llm.test_llm_operators import CLASHES, lower, words


def test_pipeline_rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    last = {}
    for i, t in kept:
        last[t] = max(i, last.get(t, i))
    kept = [(i, t) for t, i in last.items()]
    stay = set(brute_similar([t for _, t in kept], [i for i, _ in kept]))
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {tuple(w[k : k + 13]) for t in bench for w in [split(t)] for k in range(max(1, len(w) - 12) if w else 0)}
    sizes = {len(w) for w in windows}
    expected = []
    for i, t in kept:
        w = split(t)
        hit = {x for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for x in range(k, k + n)}
        if i in stay and not (hit and 20 * len(hit) >= len(w)):
            expected.append(i)
    found = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(expected) and all(r.round_trip for r in found)


def test_stages_keep_the_columns(spark, sf, tmp_path):
    """Also with null ids and texts, repeated rows, and columns named as the stages name theirs; and of an empty table."""
    given = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id but some words in it", "en", "x", 1), (None, None, None, None, None), (10**6, None, "en", "x", 0), (10**6, "", "en", "x", 0), (3, "une autre phrase avec des mots", "fr", "x", 9)], given.schema)
    both = given.unionByName(odd).unionByName(given.limit(20))
    for name in CLASHES:
        if name not in both.columns:
            both = both.withColumn(name, both.doc_id)
    both.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect()), name
        assert stage(spark, empty, sf).count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, sf).count() == docs.count() and stage(spark, empty, sf).count() == 0


def brute_similar(texts, ids):
    """The smallest id of each text's component of links by Jaccard similarity."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for n, a in enumerate(sets):
        for m, b in enumerate(sets[:n]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[max(find(n), find(m))] = min(find(n), find(m))
    least = defaultdict(list)
    for n, i in enumerate(ids):
        least[find(n)].append(i)
    return [min(least[find(n)]) for n in range(len(sets))]


def test_near_copies_by_jaccard(spark, sf):
    docs = corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    local = [(r.doc_id, r.text) for r in docs.collect()]
    least = brute_similar([t for _, t in local], [i for i, _ in local])
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()) == sorted(set(least)) and len(set(least)) < len(local)


@pytest.mark.parametrize("share", [1, 4096])
def test_similar_components_of_families(spark, tmp_path, share, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    monkeypatch.setattr(similar, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(similar, "SLOT_KEYS", 50)
    monkeypatch.setattr(similar, "SENT_ROWS", 0 if share == 1 else 1 << 19)
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(500)]
    texts = [None, "", " ", "a", "A", "a b", "one two three four five", "one two three four five six"]
    common = rng.choices(vocabulary, k=60)
    for size in (12, 40, 90):
        base = rng.choices(vocabulary, k=size)
        for _ in range(40):
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
    for k in (5, 10, 15, 30):  # texts that share most of a passage
        texts += [" ".join(common + rng.choices(vocabulary, k=k)) for _ in range(15)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    found = {r.doc_id: r.component_id for r in similar_components(spark.read.parquet(path)).collect()}
    assert found == dict(enumerate(brute_similar(texts, range(len(texts)))))
    assert len(set(found.values())) > 20
    assert similar_components(spark.read.parquet(path).limit(0)).count() == 0


def test_simhash_proposes_links_first(spark, tmp_path):
    """SimHash gives candidates of the stage: all texts of one fingerprint, and those of fingerprints 3 bits apart, meet."""
    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(500)]
    base = rng.choices(vocabulary, k=400)
    texts = [None, "", "a b"] + [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 400, 20)] + [" ".join(rng.choices(vocabulary, k=50)) for _ in range(20)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    rows = similar._prefixes(spark.read.parquet(path).selectExpr("doc_id AS id", "text"), 5).cache()
    fps = {r.node: r.fp % (1 << 64) for r in rows.collect()}
    for r in rows.collect():
        hashes = similar._hashes((texts[r.id] or "").encode(), 5)
        assert fps[r.node] == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    root = {n: n for n in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    found = similar._proposed(rows.dropDuplicates(["node"])).collect()
    for a, b in found:
        assert (fps[a] ^ fps[b]).bit_count() <= 3 and a < b
        root[find(a)] = find(b)
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert len(near) > 10 and all(find(a) == find(b) for a, b in near)


def test_prefixes_fill_all_slots(spark, tmp_path):
    """Prefixes have the smallest hashes, but no slot of an exchange, a range of its keys, holds much more than its share."""
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(100, 300))) for _ in range(100)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.parquet(path)
    rows = similar._prefixes(spark.read.parquet(path), 5)
    tokens = np.concatenate([np.frombuffer(r.tokens, "<u8") for r in rows.collect()])
    sent = np.bincount((tokens >> np.uint64(61)).astype(int), minlength=8)
    assert len(tokens) > 3000 and sent.max() < 1.3 * sent.mean()
    blocks = similar._packed(rows)
    keys, counts = np.unique(tokens, return_counts=True)
    shared = np.concatenate([np.frombuffer(r.tokens, "<u8") for r in similar._shared(blocks).collect()])
    assert sorted(set(shared)) == sorted(keys[counts > 1])
