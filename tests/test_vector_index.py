"""The vector index: recall against brute force, odd rows, a cell that holds most rows, what the scan reads."""

import random

import numpy as np
import pytest

from quern.operators import vector_index as vx
from quern.plans import ALL_QUERIES


def unit(v):
    return np.array(v, np.float32).astype(np.float64) / np.linalg.norm(np.array(v, np.float32).astype(np.float64))


def brute(rows, queries, k):
    every = np.array([unit(v) for _, v in rows])
    out = {}
    for q, v in queries:
        scores = np.round(every @ unit(v), 6)
        out[q] = sorted(((-s, i) for s, (i, _) in zip(scores.tolist(), rows, strict=True)))[:k]
    return {(q, n, i, -s) for q, best in out.items() for n, (s, i) in enumerate(best, 1)}


def recall(found, expected):
    """Of the nearest rows by brute force, how many are found; rows of equal score stand for each other."""
    least = {}
    for q, _, _, s in expected:
        least[q] = min(s, least.get(q, 9))
    return sum(r[3] >= least[r[0]] for r in found) / len(expected)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    at = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    expected = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    found = [tuple(r) for r in ALL_QUERIES["ann_nearest"](spark, at).collect()]
    assert len(found) == len(expected) and recall(found, expected) >= 0.9
    assert all(s == pytest.approx(next(x[3] for x in expected if x[0] == q and x[2] == i)) for q, _, i, s in found if any(x[0] == q and x[2] == i for x in expected))


def test_odd_rows_and_a_large_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vx, "TILE", 16)
    monkeypatch.setattr(vx, "PART", 8)
    rng = random.Random(3)
    rows = [(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(300)] + [(n, [1.0] * 8) for n in range(300, 500)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [None] * 8), (None, [1.0] * 8)]
    held = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").repartition(4)
    cells = vx.build_vectors(held, str(tmp_path / "i"), cells=6)
    assert cells == 6
    tiles = spark.read.parquet(str(tmp_path / "i" / "tiles")).select("cell", "n", "keys").collect()
    assert sorted(k for r in tiles for k in r["keys"]) == [n for n, _ in rows] and max(r.n for r in tiles) <= 16
    asked = held.where("vec_id % 20 = 0 or vec_id is null or vec_id >= 900")
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 5)
    every = vx.search_vectors(spark, str(tmp_path / "i"), asked, 5, probes=6, rerank=300)
    assert {tuple(r) for r in every.collect()} == expected
    some = [tuple(r) for r in vx.search_vectors(spark, str(tmp_path / "i"), asked, 5, probes=1).collect()]
    assert 0.2 < recall(some, expected) <= 1


def test_scan_names_the_cells(spark, tmp_path):
    rng = random.Random(4)
    rows = spark.createDataFrame([(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(400)], "vec_id long, embedding array<float>")
    vx.build_vectors(rows, str(tmp_path / "i"))
    plan = vx.search_vectors(spark, str(tmp_path / "i"), rows.where("vec_id = 7"), 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shelf" in plan and "PushedFilters: [In(cell" in plan


def test_probes_for_clustered_and_other_vectors(spark, tmp_path):
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(8)]
    near = [(n, [x + rng.gauss(0, 0.02) for x in middles[n % 8]]) for n in range(400)]
    far = [(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(400)]
    probes = {}
    for name, rows in (("near", near), ("far", far)):
        held = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        vx.build_vectors(held, str(tmp_path / name), cells=16)
        probes[name] = vx.probes_for(spark, str(tmp_path / name), held, 5)
    assert 1 <= probes["near"] <= 4 <= probes["far"] <= 16


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vx.build_vectors(none, str(tmp_path / "i")) == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert vx.search_vectors(spark, str(tmp_path / "i"), one).collect() == []
    vx.build_vectors(one, str(tmp_path / "j"))
    assert vx.search_vectors(spark, str(tmp_path / "j"), none).collect() == []
    assert [tuple(r) for r in vx.search_vectors(spark, str(tmp_path / "j"), one).collect()] == [(1, 1, 1, 1.0)]


def test_a_block_keeps_the_best_of_all_its_cells(spark, tmp_path, monkeypatch):
    """Rows left to sort are rerank for each query and block, however many cells are probed; blocks, cuts and parts find the same."""
    rng = random.Random(6)
    rows = [(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(400)] + [(n, [1.0] * 8) for n in range(400, 600)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vx.build_vectors(held, str(tmp_path / "i"), cells=20)
    asked, made = held.where("vec_id % 25 = 0"), []
    groups = type(held.groupBy("vec_id"))
    inner = groups.applyInArrow
    monkeypatch.setattr(groups, "applyInArrow", lambda self, *a: made.append(inner(self, *a)) or made[-1])
    whole = {tuple(r) for r in vx.search_vectors(spark, str(tmp_path / "i"), asked, 5, probes=20, rerank=10).collect()}
    assert made[0].count() == 24 * 10
    expected = brute(rows, [r for r in rows if r[0] % 25 == 0], 5)
    full = vx.search_vectors(spark, str(tmp_path / "i"), asked, 5, probes=20, rerank=600)
    assert {tuple(r) for r in full.collect()} == expected
    some = {tuple(r) for r in vx.search_vectors(spark, str(tmp_path / "i"), asked, 5, probes=3, rerank=10).collect()}
    for name, value in {"BLOCK": 32, "PART": 4, "SLICE": 3, "MERGED": 16}.items():
        monkeypatch.setattr(vx, name, value)
    assert {tuple(r) for r in vx.search_vectors(spark, str(tmp_path / "i"), asked, 5, probes=20, rerank=10).collect()} == whole
    assert {tuple(r) for r in vx.search_vectors(spark, str(tmp_path / "i"), asked, 5, probes=3, rerank=10).collect()} == some
