"""Hard negatives against brute force: ties, negative scores, odd vectors, repeated rows, null ids, several blocks and tiles."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import hard_negatives
from quern.llm.hard_negatives import mine_negatives, strassen

CLASHES = ["id", "vector", "anchor", "block", "rank", "score", "nth", "a.b", "tick`ed"]
NAN, INF = float("nan"), float("inf")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(1, 9), st.integers(0, 2**40), st.integers(0, 99))
def test_strassen_is_exact(m, k, n, leaf, most, seed):
    rng = np.random.default_rng(seed)
    most = min(most, 2**29)
    a, b = rng.integers(-most, most + 1, (m, k)), rng.integers(-most, most + 1, (k, n))
    assert np.array_equal(strassen(a, b, leaf), a @ b)


def test_strassen_wraps_back():
    a = np.full((4, 4), 2**30, np.int64) * np.array([1, -1, 1, -1])
    b = np.full((4, 4), 2**30, np.int64)
    assert np.array_equal(strassen(a, b, 1), a @ b) and np.array_equal(strassen(a[:0], b, 1), a[:0] @ b)


def brute(rows, scale=256, positives=5, negatives=10, low=30, high=90, every=100):
    usable = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in (r for r in usable if r[0] is not None and r[0] % every == 0):
        key = lambda r: (-r[0], r[1] is None, r[1] or 0)
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in usable]
        for ps, j, _ in sorted((s for s in scored if s[2] == y and s[1] != i), key=key)[:positives]:
            inside = sorted((s for s in scored if s[2] != y and low * ps <= 100 * s[0] <= high * ps), key=key)[:negatives]
            out += [(i, j, n, k, ps, s) for n, (s, k, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def table(spark, rows, path):
    more = ", ".join("`" + c.replace("`", "``") + "` map<string,int>" for c in CLASHES)
    spark.createDataFrame([(*r, *[None] * len(CLASHES)) for r in rows], f"vec_id long, label int, embedding array<float>, {more}").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def mined(rows, **more):
    found = mine_negatives(rows, F.col("vec_id") % 100 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=repr)


def vectors(n, seed=4, width=6, ids=25):
    rng = random.Random(seed)
    # Few values: many ties and many equal vectors.
    return [(rng.randrange(ids) * 20, rng.randrange(3), [rng.choice([0.0, 0.5, 1.0, -0.25]) for _ in range(width)]) for _ in range(n)]


ODD = [(100, 1, None), (100, None, [1.0]), (200, 1, [None, 1.0]), (200, 1, [NAN]), (300, 1, [INF]), (300, 2, [-INF]), (None, 1, [1.0, 1.0]), (None, 2, [0.5, 0.5, 0.5]), (400, 1, []), (400, 2, [1.0] * 9), (None, None, None)]


@pytest.mark.parametrize("sizes", [(8192, 256, 2048), (3, 2, 4), (1, 1, 1)])
def test_against_brute_force(spark, tmp_path, sizes, monkeypatch):
    for name, size in zip(("BLOCK", "ANCHORS", "ROWS"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = [*vectors(60), *ODD, *vectors(8)]
    assert mined(table(spark, rows, str(tmp_path / "v"))) == brute(rows)


def test_more_rows_and_other_windows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, rng.randrange(4), [rng.gauss(0, 0.3) + 0.1 for _ in range(16)]) for n in range(3000)]
    held = table(spark, rows, str(tmp_path / "v"))
    assert mined(held) == brute(rows)
    more = {"positives": 2, "negatives": 3, "low": 0, "high": 100, "scale": 1000}
    assert mined(held, **more) == brute(rows, **more)


def test_no_rows_no_positives_and_too_large(spark, tmp_path):
    held = table(spark, [(100, 1, [1.0]), (1, 2, [1.0])], str(tmp_path / "v"))
    assert mined(held) == [] and mined(held.where("false")) == []
    with pytest.raises(OverflowError):
        mined(table(spark, [(100, 1, [3e38]), (200, 1, [3e38])], str(tmp_path / "w")))
