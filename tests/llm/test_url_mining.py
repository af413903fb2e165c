"""Rule mining with many tokens that come together: bounded, and the same rules by both ways."""

import random
import time

import pytest

from quern.llm import url_filter
from quern.llm.url_filter import mine


def rows(spark, n, tokens, share, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        held = [f"t{k:02d}" for k in range(tokens) if rng.random() < share]
        out.append((held + [f"own{rng.randrange(10**6)}"], "block" if "t00" in held and rng.random() < 0.97 else "allow"))
    return spark.createDataFrame(out, "tokens array<string>, label string").repartition(4)


@pytest.mark.parametrize("tokens,share", [(3, 0.5), (6, 0.7), (9, 0.3)])
def test_both_ways_give_the_same_rules(spark, tokens, share, monkeypatch):
    held = rows(spark, 400, tokens, share, tokens)
    by_growth = mine(held, min_rows=8)
    monkeypatch.setattr(url_filter, "MOST_SETS", 0)
    by_length = mine(held, min_rows=8)
    assert by_growth.stands_for == by_length.stands_for and by_growth.rules
    assert [(t, v, round(c, 9), round(s, 9)) for t, v, c, s in by_growth.rules] == [(t, v, round(c, 9), round(s, 9)) for t, v, c, s in by_length.rules]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_shorter_rules(spark, most, monkeypatch):
    held = rows(spark, 300, 6, 0.5)
    by_growth = mine(held, min_rows=8, max_tokens=most, min_confidence=0.6)
    monkeypatch.setattr(url_filter, "MOST_SETS", 0)
    by_length = mine(held, min_rows=8, max_tokens=most, min_confidence=0.6)
    assert [r[:2] for r in by_growth.rules] == [r[:2] for r in by_length.rules] and max(len(r[0]) for r in by_growth.rules) <= most


def test_many_tokens_in_almost_all_rows(spark):
    """24 tokens, each in 97 % of 3,000 rows: sets of all lengths would be 2^24."""
    held = rows(spark, 3000, 24, 0.97)
    held.count()
    began = time.time()
    found = mine(held)
    assert time.time() - began < 60
    assert [(t, v) for t, v, *_ in found.rules if t == ("t00",)] == [(("t00",), "block")]


def test_no_rows(spark):
    assert mine(rows(spark, 20, 3, 0.5).where("false")).rules == []
