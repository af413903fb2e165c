"""Fuzzy joins against brute force."""

import random
import re

import pytest

from quern.operators import fuzzy as fz
from quern.plans import ALL_QUERIES


def norm(t):
    return re.sub(r"^(see|cf\.?|per|in)\s+", "", " ".join(t.lower().split()))


def brute(text, keys, percent=60):
    if text is None or not norm(text):
        return None, 0
    if text in dict(keys):
        return max(i for k, i in keys if k == text), 1
    names = {}
    for k, i in keys:
        if k and norm(k):
            names[norm(k)] = max(i, names.get(norm(k), i))
    t = norm(text)
    if t in names:
        return names[t], 2
    inside = [(len(k), -i) for k, i in names.items() if t in k or k in t]
    if inside:
        return -max(inside)[1], 3
    words, best = set(t.split()), []
    for k, i in names.items():
        common, most = len(words & set(k.split())), max(len(words), len(set(k.split())))
        if len(words) >= 2 and 100 * common >= percent * most:
            best.append((common / most, -i))
    return (-max(best)[1], 4) if best else (None, 0)


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_join(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(2, 3)))
    line = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 3, 3, 4, 4, 5])))
    keys = [(line(), n) for n in range(60)] + [("", 90), (None, 91), ("  ", 92), ("See A  b c", 93), ("a b c", 94), ("a b c", 95)]
    mixed = [" ".join(rng.sample(k.split(), len(k.split()))) + rng.choice(["", " zz"]) for k, _ in keys[:60]]
    keys = [x for x in keys[:60] if x[0].count(" ") > 1 or rng.random() < 0.1] + keys[60:]
    asked = [*mixed, None, "", "  ", "see", "A b C", "see a b c", "cf. a b c", "in per x", *[line() for _ in range(120)], *[k for k, _ in keys[:10]], "a b c", "a b c"]
    found = fz.fuzzy_join(spark.createDataFrame(list(enumerate(asked)), "n long, text string"), spark.createDataFrame(keys, "key string, id long")).collect()
    assert sorted((r.n, r.target, r.tier) for r in found) == [(n, *brute(t, keys)) for n, t in enumerate(asked)]
    assert {r.tier for r in found} == {0, 1, 2, 3, 4}


def places(quote, passage, percent=15):
    q, p = quote.lower().split(), (passage or "").lower().split()
    return fz.align(q, p, len(q) * percent // 100) if q and p else None


def test_align():
    assert fz.align(list("abcd"), list("xxabcdyy"), 0) == (0, 2, 6)
    assert fz.align(list("abcd"), list("xxabxdyy"), 1) == (1, 2, 6) and fz.align(list("abcd"), list("abxd"), 0) is None
    assert fz.align(list("abcd"), list("xabdyabcd"), 1) == (0, 5, 9)


@pytest.mark.parametrize("percent", [0, 15, 30])
def test_quotes_against_whole_passages(spark, percent):
    rng = random.Random(percent)
    pool = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(40)]
    passages = [(n, " ".join(rng.choices(pool, k=rng.randint(1, 120)))) for n in range(40)] + [(100, None), (101, ""), (102, " \n "), (103, "One two\nTHREE  four")]
    quotes = []
    for _ in range(60):
        words = rng.choice(passages[:40])[1].split()
        at, n = rng.randrange(len(words)), rng.randint(1, 25)
        own = words[at : at + n]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(own))
            own[k : k + rng.randint(0, 1)] = [rng.choice(pool)] * rng.randint(0, 1)
            own = own or ["x"]
        quotes.append(" ".join(own))
    quotes = [*dict.fromkeys(quotes), None, "", "  ", "two three", "TWO  THREE four"]
    found = fz.find_quotes(spark.createDataFrame(list(enumerate(quotes)), "quote long, text string"), spark.createDataFrame(passages, "passage long, text string").repartition(4), percent=percent).collect()
    expected = {(n, i): at for n, q in enumerate(quotes) if q for i, p in passages if (at := places(q, p, percent))}
    assert {(r.quote, r.passage): (r.changes, r.start, r.end) for r in found} == expected
    words = {i: (p or "").lower().split() for i, p in passages}
    assert all(r.stretch.split() == words[r.passage][r.start : r.end] for r in found) and len(expected) > 40


def test_query_finds_planted_passages(spark, sf):
    found = ALL_QUERIES["quotes_in_documents"](spark, sf)
    assert found.columns == ["quote", "passage", "changes", "start", "end", "stretch"]
    docs = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = found.collect()
    assert rows and all(docs[r.passage][r.start : r.end] == r.stretch.split() for r in rows)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "quote long, passage long, n long, id long, text string, key string"), spark.createDataFrame([(1, 1, 1, 1, "a b c", "a b c")], "quote long, passage long, n long, id long, text string, key string")
    assert fz.find_quotes(none, some).collect() == [] and fz.find_quotes(some, none).collect() == []
    assert fz.fuzzy_join(none.select("n", "text"), some).collect() == [] and fz.fuzzy_join(some.select("n", "text"), none).first().tier == 0


def test_nearest_end_is_that_of_the_alignment():
    rng = random.Random(5)
    for _ in range(2000):
        quote, window = rng.choices("abc", k=rng.randint(1, 70)), rng.choices("abc", k=rng.randint(0, 80))
        changes, start, end = fz.align(quote, window, 100)
        assert fz.nearest_end(quote, window) == (changes, end)
        cut = max(0, end - len(quote) - changes)
        assert fz.align(quote, window[cut:end], 100) == (changes, start - cut, end - cut) and (changes or start == end - len(quote))


def test_common_words_lead_to_few_places(spark, monkeypatch):
    """Quotes and passages that share a frequent stretch, but no whole part, do not meet."""
    settled, settle = {}, fz.settle

    def counted(df, name):
        settled[name] = settle(df, name)
        return settled[name]

    monkeypatch.setattr(fz, "settle", counted)
    quotes = [(n, f"of the law q{n} r{n} s{n}") for n in range(100)]
    passages = [(n, f"v{n} w{n} of the law x{n} y{n} z{n} " + (quotes[n][1] if n < 3 else "")) for n in range(300)]
    found = fz.find_quotes(spark.createDataFrame(quotes, "quote long, text string"), spark.createDataFrame(passages, "passage long, text string")).collect()
    assert sorted((r.quote, r.passage, r.changes) for r in found) == [(n, n, 0) for n in range(3)]
    assert settled["places"].count() == 3
