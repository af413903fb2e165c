"""Line dedup against brute force: odd lines, hot lines, repeated rows, null ids, clashing columns."""

import random
from collections import Counter, defaultdict

import pytest

from quern import skew
from quern.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"
CLASHES = ["id", "digest", "dropped", "lines", "pos", "key", "low", "high", "n", "m", "last", "of_id", "parts", "a.b", "tick`ed", "TEXT2"]


def key(line):
    line = line.strip(BLANKS)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    last = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def table(spark, rows, path):
    more = ", ".join("`" + c.replace("`", "``") + "` map<string,int>" for c in CLASHES)
    spark.createDataFrame([(*r, *[None] * len(CLASHES)) for r in rows], f"doc_id long, text string, {more}").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def order(rows):
    return sorted(rows, key=repr)


ROWS = [
    (1, None), (2, ""), (3, "\n"), (4, "short\n" * 4), (5, "exactly twenty chars"), (6, " EXACTLY TWENTY CHARS\t"), (7, "exactly Twenty chars\r\nexactly twenty chars\nown"), (8, "exactly twenty char"), (9, "exactly twenty char"), (10, "exactly twenty char"),
    (11, "nineteen code point\U0001f600"), (12, "nineteen code point\U0001f600"), (13, "nineteen code point\U0001f600\nend"), (14, "ÉTÉ is not made small here"), (15, "été is not made small here"), (16, "ÉTÉ is not made small here\n"),
    (17, "held by a null id as well"), (18, "held by a null id as well"), (None, "held by a null id as well\nand so on"), (None, None), (19, "the row comes twice, with its id"), (19, "the row comes twice, with its id"), (20, "the row comes twice, with its id"),
    (21, "two texts of an id\nthe row comes twice, with its id"), (21, "another text of it\nthe row comes twice, with its id"), (22, "nbsp stays at the end of it "), (23, "nbsp stays at the end of it"), (24, "nbsp stays at the end of it "),
]


@pytest.mark.parametrize("share", [1, 4096])
def test_odd_lines(spark, tmp_path, share, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    found = dedup_lines(table(spark, ROWS, str(tmp_path / "d")))
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert order(map(tuple, found.collect())) == order(brute(ROWS))


def test_random_lines_and_a_hot_one(spark, tmp_path):
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcAB ", k=rng.randint(15, 26))) for _ in range(40)]
    rows = [(n, "\n".join([*rng.choices(pool, k=rng.randint(0, 12)), *["the same footer on every page"] * rng.randint(0, 2)])) for n in range(400)]
    found = dedup_lines(table(spark, rows, str(tmp_path / "d"))).collect()
    assert order(map(tuple, found)) == order(brute(rows))
    assert Counter(r.n_dropped > 0 for r in found)[True] > 300


def test_long_text_and_thresholds(spark, tmp_path):
    rows = [(1, "\n".join(f"a line with number {n % 30_000}" for n in range(60_000))), (2, "a line with number 7\n" * 3), (3, "A LINE WITH NUMBER 7"), (4, "x" * 300_000)]
    docs = table(spark, rows, str(tmp_path / "d"))
    for chars, least in ((20, 3), (1, 2), (0, 1), (20, 99)):
        assert order(map(tuple, dedup_lines(docs, min_chars=chars, min_docs=least).collect())) == order(brute(rows, chars, least))


def test_empty_table(spark, tmp_path):
    docs = table(spark, ROWS, str(tmp_path / "d"))
    assert dedup_lines(docs.where("false")).collect() == []
