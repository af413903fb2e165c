"""Cross-tokenizer alignment against brute force on whole texts, and counts over all documents."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import tokenizer_alignment
from quern.llm.queries import queries, tokenizer_path
from quern.llm.tokenizer_alignment import Aligned, Aligner, align, rendered, score_alignment, slices
from quern.llm.token_output import BYTE_SIGNS

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CLASHES = ["id", "a_ids", "b_ids", "a_ends", "payload", "pair", "block", "n_a", "a.b", "tick`ed", "total"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def groups_of(text, tokenizers):
    """Groups of one text by the definition: both encode all of it, ends are compared one by one."""
    if not text:
        return []
    left, right = tokenizers
    a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
    raw = {s: bytes([n]) for n, s in enumerate(BYTE_SIGNS)}
    a_bytes = [b"".join(raw[s] for s in left.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(right.id_to_piece, b)]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return []
    out, x, y = [], 0, 0
    while x < len(a):
        own, other, i, j = a_bytes[x], b_bytes[y], x + 1, y + 1
        while len(own) != len(other):
            if len(own) < len(other):
                own, i = own + a_bytes[i], i + 1
            else:
                other, j = other + b_bytes[j], j + 1
        out.append((a[x:i], b[y:j]))
        x, y = i, j
    return out


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(rows, tokenizers):
    per = [(i, groups_of(t, tokenizers)) for i, t in rows]
    links = Counter((a[-1], b[-1]) for _, groups in per for a, b in groups)
    best = Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = []
    for i, groups in per:
        counts = [links[a[-1], b[-1]] for a, b in groups]
        top = sum(links[a[-1], b[-1]] == best[b[-1]] for a, b in groups)
        digest = hashlib.sha256(said(groups).encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(counts), top, sum(counts), digest))
    return sorted(out, key=repr)


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "  two  spaces  ", "▁", "a▁b", "<|endoftext|> is text", "</s><s><unk> <0x41>", "\x00\x01 \x1c", "tab\tnew\nline \n x", "été ÉTÉ é", "日本語 テキスト", "😀 👩‍👩 x", "nbsp x  y", "don't we'll I'M", "1234567 89,00", "x" * 3000, "a b " * 500, "　 x  y", "﻿ bom", "ﬁ ligature"]


def texts(n, seed=2):
    rng = random.Random(seed)
    alphabet = [*"abcdeABC  \n\t  .,'12▁é日😀 \u0085​\x1c", " the", " and", "'s", "ing "]
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(n)]


def test_stretches_give_the_ids_of_whole_texts(tokenizers):
    own, all_texts = Aligner(tokenizer_path(A), tokenizer_path(B)), [*filter(None, ODD), "", *texts(3000)]
    assert own.cuts
    for text, found in zip(all_texts, rendered(own(all_texts)), strict=True):
        assert found == said(groups_of(text, tokenizers)), repr(text)


def test_every_letter_and_sign(tokenizers):
    own = Aligner(tokenizer_path(A), tokenizer_path(B))
    some = [x for c in map(chr, [*range(1, 0x300), *range(0x370, 0x3000, 7), 0xFB01, 0xFF21, 0x1D400]) for x in (f"{c}", f"ab{c}", f"x {c}b c{c} {c}.")]
    for text, found in zip(some, rendered(own(some)), strict=True):
        assert found == said(groups_of(text, tokenizers)), repr(text)


def test_without_cuts_the_same(tokenizers, monkeypatch):
    some = texts(200, seed=9)
    cut = Aligner(tokenizer_path(A), tokenizer_path(B))(some)
    own = Aligner(tokenizer_path(A), tokenizer_path(B))
    own.cuts = False
    monkeypatch.setattr(tokenizer_alignment, "REMEMBERED", 10)
    for _ in range(2):
        assert all(np.array_equal(x, y) for x, y in zip(cut, own(some), strict=True))


def test_slices():
    assert slices(np.array([1, 1, 1]), np.array([2, 1])) == ([2, 3], [1, 2])
    assert slices(np.array([2, 2, 1]), np.array([1, 1, 1, 2])) == ([1, 3], [2, 4])
    assert slices(np.array([], int), np.array([], int)) == ([], [])


def test_forgetting_changes_nothing(tokenizers, monkeypatch):
    monkeypatch.setattr(tokenizer_alignment, "REMEMBERED", 40)
    own, rng = Aligner(tokenizer_path(A), tokenizer_path(B)), random.Random(7)
    pool = texts(60, seed=3)
    for _ in range(30):
        some = rng.choices(pool, k=5)
        assert rendered(own(some)) == [said(groups_of(t, tokenizers)) for t in some]
    assert len(own.at) == len(own.spelt) == len(own.uses) == len(own.sides[0].sizes)


@pytest.mark.parametrize("block", [1, 50, 1 << 22])
def test_counts_over_all_documents(spark, tokenizers, tmp_path, block, monkeypatch):
    monkeypatch.setattr(tokenizer_alignment, "BLOCK_LINKS", block)
    monkeypatch.setattr(tokenizer_alignment, "CHUNK", 3 * block)
    rows = [*enumerate([*ODD, *texts(60), "the same again and again", "the same again and again"]), (3, "the same again"), (3, "the same again"), (None, "no id")]
    more = ", ".join("`" + c.replace("`", "``") + "` map<string,int>" for c in CLASHES)
    spark.createDataFrame([(*r, *[None] * len(CLASHES)) for r in rows], f"doc_id long, text string, {more}").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = score_alignment(docs, tokenizer_path(A), tokenizer_path(B))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr) == brute(rows, tokenizers)
    none = score_alignment(docs.where("false"), tokenizer_path(A), tokenizer_path(B))
    assert none.collect() == []
    for row in align(docs, tokenizer_path(A), tokenizer_path(B)).collect():
        own = Aligned(*(np.array(x, np.int32) for x in row[1:]), *(np.array([len(x)]) for x in row[1:4]))
        assert rendered(own)[0] in {said(groups_of(t, tokenizers)) for i, t in rows if i == row.doc_id}
    assert align(docs.where("false"), tokenizer_path(A), tokenizer_path(B)).collect() == []


def test_query_on_real_rows(spark, sf, tokenizers):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = queries()["op11_tokenizer_alignment"](spark, sf)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, tokenizers)
    assert found.where(F.col("n_links") > 0).count() > 100
