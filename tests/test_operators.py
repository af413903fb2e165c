"""Operators on small literal tables."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.functions import scores as sc
from quern.functions import text as tx
from quern.operators import filters as fl
from quern.operators import graph as gr
from quern.operators import joins as jo
from quern.operators import profiles as pr
from quern.operators import search as se
from quern.operators.sections import SIZES, chunk, chunk_documents, find_sections
from quern.sources import tables as src
from quern.streaming.limits import Breaker, Window, circuit_breaker, rate_limit


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def lists(spark, *names):
    return [spark.createDataFrame([(d, n + 1) for n, d in enumerate(x)], "id string, rank int") for x in names]


def test_fusion_scores(spark):
    a, b = lists(spark, "abc", "bad")
    found = {r.id: r.score for r in se.fuse([a, b], "id").collect()}
    assert set(sorted(found, key=found.get)[-2:]) == {"a", "b"} and len(found) == 4
    a, b = lists(spark, "ab", "ba")
    assert all(r.score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) for r in se.fuse([a, b], "id").collect())
    with pytest.raises(ValueError):
        se.fuse([a, b], "id", weights=[1.0])


def test_boost_keeps_unsignalled(spark):
    merged = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, score double")
    signals = spark.createDataFrame([("a", 500.0)], "id string, signal double")
    assert {r.id: r.score for r in se.boost(merged, signals, "id").collect()} == {"a": 2.0, "b": 2.0}


GRAPH = [("c", "a", "followed"), ("d", "b", "distinguished"), ("c", "b", "affirmed"), ("d", "a", "overruled")]


def test_graph_fixture(spark):
    edges = spark.createDataFrame(GRAPH, "src string, dst string, treatment string")
    nodes = spark.createDataFrame([("a", 2020), ("b", 2018), ("c", 2022), ("d", 2023), ("e", None)], "id string, year int")
    assert {r.id: r.positive_pct for r in gr.treatment_shares(edges, nodes).collect()} == {"a": 0.5, "b": 0.5, "c": 1.0, "d": 1.0, "e": 1.0}
    assert {r.id: r.cited_by for r in gr.in_degree(edges, nodes).collect()} == {"a": 2, "b": 2, "c": 0, "d": 0, "e": 0}
    assert {r.id: r.verdict for r in gr.treatment_verdict(edges).collect()} == {"a": "Overruled", "b": "Mixed"}
    assert {r.id: r.rising for r in gr.rising(edges, nodes, 2023).collect()}["a"] == 0.5
    ranks = gr.page_rank(edges, nodes).collect()
    assert sum(r.rank for r in ranks) == pytest.approx(1.0)
    assert max(r.score for r in gr.max_normalise(spark.createDataFrame(ranks)).collect()) == 100


def test_paths_loops_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (7, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    assert [r.node for r in gr.shortest_path(edges, 1, 4).orderBy("step").collect()] == [1, 2, 3, 4]
    assert gr.shortest_path(edges, 4, 1).count() == 0
    assert {r.id: r.component for r in gr.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8}
    found = gr.louvain(edges, nodes).collect()
    assert sorted(r.id for r in found) == list(range(1, 9))
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert {r.node: r.depth for r in gr.k_hop(edges, seeds, 2, both_ways=False).collect()} == {1: 0, 2: 1, 3: 2}


def brute_window(times, limit, seconds):
    kept, out = [], []
    for t in times:
        ok = sum(k > t - seconds for k in kept) < limit
        kept += [t] * ok
        out.append(ok)
    return out


def test_rate_limit_denied_requests_do_not_count(spark):
    rng = random.Random(3)
    rows = [(k, float(t), n) for k in range(5) for n, t in enumerate(sorted(rng.randint(0, 500) for _ in range(60)))]
    df = spark.createDataFrame(rows, "k int, t double, n int").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.k, r.n): r.allowed for r in rate_limit(df, "k", "ts", "n", 5, 60).collect()}
    for k in range(5):
        times = [t for kk, t, _ in rows if kk == k]
        assert [got[k, n] for n in range(60)] == brute_window(times, 5, 60)
    assert [Window(6, 60)(t) for t in (0,)] == [True]


def by_user(spark, sf):
    rows = sorted((r.user_id, r.ts, r.event_id, r.value) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    users = {}
    for user, ts, event, value in rows:
        users.setdefault(user, []).append((ts.timestamp(), event, value))
    return users


def test_rate_limit_query(spark, sf):
    from quern.plans import ALL_QUERIES

    got = {r.event_id: r.allowed for r in ALL_QUERIES["rate_limit_window"](spark, sf).collect()}
    expected = {}
    for events in by_user(spark, sf).values():
        expected |= dict(zip((e for _, e, _ in events), brute_window([t for t, _, _ in events], 3, 6 * 3600), strict=True))
    assert got == expected and set(got.values()) == {True, False}


def test_circuit_breaker_query(spark, sf):
    from quern.plans import ALL_QUERIES

    got = {r.event_id: r.allowed for r in ALL_QUERIES["circuit_breaker_events"](spark, sf).collect()}
    expected = {}
    for events in by_user(spark, sf).values():
        # After two failures in a row nothing passes for an hour, then one trial.
        failures, opened = 0, None
        for t, event, value in events:
            allowed = opened is None or t - opened >= 3600
            expected[event] = allowed
            if not allowed:
                continue
            if value < 20:
                failures += 1
                if opened is not None or failures >= 2:
                    opened = t
            else:
                failures, opened = 0, None
    assert got == expected and set(got.values()) == {True, False}


def test_breaker():
    b = Breaker(2, 10)
    assert [b(t, bad) for t, bad in ((0, True), (1, True), (2, False), (12, True), (13, False), (23, False), (24, False))] == [True, True, False, True, False, True, True]


def test_breaker_on_tables(spark):
    df = spark.createDataFrame([(1, 0.0, 0, True), (1, 1.0, 1, True), (1, 2.0, 2, False), (2, 2.0, 3, False)], "k int, t double, n int, bad boolean").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.n: r.allowed for r in circuit_breaker(df, "k", "ts", "n", F.col("bad"), 2, 10).collect()} == {0: True, 1: True, 2: False, 3: True}


def test_chunks_cover_texts():
    rng = random.Random(1)
    for _ in range(60):
        words = rng.choices(["word", "court.", "held", "Mr.", "FACTS\n", "\n\n", "order", "\nORDER\n", "\nIssues:\n"], k=rng.randint(0, 3000))
        text = " ".join(words)
        covered = 0
        for _kind, a, b in chunk(text):
            assert b - a <= SIZES[False][0]
            assert not text[covered:a].strip()
            covered = max(covered, b)
        assert not text[covered:].strip()
    assert [k for k, _, _ in find_sections("Intro line\nFACTS\nsome facts that are long enough to be kept here\nORDER\nappeal allowed")] == ["HEADER", "FACTS", "ORDER"]


def test_chunk_documents_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id int, text string")
    assert [(r.doc_id, r.body) for r in chunk_documents(df).collect()] == [(3, "x")]


def test_treatments(spark):
    text = "It was not followed there, but followed here, and stood overruled."
    assert [(r.treatment, r.n) for r in one(spark, tx.treatments("t"), t=text)] == [("overruled", 1), ("not_followed", 1), ("followed", 1)]
    assert one(spark, tx.is_overruling("t"), t="decided per incuriam") is True


def test_citations(spark):
    text = "See (2020) 3 SCC 145; AIR 1978 SC 597; [2020] 3 SCC 145 and 2021 XYZ 12, MANU / SC / 1 / 2020"
    assert [(r.reporter, r.citation) for r in one(spark, tx.extract_citations("t"), t=text)] == [("SCC", "(2020) 3 SCC 145"), ("AIR", "AIR 1978 SC 597"), ("GENERIC", "2021 XYZ 12")]

    assert one(spark, tx.normalize_citation("t"), t="[2019] 5 SCC 1.") == "(2019) 5 SCC 1"


def test_section_lists(spark):
    assert one(spark, tx.expand_sections("t"), t="302-304, 307 and 34/35") == ["302", "303", "304", "307", "34", "35"]
    assert one(spark, tx.expand_sections("t"), t="10-90") == ["10-90"]


def test_names(spark):
    assert one(spark, tx.parse_judges("t"), t="Hon'ble Mr. Justice D. Y. Chandra, J.; Dr. A.B. Roy") == ["D.Y. Chandra", "A.B. Roy"]
    assert one(spark, tx.normalize_counsel("t"), t="Mr. R.K. Sharma, Sr. Adv.") == "R.K. Sharma"


def test_masking(spark):
    assert one(spark, tx.mask_pii("t"), t="1234 5678 9012 or +91 9876543210 or ABCPK1234Z") == "[AADHAAR REDACTED] or [PHONE REDACTED] or [PAN REDACTED]"


def test_cleaning(spark):
    assert one(spark, tx.clean_text("t"), t="self—made​  \n\n\n\n 12 \nend\x07 ") == "self-made\n\nend"
    assert one(spark, tx.head_and_tail("t", 3, 2, "~"), t="abcdefgh") == "abc~gh"
    assert one(spark, tx.is_degenerate("t", 5), t="and so on and so on and so on and so on and so on ") is True


def test_similarity(spark):
    assert one(spark, tx.trigram_similarity("a", "b"), a="word", b="word") == 1.0
    assert one(spark, tx.trigram_similarity("a", "b"), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, tx.fuzzy_match("a", "b"), a="the court  held", b="and The Court held so") is True
    assert one(spark, tx.fuzzy_match("a", "b"), a="", b="x") is False


def test_filters(spark):
    df = spark.createDataFrame([(1, "50%_x", [1, 2]), (2, "50 x", []), (3, None, None)], "id int, t string, a array<int>")
    assert [r.id for r in df.where(fl.contains_ci("t", "0%_X")).collect()] == [1]
    assert [r.id for r in df.where(fl.metadata_predicate({"a": {"$in": [2]}}, {"a": "a"})).collect()] == [1]
    assert [r.id for r in df.where(fl.has_all("a", [1, 2])).collect()] == [1]
    with pytest.raises(KeyError):
        fl.metadata_predicate({"b": 1}, {"a": "a"})
    assert fl.SearchFilters(year_from=0, judge="").merged(fl.SearchFilters(year_from=5, judge="x")) == fl.SearchFilters(year_from=0, judge="x")
    assert one(spark, fl.exact_mention("t", "1"), t="see 10") is False and one(spark, fl.exact_mention("t", "1"), t="see 1.") is True


def test_query_line(spark):
    assert se.parse_query('bail OR parole -tax "due process"') == {"must": [["bail", "parole"]], "not": ["tax"], "phrases": ["due process"]}
    df = spark.createDataFrame([(1, "Due  process and bail"), (2, "due bail process"), (3, "due process, parole, tax")], "id int, t string")
    assert [r.id for r in df.where(se.matches("t", 'bail OR parole -tax "due process"')).collect()] == [1]
    assert [(r.id, r.score) for r in se.cover_density(df, "id", "t", ["due", "process"]).orderBy("id").collect()] == [(1, 0.5), (2, pytest.approx(1 / 3)), (3, 0.5)]


def test_vectors_null_and_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in se.nearest(df, [1.0, 0.0]).collect()] == [(1, 1.0), (4, 0.707107)]
    assert se.batch_nearest(df, df.where("vec_id = 99")).count() == 0


def test_upsert_duplicates_and_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, None), (3, "c", 3)], "k int, x string, y int")
    assert {tuple(r) for r in src.upsert(old, new, ["k"], overwrite=["y"]).collect()} == {(1, "a", 1), (2, "b", None), (3, "c", 3)}
    assert {r.status for r in src.reconcile(old, old, "k").collect()} == {"same"}


def test_file_matching(spark):
    files = spark.createDataFrame([("a",), ("b_EN",), ("c",), ("zz",)], "stem string")
    meta = spark.createDataFrame([("a", 1), ("b", 2), ("xcx", 3)], "key string, v int")
    assert {r.stem: (r.v, r.tier) for r in src.match_files(files, meta).collect()} == {"a": (1, 1), "b_EN": (2, 2), "c": (3, 3), "zz": (None, 0)}


def test_file_matching_of_alike_names(spark):
    """Names that all begin alike, repeated keys, nulls; no side is sent through the driver."""
    files = spark.createDataFrame([(f"copy of Customer#{n:09d} scanned",) for n in range(200)] + [("Customer#000000007_EN",), (None,), ("stomer#00000000",), ("7_EN",)], "stem string")
    meta = spark.createDataFrame([(f"Customer#{n:09d}", n) for n in range(200)] + [("Customer#000000007", -7), (None, -1)], "key string, v int")
    found = src.match_files(files, meta)
    rows = {(r.stem, r.v, r.tier) for r in found.collect()}
    assert {r for r in rows if r[0] and r[0].startswith("copy")} == {(f"copy of Customer#{n:09d} scanned", n, 3) for n in range(200)} | {("copy of Customer#000000007 scanned", -7, 3)}
    assert {r for r in rows if not r[0] or not r[0].startswith("copy")} == {("Customer#000000007_EN", 7, 2), ("Customer#000000007_EN", -7, 2), (None, None, 0), ("stomer#00000000", 0, 3), ("7_EN", None, 0)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_class_links_compare_only_what_can_meet_twice(spark):
    from quern.operators.dashboard import class_links

    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1), (2, "b", 1), (3, "b", 1), (3, "b", 1), (4, "b", 1), (5, "c", 1), (None, "a", 1), (6, None, 1)], "k long, x string, y int")
    found = class_links(rows, "k", ["x", "y"])
    one = {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert sorted(tuple(r) for r in found.collect()) == sorted(one | {(b, a) for a, b in one})
    alone = class_links(rows.where("x = 'a'"), "k", ["x", "y"])
    assert alone.count() == 6 and "HashAggregate" not in alone._jdf.queryExecution().executedPlan().toString()


def test_batch_nearest_in_slices(spark, monkeypatch):
    import numpy as np

    from quern.operators import search as se

    rng = np.random.default_rng(5)
    rows = rng.integers(-2, 3, (150, 4)).astype(float)
    rows[7] = rows[8] = rows[9] = rows[3]
    vectors = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(se, "QUERY_SLICE", 7)
    monkeypatch.setattr(se, "ROW_SLICE", 11)
    found = {}
    for r in se.batch_nearest(vectors, vectors.where("vec_id % 3 = 0"), 5).collect():
        found[r.query, r.rank] = (r.vec_id, r.score)
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    for q in range(0, 150, 3):
        scores = np.round(unit @ unit[q], 6)
        best = np.lexsort((np.arange(150), -scores))[:5]
        assert [found[q, n + 1] for n in range(5)] == [(int(x), scores[x]) for x in best]


def test_outcomes_of_long_sentences(spark):
    """The time of a sentence grows with its length, not with its square."""
    import time

    from quern.functions.validation import outcome

    rows = spark.range(2000).select(F.concat(F.lit("One. "), F.repeat(F.lit("word and "), 300), F.col("id").cast("string"), F.lit("\nthe appeal  is partly allowed. More.")).alias("t"))
    none = F.lit(None).cast("string")
    began = time.monotonic()
    assert rows.select(outcome(none, none, none, F.col("t")).alias("o")).where("startswith(o, 'word and word')").count() == 2000
    plain = rows.select(outcome(none, none, none, F.repeat(F.lit("petition of "), 250)).alias("o"))
    assert plain.where("o IS NOT NULL").count() == 0 and time.monotonic() - began < 12
    ends = spark.createDataFrame([("a. The suit is dismissed",), (". case is remanded..",), ("",), (None,)], "t string").select(outcome(none, none, none, F.col("t")).alias("o"))
    assert [r.o for r in ends.collect()] == ["The suit is dismissed", "case is remanded.", None, None]


def test_acts_are_repaired_once(spark):
    from quern.functions import records as rc

    assert str(rc.normalize_acts("acts", {})._jc).count("levenshtein") == 2 * len(rc.act_words())


def test_citations_try_each_pattern_once(spark):
    from quern.functions import text as tx

    assert str(tx.extract_citations("text")._jc).count("LiveLaw") == 2  # to find all, and to tell which


def test_scores(spark):
    assert one(spark, sc.recency(F.col("y"), 2025), y=2015) == 0.5
    acts = lambda year: one(spark, sc.cross_references(F.col("a"), F.lit(year).cast("int")), a=["BNS", "IPC"])
    assert acts(2020) == ["IPC"] and acts(None) == ["BNS", "IPC"]
    assert one(spark, sc.clean_value("t"), t=" NaN ") is None
    assert str(one(spark, sc.deadline(F.lit("2020-01-01").cast("date"), F.col("n"), F.lit(0), F.lit(0)), n=3)) == "2022-12-31"
    assert one(spark, pr.is_win(F.col("s"), F.lit(None).cast("string")), s="petitioner") is False


def test_prediction_needs_three_cases(spark):
    rows = [(1, [7], "t", "allowed", "2020-01-01", ["A"]), (2, [7], "t", "dismissed", "2010-01-01", ["A"])]
    df = spark.createDataFrame(rows, "case_id int, judge array<int>, case_type string, disposal string, decision_date string, acts array<string>").withColumn("decision_date", F.col("decision_date").cast("date"))
    assert pr.predict_outcome(df, [7], "t", "2021-01-01").count() == 0
    found = pr.predict_outcome(df.unionByName(df.withColumn("case_id", F.lit(3))), [7], "t", "2021-01-01").orderBy("outcome").collect()
    assert [(r.outcome, r.probability) for r in found] == [("allowed", 0.6667), ("dismissed", 0.3333)]
    assert found[0].confidence == 0.4


def test_streaming_ingest_resumes(spark, tmp_path):
    from quern.streaming.ingest import drop_redelivered, ingest, read_files

    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "id int, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = drop_redelivered(read_files(spark, str(tmp_path / "in"), "id int, text string, ts timestamp"), "text", "ts")
        ingest(stream, str(tmp_path / "table"), str(tmp_path / "state"), "id").awaitTermination()
        assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_records(spark):
    from quern.functions import records as rc

    assert one(spark, rc.join_pages("p"), p=["one hyphen-", "ated word", "and more.", "New page"]) == "one hyphenated word and more.\n\nNew page"
    assert one(spark, rc.inline_footnotes("t"), t="See[1] and [2] there.\n[1] first note\n[2] second\n") == "See[1] (first note) and [2] (second) there.\n"
    assert one(spark, rc.opinion_authors("t"), t="intro\nD.Y. CHANDRA, J.\ntext\n[Per S. BHAT, J.]\nmore") == ["D.Y. CHANDRA", "S. BHAT"]
    assert one(spark, rc.issue_tags("t", {"bails": "bail"}), t=["Bails", "bail ", "Tax"]) == ["bail", "tax"]
    assert one(spark, rc.is_sensitive("t", F.array(F.lit("POCSO Act"))), t="x") is True
    assert one(spark, rc.passage("t", F.lit("needle in")), t="a. needle in hay") == "a. needle in hay"
    assert one(spark, rc.court_level("t"), t="Sessions Court, Pune") == "district"
    assert one(spark, rc.case_type("t", {"wp": "Writ Petition"}), t="civil appeal") == "Civil Appeal"
    assert one(spark, rc.repair_act("t"), t="Cootract Act, 1o50") == "Contract Act, 1050"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_sequence_similarity_of_whole_texts(spark, tmp_path):
    from quern.plans.record_queries import sequence_similarity

    same = "the court held that the appeal must fail " * 6
    texts = [same + "costs were awarded", same + "no order was made", "  A\tB ", "a b", "", None, "x" * 900 + " one", "x" * 900 + " two"]
    spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plain = lambda t: " ".join(t.lower().split())
    expected = {n: round(1 - edit_distance(plain(a), plain(b)) / max(len(plain(a)), len(plain(b))), 4) if a and b else 0.0 for n, (a, b) in enumerate(zip(texts, texts[1:], strict=False))}
    assert {r.turn: r.similarity for r in sequence_similarity(spark, str(tmp_path)).collect()} == expected
    assert expected[0] < 1 and expected[2] == 1


def test_louvain_finds_planted_communities(spark):
    rng = random.Random(1)
    edges = [(a, b) for g in range(4) for a in range(10 * g, 10 * g + 10) for b in range(a + 1, 10 * g + 10) if rng.random() < 0.8]
    edges += [(9, 10), (19, 20), (29, 30), (39, 0)]
    nodes = spark.createDataFrame([(n,) for n in [*range(40), 99]], "id long")
    found = {r.id: r.community for r in gr.louvain(spark.createDataFrame(edges, "src long, dst long"), nodes).collect()}
    assert found == {**{n: n // 10 * 10 for n in range(40)}, 99: 99}


def test_ranks_within_communities(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "c")], "id long, community string")
    found = {r.id: r.rank for r in gr.page_rank_within(edges, members).collect()}
    alone = {r.id: r.rank for r in gr.page_rank(edges.where("src IN (3, 4)").where("dst <> 1"), members.where("community = 'b'").select("id")).collect()}
    assert found[1] == pytest.approx(0.5) and found[2] == pytest.approx(0.5) and found[6] == pytest.approx(1.0)
    assert [found[n] for n in (3, 4, 5)] == pytest.approx([alone[n] for n in (3, 4, 5)], abs=1e-5)


def test_a_null_vector_verifies_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.1]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, [1.0, 0.0], [0.7, 0.8])], "id int, a array<double>, b array<double>")
    assert {r.id: r.verdict for r in se.verify_holding(df, "a", "b").collect()} == {1: "accurate", 2: "misrepresented", 3: "misrepresented", 4: "partially_accurate"}


def test_stems_of_inflected_words(spark):
    words = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "this": "this", "agreed": "agree", "feed": "feed", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "hoping": "hope", "conflated": "conflate", "reserved": "reserv", "reserving": "reserv", "rights": "right", "cry": "cri", "by": "by", "say": "say"}
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in rows.select("w", se.stem(F.col("w")).alias("s")).collect()} == words
    assert one(spark, se.lexemes("t"), t="The rights OF reserving") == ["right", "reserv"] and one(spark, se.lexemes("t", False), t="Les droits OF") == ["les", "droits", "of"]


def test_as_of_over_buckets(spark):
    rng = random.Random(5)
    left = [(rng.randrange(3), rng.randrange(1000), n) for n in range(200)]
    right = [(rng.randrange(3), t, t) for t in rng.sample(range(1000), 60)]
    found = jo.as_of(spark.createDataFrame(left, "k int, t long, n int"), spark.createDataFrame(right, "k int, t long, v long"), "k", "t", "v", bucket=50)
    assert {r.n: r.v for r in found.collect()} == {n: max((v for kk, tt, v in right if kk == k and tt <= t), default=None) for k, t, n in left}


def test_odd_fields(spark):
    from quern.functions import validation as va

    assert one(spark, va.short_list("t", 2), t=[" a", "A", None, "", "b", "c"]) == ["a", "b"] and one(spark, va.short_list("t", 2), t=[""]) is None
    assert one(spark, va.headnote_text("t"), t='[{"text": "one"}, {"text": "two"}]') == "one" and one(spark, va.headnote_text("t"), t="{broken") == "" and one(spark, va.headnote_text("t"), t="plain") == "plain"
    assert one(spark, va.past_date("t", F.lit("2020-01-01").cast("date")), t="2020-13-01") is None
    assert one(spark, va.primary_code("t"), t="30.06.2024") == "old" and one(spark, va.primary_code("t"), t="1st July") == "new"
    assert one(spark, tx.expand_sections("t"), t="302-304, 5 to 90, 9A & 124-A") == ["302", "303", "304", "5-90", "9A", "124-A"]
    assert one(spark, tx.normalize_counsel("t"), t="Mr. Dr. A. B. Kumar, Sr. Advocate") == "A. B. Kumar" and one(spark, tx.normalize_counsel("t"), t="Adv.") == ""
    assert one(spark, tx.normalize_citation("t"), t="[2001]  3 SCC  5.") == "(2001) 3 SCC 5" and one(spark, tx.normalize_citation("t"), t="A.I.R. 1990 SC 1") == "AIR 1990 SC 1"
    assert one(spark, tx.title_key("t"), t="A_b v.C & D") == "ab v c d"


def test_components_of_a_long_shuffled_path(spark):
    ids = list(range(300))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (400, 401), (400, 999)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(300), 400, 401, 500]], "id long")
    assert {r.id: r.component for r in gr.components(edges, nodes).collect()} == {**dict.fromkeys(ids, 0), 400: 400, 401: 400, 500: 500}
    with pytest.raises(RuntimeError):
        gr.components(edges, nodes, max_rounds=1)


def test_tasks_of_cases_grow_with_the_lines(spark, sf, monkeypatch):
    """However many lines there are, a task that makes arrays and pairs of cases gets about TASK_LINES of them."""
    from quern.plans import cases

    total = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(cases, "TASK_LINES", total // 40)
    for made in (cases.benches, cases.counsel_of_cases, cases.case_arrays):
        rows = made(spark, sf)
        assert rows.rdd.getNumPartitions() >= 40 and rows.count() == rows.select("case_id").distinct().count()


def test_louvain_by_every_join(spark, monkeypatch):
    rng = random.Random(8)
    edges = spark.createDataFrame([(rng.randrange(120), rng.randrange(120)) for _ in range(500)] + [(200, n) for n in range(60)], "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in [*range(120), 200, 300]], "id long")
    found = set(map(tuple, gr.louvain(edges, nodes).collect()))
    monkeypatch.setattr(gr, "FEW_NODES", 0)
    assert set(map(tuple, gr.louvain(edges, nodes, levels=4).collect())) == found
    monkeypatch.setattr(gr, "HASHED_NODES", 0)
    monkeypatch.setattr(gr, "TASK_LINKS", 0)
    assert set(map(tuple, gr.louvain(edges, nodes).collect())) == found


def test_a_half_sweep_looks_at_its_own_links_once(spark):
    links = spark.createDataFrame([(a, b, 1.0, 2.0) for a in range(3) for b in range(3) if a != b], "src long, dst long, w double, k double")
    labels = spark.createDataFrame([(n, n, 2.0) for n in range(3)], "id long, label long, k double")
    moved = gr._moves(links, labels, 6.0, 1.0, 0, 3, 2)
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [src") == 1 and "xxhash64(src" in plan  # links are read once, those of the turn alone
    halves = {r.id for r in moved.collect() if r.label != r.id}, {r.id for r in gr._moves(links, labels, 6.0, 1.0, 1, 3, 2).collect() if r.label != r.id}
    assert not halves[0] & halves[1]
