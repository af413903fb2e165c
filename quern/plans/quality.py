"""Gates, audits, merging, scoring, chunking and rate limits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scores as sc
from quern.operators import quality as qa
from quern.operators.sections import chunk_documents
from quern.plans.cases import ACTS_SQL, BASE_SQL, base_cases, case_arrays
from quern.plans.registry import query
from quern.sources.tables import table
from quern.streaming.ingest import reset_orphans
from quern.streaming.limits import circuit_breaker, rate_limit, sessions

GATE = ["court", "disposal", "late"]


@query(f"""WITH {BASE_SQL}, r AS (SELECT *, CASE WHEN case_id % 8 <> 0 THEN court END AS late FROM base), a AS (SELECT count(*) AS total, {', '.join(f"count({c}) AS has_{c}" for c in GATE)}, count(DISTINCT court) AS u_court, count(DISTINCT case_id) AS u_case_id, count(*) FILTER (year < 1993) AS odd FROM r)
SELECT 'rows' AS "check", total::DOUBLE AS value, 'pass' AS status FROM a """ + " ".join(f"UNION ALL SELECT 'has_{c}', round(has_{c} / total, 4), CASE WHEN has_{c} / total < 0.85 THEN 'fail' WHEN has_{c} / total < 0.95 THEN 'warn' ELSE 'pass' END FROM a" for c in GATE) + """
UNION ALL SELECT 'unique_court', round(u_court / total, 4), CASE WHEN u_court / total < 0.85 THEN 'fail' ELSE 'pass' END FROM a UNION ALL SELECT 'unique_case_id', round(u_case_id / total, 4), 'pass' FROM a
UNION ALL SELECT 'odd_years', odd::DOUBLE, CASE WHEN odd > 0 THEN 'warn' ELSE 'pass' END FROM a UNION ALL SELECT 'unique_records', 1.0, 'pass' FROM a""")
def batch_gate(spark, sf_dir):
    rows = base_cases(spark, sf_dir).withColumn("late", F.when(F.col("case_id") % 8 != 0, F.col("court")))
    return qa.batch_gate(rows, GATE, {"court": 0.85, "case_id": 0.8}, "year", (1993, 2027))


@query("""WITH a AS (SELECT count(*) AS t, count(*) FILTER (length(text) > 1500) / count(*) AS wordy, count(*) FILTER (lang IS NULL) / count(*) AS no_lang, count(*) FILTER (lower(text) LIKE '%all rights reserved%') / count(*) AS editorial FROM documents)
SELECT 'wordy' AS "check", round(wordy, 4) AS value, CASE WHEN wordy > 0.1 THEN 'warn' ELSE 'pass' END AS status FROM a UNION ALL SELECT 'no_lang', round(no_lang, 4), CASE WHEN no_lang > 0.15 THEN 'fail' WHEN no_lang > 0.08 THEN 'warn' ELSE 'pass' END FROM a
UNION ALL SELECT 'editorial', round(editorial, 4), CASE WHEN editorial > 0.2 THEN 'warn' ELSE 'pass' END FROM a""")
def content_gate(spark, sf_dir):
    text = F.col("text")
    rates = {"wordy": (F.length(text) > 1500, None, 0.1), "no_lang": (F.col("lang").isNull(), 0.15, 0.08), "editorial": (F.lower(text).contains("all rights reserved"), None, 0.2)}
    return qa.content_gate(table(spark, sf_dir, "documents"), rates)


@query(r"""WITH f AS (SELECT doc_id, regexp_matches(text, '^[a-z]') AS lower_start, n_chars > 5000 AS bloated, contains(lower(text), 'rights reserved') AS editorial, n_chars < 200 AS short FROM documents)
SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN lower_start THEN 'lower_start' END, CASE WHEN bloated THEN 'bloated' END, CASE WHEN editorial THEN 'editorial' END, CASE WHEN short THEN 'short' END] IF x IS NOT NULL], ',') AS issues,
  CASE WHEN lower_start THEN 'CRITICAL' WHEN bloated THEN 'HIGH' WHEN editorial OR short THEN 'MEDIUM' ELSE 'CLEAN' END AS severity FROM f""")
def row_audit(spark, sf_dir):
    text, n = F.col("text"), F.col("n_chars")
    return qa.row_audit(table(spark, sf_dir, "documents"), "doc_id", {"lower_start": text.rlike("^[a-z]")}, {"bloated": n > 5000}, {"editorial": F.lower(text).contains("rights reserved"), "short": n < 200})


@query("""WITH m AS (SELECT n_chars > 400 AS p, quality = 1 AS g FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM m)
SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 4) AS f1 FROM c""")
def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return qa.precision_recall(rows, F.col("n_chars") > 400, F.col("quality") == 1)


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) - 1 AS others FROM documents WHERE length(text) >= 30 QUALIFY others > 0")
def cross_contamination(spark, sf_dir):
    return qa.shared_values(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH ids AS (SELECT DISTINCT doc_id FROM documents), a AS (SELECT count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labels, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS vectors FROM ids)
SELECT 'labels' AS store, labels AS found, round(labels / total, 4) AS share, CASE WHEN labels / total < 0.9 THEN 'fail' ELSE 'pass' END AS status FROM a UNION ALL SELECT 'vectors', vectors, round(vectors / total, 4), CASE WHEN vectors / total < 0.9 THEN 'fail' ELSE 'pass' END FROM a""")
def store_check(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return qa.store_check(table(spark, sf_dir, "documents"), "doc_id", {"labels": table(spark, sf_dir, "labels"), "vectors": vectors})


@query(f"""WITH {BASE_SQL}, {ACTS_SQL}, g AS (SELECT count(DISTINCT p_brand) AS n FROM part WHERE p_brand LIKE 'Brand#1%')
SELECT case_id, count(*) FILTER (act LIKE 'Brand#1%')::INT AS tp, count(*) FILTER (act NOT LIKE 'Brand#1%')::INT AS fp, (max(n) - count(*) FILTER (act LIKE 'Brand#1%'))::INT AS fn FROM acts, g GROUP BY case_id""")
def list_agreement(spark, sf_dir):
    gold = table(spark, sf_dir, "part").where("p_brand LIKE 'Brand#1%'").agg(F.collect_set("p_brand").alias("gold"))
    rows = case_arrays(spark, sf_dir).select("case_id", "acts").join(F.broadcast(gold))  # one row
    return qa.list_agreement(rows, "case_id", "acts", "gold")


@query("SELECT c_custkey, lower(trim(c_mktsegment)) AS c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) IS DISTINCT FROM c_mktsegment")
def backfill_changes(spark, sf_dir):
    return qa.changed_rows(table(spark, sf_dir, "customer"), "c_custkey", {"c_mktsegment": F.lower(F.trim("c_mktsegment"))})


@query(f"""WITH {BASE_SQL} SELECT case_id, round((10 + CASE WHEN disposal IS NOT NULL THEN 3 ELSE 0 END + 10 + 6 + 3) / 100.0, 3)::DOUBLE AS confidence,
  CASE WHEN (29 + CASE WHEN disposal IS NOT NULL THEN 3 ELSE 0 END) / 100.0 < 0.5 THEN 'needs_review' ELSE 'completed' END AS status FROM base""")
def extraction_confidence(spark, sf_dir):
    rows = base_cases(spark, sf_dir).withColumnRenamed("disposal", "disposal_nature")
    return rows.withColumn("confidence", sc.record_confidence(rows)).select("case_id", "confidence", sc.record_status(F.col("confidence")).alias("status"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, 'B-' || c_custkey) AS title, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'A') AS disposal,
  CASE WHEN c_custkey % 3 <> 0 THEN 'a' ELSE 'b' END AS title_from, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a' END AS disposal_from FROM customer""")
def merge_provenance(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        key, F.when(key % 3 != 0, F.col("c_name")).otherwise(" NaN ").alias("a_title"), F.concat(F.lit("B-"), key.cast("string")).alias("b_title"),
        F.lit("A").alias("a_disposal"), F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("none").alias("b_disposal"),
    )
    merged = rows.select("c_custkey", *sc.merge_fields(rows, "a", "b", ["disposal"], ["title", "disposal"]))
    return merged.select("c_custkey", "title", "disposal", F.col("provenance")["title"].alias("title_from"), F.col("provenance")["disposal"].alias("disposal_from"))


@query(f"""WITH {BASE_SQL}, s AS (SELECT *, case_id % 7 AS size, CASE case_id % 3 WHEN 0 THEN 'supreme' WHEN 1 THEN 'high' ELSE 'tribunal' END AS level FROM base),
k AS (SELECT *, CASE WHEN size >= 5 THEN 4 WHEN size >= 3 THEN 3 ELSE size END AS rank FROM s)
SELECT case_id, CASE WHEN size >= 5 THEN 'constitutional' WHEN size = 4 THEN 'full' WHEN size IN (2, 3) THEN 'division' WHEN size = 1 THEN 'single' END AS bench,
  CASE WHEN disposal = 'dismissed' AND case_id % 11 = 0 THEN 'OVERRULED' WHEN level = 'supreme' THEN CASE WHEN rank >= 3 THEN 'BINDING' ELSE 'PERSUASIVE' END ELSE 'PERSUASIVE' END AS strength,
  round(CASE WHEN year IS NULL THEN 1.0 ELSE 1.0 / (1 + greatest(0, 2000 - year) / 10) END, 6) AS recency FROM k""")
def precedent_strength(spark, sf_dir):
    rows = base_cases(spark, sf_dir).withColumn("size", F.col("case_id") % 7)
    level = F.when(F.col("case_id") % 3 == 0, "supreme").when(F.col("case_id") % 3 == 1, "high").otherwise("tribunal")
    rank = sc.bench_rank(F.lit(None).cast("string"), F.col("size"))
    overruled = (F.col("disposal") == "dismissed") & (F.col("case_id") % 11 == 0)
    strength = sc.precedent_strength(level, F.lit("supreme"), F.lit(False), rank, F.lit(3), overruled)
    return rows.select("case_id", sc.bench_of(F.col("size")).alias("bench"), strength.alias("strength"), F.round(sc.recency(F.col("year"), 2000), 6).alias("recency"))


@query("""SELECT user_id, array_to_string(list_sort(CASE WHEN user_id % 2 = 0 THEN ['IEA', 'IPC'] ELSE ['BNS', 'BSA', 'IEA', 'IPC'] END), ',') AS acts FROM (SELECT DISTINCT user_id FROM events)""")
def statute_cross_references(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    year = F.when(F.col("user_id") % 2 == 0, 2020).otherwise(2025)
    return users.select("user_id", F.array_join(sc.cross_references(F.array(F.lit("BNS"), F.lit("IEA")), year), ",").alias("acts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE + (o_orderkey % 4 * 365 + o_orderkey % 4 * 30)::INT END AS deadline, CASE WHEN o_orderkey % 5 = 0 THEN 250.0 WHEN o_orderstatus = 'P' THEN 0.0 ELSE round(o_totalprice::DECIMAL(18, 2) * CASE WHEN o_orderstatus = 'F' THEN 0.05 ELSE 0.075 END, 2)::DOUBLE END AS fee FROM orders""")
def deadline_and_fee(spark, sf_dir):
    n = (F.col("o_orderkey") % 4).cast("int")
    state = F.when(F.col("o_orderstatus") == "F", "delhi").when(F.col("o_orderstatus") == "O", "karnataka").otherwise("elsewhere")
    fee = sc.court_fee(F.col("o_totalprice"), state, F.lit("high_court"), F.when(F.col("o_orderkey") % 5 == 0, "writ"), {"writ": 250}, {("delhi", "high_court"): 0.05}, ["delhi", "karnataka"])
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.deadline(F.to_date("o_orderdate"), n, n, F.lit(0)).alias("deadline"), fee.alias("fee"))


@query("""WITH a AS (SELECT user_id, avg(value)::DOUBLE / 100 AS relevance, count(DISTINCT event_type) AS tiers, count(*) FILTER (event_type = 'purchase') AS bad, count(*) AS total FROM events GROUP BY user_id)
SELECT user_id, round(least(1, greatest(0, 0.25 * least(round(relevance, 6), 1) + 0.10 * 0.5 + 0.15 * 0.7 + 0.10 * (CASE WHEN bad > 0 THEN 1 - bad / total ELSE 1 END) + 0.10 * least(tiers / 4, 1) + 0.10 * 0.5 + 0.20 * 1.0)), 5) AS confidence FROM a""")
def composite_confidence(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("relevance"), F.count_distinct("event_type").alias("tiers"), F.count_if(F.col("event_type") == "purchase").alias("bad"), F.count("*").alias("total"))
    sure = sc.composite_confidence(F.least(F.round("relevance", 6), F.lit(1.0)), F.lit(0.5), F.lit(0.7), F.col("bad"), F.col("total"), F.col("tiers"), F.lit(2), F.lit(1), F.lit(1.0))
    return a.select("user_id", F.round(sure, 5).alias("confidence"))


@query()
def chunks(spark, sf_dir):
    return chunk_documents(table(spark, sf_dir, "documents"))


@query()
def rate_limit_window(spark, sf_dir):
    return rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 6 * 3600)


@query()
def circuit_breaker_events(spark, sf_dir):
    return circuit_breaker(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("value") < 20, 2, 3600.0)


@query("""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM g GROUP BY user_id, s""")
def session_gap(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR THEN 'failed' WHEN event_type = 'click' THEN 'processing' ELSE 'done' END AS status FROM events""")
def orphan_reset(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "processing").otherwise("done").alias("status"), F.col("ts").alias("updated_at"))
    return reset_orphans(jobs, "2024-01-20").select("event_id", "status")
