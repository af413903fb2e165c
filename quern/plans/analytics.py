"""Relational analytics over the table of cases, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import profiles as op
from quern.plans.cases import ACTS_SQL, AUTHORS_SQL, BASE_SQL, COUNSEL_SQL, JUDGES_SQL, base_cases, benches, cases, counsel_of_cases, order_facts
from quern.plans.registry import query
from quern.sources.tables import page, table

AS_OF = "1998-08-02"


@query(f"""WITH {BASE_SQL} SELECT court, count(*) AS total, min(year) AS first_year, max(year) AS last_year,
  count(*) FILTER (disposal = 'allowed') AS allowed, count(*) FILTER (disposal = 'dismissed') AS dismissed, count(*) FILTER (disposal = 'partly allowed') AS partly_allowed,
  round(100.0 * count(*) FILTER (disposal = 'allowed') / count(*), 2) AS allowed_pct FROM base GROUP BY court""")
def court_stats(spark, sf_dir):
    return op.group_stats(base_cases(spark, sf_dir), "court")


@query(f"""WITH {JUDGES_SQL}, {AUTHORS_SQL}, counted AS (
  SELECT judge AS member, count(*) AS cases, count(*) FILTER (author = judge) AS authored FROM judges LEFT JOIN authors USING (case_id) GROUP BY judge)
SELECT counted.*, (SELECT greatest(1, ceil(count(*) / 20))::BIGINT FROM counted) AS total_pages FROM counted ORDER BY cases DESC, member LIMIT 20 OFFSET 20""")
def list_judges(spark, sf_dir):
    return op.list_members(benches(spark, sf_dir), "judge", "author", page=2)


@query(f"""WITH {BASE_SQL}, {JUDGES_SQL}, {AUTHORS_SQL}, {ACTS_SQL}, own AS (
  SELECT base.*, author FROM base JOIN judges USING (case_id) LEFT JOIN authors USING (case_id) WHERE judge = 3)
SELECT 'cases' AS facet, 'all' AS value, count(*) AS n FROM own UNION ALL SELECT 'authored', 'all', count(*) FILTER (author = 3) FROM own
UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM own GROUP BY year UNION ALL SELECT 'disposal', disposal, count(*) FROM own GROUP BY disposal
UNION ALL SELECT 'case_type', case_type, count(*) FROM own GROUP BY case_type UNION ALL SELECT 'act', act, count(*) FROM own JOIN acts USING (case_id) GROUP BY act
UNION ALL SELECT 'colleague', j.judge::VARCHAR, count(*) FROM own JOIN judges j USING (case_id) WHERE j.judge <> 3 GROUP BY j.judge""")
def judge_profile(spark, sf_dir):
    return op.member_profile(cases(spark, sf_dir), 3)


@query(f"""WITH {BASE_SQL}, {JUDGES_SQL}, {AUTHORS_SQL}
SELECT judge AS member, count(*) AS cases, count(*) FILTER (author = judge) AS authored, round(100.0 * count(*) FILTER (disposal = 'allowed') / count(*), 2) AS allowed_pct
FROM base JOIN judges USING (case_id) LEFT JOIN authors USING (case_id) WHERE judge IN (2, 3, 7) GROUP BY judge""")
def judge_compare(spark, sf_dir):
    return op.compare_members(benches(spark, sf_dir).join(order_facts(spark, sf_dir), "case_id"), [2, 3, 7])


@query(f"""WITH {BASE_SQL} , c AS (SELECT court, lower(trim(disposal)) AS value, count(*) AS n FROM base GROUP BY ALL)
SELECT * FROM (SELECT court, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY court), 2) AS pct FROM c) WHERE value IS NOT NULL""")
def disposal_rates(spark, sf_dir):
    return op.rates(base_cases(spark, sf_dir), "disposal", ["court"])


@query(f"""WITH {BASE_SQL}, own AS (SELECT * FROM base JOIN (SELECT l_orderkey AS case_id, min(l_suppkey) AS author FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) USING (case_id) WHERE author = 3)
SELECT lower(trim(case_type)) AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM own), 2) AS pct FROM own GROUP BY 1""")
def sentencing_stats(spark, sf_dir):
    return op.rates(cases(spark, sf_dir).where("author = 3"), "case_type")


@query(f"""WITH {BASE_SQL} SELECT court, coalesce(year(decision_date)::INT, year) AS year, count(*) AS total, count(*) FILTER (disposal = 'allowed') AS allowed, count(*) FILTER (disposal = 'dismissed') AS dismissed,
  round(100.0 * count(*) FILTER (disposal = 'allowed') / count(*), 2) AS allowed_pct FROM base GROUP BY ALL""")
def temporal_trends(spark, sf_dir):
    return op.trends(base_cases(spark, sf_dir), ["court"])


@query(f"WITH {JUDGES_SQL} SELECT x.judge AS a, y.judge AS b, count(*) AS n FROM judges x JOIN judges y ON x.case_id = y.case_id AND x.judge < y.judge GROUP BY ALL")
def bench_cooccurrence(spark, sf_dir):
    return op.cooccurrence(benches(spark, sf_dir))


WON = "CASE {s} WHEN 'petitioner' THEN disposal IN ('allowed', 'partly allowed') ELSE disposal = 'dismissed' END"


@query(f"""WITH {BASE_SQL}, {COUNSEL_SQL}, met AS (
  SELECT x.name, y.name AS opponent, disposal, {WON.format(s='x.side')} AS won FROM counsel x JOIN counsel y ON x.case_id = y.case_id AND x.side <> y.side AND x.name <> y.name JOIN base ON base.case_id = x.case_id)
SELECT name, opponent, count(*) AS total, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won AND disposal IS NOT NULL) AS losses, round(100.0 * count(*) FILTER (won) / count(*), 2) AS win_rate FROM met GROUP BY ALL""")
def head_to_head(spark, sf_dir):
    return op.head_to_head(counsel_of_cases(spark, sf_dir))


@query(f"""WITH {COUNSEL_SQL}, {BASE_SQL}, own AS (SELECT counsel.* FROM counsel JOIN base USING (case_id)), sides AS (SELECT name, side, count(*) AS n FROM own GROUP BY ALL)
SELECT name, count(DISTINCT case_id) AS cases, (SELECT side FROM sides s WHERE s.name = own.name ORDER BY n DESC, side LIMIT 1) AS usual_side FROM own GROUP BY name""")
def counsel_search_mode(spark, sf_dir):
    return op.counsel_list(counsel_of_cases(spark, sf_dir))


@query(f"""WITH {BASE_SQL}, {COUNSEL_SQL}
SELECT name, count(*) FILTER (side = 'petitioner') AS as_petitioner, count(*) FILTER (side = 'respondent') AS as_respondent,
  round(100.0 * count(*) FILTER ({WON.format(s='side')}) / count(disposal), 2) AS win_rate, min(year) AS first_year, max(year) AS last_year
FROM base JOIN counsel USING (case_id) GROUP BY name""")
def counsel_profile(spark, sf_dir):
    return op.counsel_profile(counsel_of_cases(spark, sf_dir))


@query(f"""WITH {BASE_SQL}, {JUDGES_SQL}, {ACTS_SQL}, own AS (SELECT base.* FROM base JOIN judges USING (case_id) WHERE judge = 3 AND disposal IS NOT NULL),
p0 AS (SELECT disposal, sum(CASE WHEN decision_date >= DATE '{AS_OF}' - 1095 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w, count(*) AS n FROM own WHERE case_type = '1-URGENT' GROUP BY 1),
p1 AS (SELECT disposal, round(w / sum(w) OVER (), 4) AS p, sum(n) OVER () AS size FROM p0),
s AS (SELECT disposal, count(*) AS c, sum(count(*)) OVER () AS t FROM own JOIN acts USING (case_id) WHERE act = 'Brand#11' GROUP BY 1),
p2 AS (SELECT disposal, p, c, max(t) OVER () AS t, max(size) OVER () AS size, CASE WHEN max(t) OVER () >= 5 THEN least(max(t) OVER () / 30.0, 0.4) ELSE 0 END::DOUBLE AS b FROM p1 FULL JOIN s USING (disposal)),
p3 AS (SELECT disposal, CASE WHEN b > 0 THEN round(coalesce(p, 0) * (1 - b) + coalesce(c / t, 0) * b, 4) ELSE p END AS p, size FROM p2 WHERE p IS NOT NULL OR b > 0),
q AS (SELECT *, round(0.6 * max(p) OVER () + 0.4 * least(size / 50, 1.0), 4) AS sure FROM p3)
SELECT disposal AS outcome, p AS probability, size::BIGINT AS sample_size, CASE WHEN size < 10 THEN least(sure, 0.4) ELSE sure END::DOUBLE AS confidence FROM q WHERE size >= 3""")
def outcome_prediction(spark, sf_dir):
    return op.predict_outcome(cases(spark, sf_dir), [3], "1-URGENT", AS_OF, ["Brand#11"])


FACETS = ["court", "year", "case_type", "disposal"]


@query(f"WITH {BASE_SQL}, own AS (SELECT * FROM base WHERE value > 300000) " + " UNION ALL ".join(f"SELECT '{c}' AS facet, own.{c}::VARCHAR AS value, count(*) AS n FROM own WHERE own.{c} IS NOT NULL GROUP BY own.{c}" for c in FACETS))
def facets_resultset(spark, sf_dir):
    return op.value_counts(base_cases(spark, sf_dir).where("value > 300000"), FACETS)


@query(f"WITH {BASE_SQL} " + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS facet, {c}::VARCHAR AS value FROM base WHERE {c} IS NOT NULL" for c in ("court", "case_type", "disposal")) + " UNION ALL SELECT 'min_year', min(year)::VARCHAR FROM base UNION ALL SELECT 'max_year', max(year)::VARCHAR FROM base")
def facets_global(spark, sf_dir):
    return op.global_facets(base_cases(spark, sf_dir), ["court", "case_type", "disposal"])


FIELDS = ["disposal", "judge", "author", "acts", "counsel"]
FILLED_SQL = f"""{BASE_SQL}, {JUDGES_SQL}, {AUTHORS_SQL}, {ACTS_SQL}, {COUNSEL_SQL}, marks AS (SELECT disposal IS NOT NULL AS disposal, case_id IN (SELECT case_id FROM judges) AS judge, case_id IN (SELECT case_id FROM authors) AS author,
  case_id IN (SELECT case_id FROM acts) AS acts, case_id IN (SELECT case_id FROM counsel) AS counsel FROM base)"""


@query(f"WITH {FILLED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c}) AS filled, round(count(*) FILTER ({c}) / greatest(count(*), 1), 4) AS rate FROM marks" for c in FIELDS))
def field_population(spark, sf_dir):
    return op.field_population(cases(spark, sf_dir), FIELDS)


@query(f"WITH {FILLED_SQL} SELECT round(avg({' + '.join(f'{c}::INT' for c in FIELDS)}), 2) AS avg_filled FROM marks")
def completeness(spark, sf_dir):
    return op.average_filled(cases(spark, sf_dir), FIELDS)


@query("SELECT CASE WHEN value IS NULL THEN 'null' WHEN value < 20 THEN '<20' WHEN value < 50 THEN '<50' WHEN value < 80 THEN '<80' ELSE '>=80' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def confidence_buckets(spark, sf_dir):
    return op.buckets(table(spark, sf_dir, "events"), "value", (20, 50, 80))


@query(f"WITH {BASE_SQL} SELECT year, count(*) AS cases FROM base GROUP BY year ORDER BY year DESC LIMIT 50")
def year_coverage(spark, sf_dir):
    return op.newest_years(base_cases(spark, sf_dir))


@query(f"""WITH {BASE_SQL}, ranked AS (SELECT case_id, disposal, row_number() OVER (ORDER BY value DESC, case_id) AS rank FROM base), top AS (SELECT * FROM ranked WHERE rank <= 10)
SELECT count(disposal) >= 2 AND count(DISTINCT disposal) = 1 AS warning FROM top""")
def outcome_bias(spark, sf_dir):
    ranked = base_cases(spark, sf_dir).orderBy(F.desc("value"), "case_id").limit(10).select("disposal", F.struct(-F.col("value"), "case_id").alias("rank"))
    return op.outcome_bias(ranked, "bail granted in such a sentence")


@query(f"""WITH {BASE_SQL}, {ACTS_SQL}, has AS (SELECT DISTINCT case_id FROM acts), a AS (SELECT year, count(*) AS n, round(avg((disposal IS NOT NULL)::INT), 2) AS outcome_rate, round(avg((has.case_id IS NOT NULL)::INT), 2) AS acts_rate,
  round(avg(value / 600000), 4) AS score_avg, round(min(value / 600000), 4) AS score_min, round(max(value / 600000), 4) AS score_max, max(length(court))::INT AS longest FROM base LEFT JOIN has USING (case_id) GROUP BY year)
SELECT *, round(0.5 * outcome_rate + 0.3 * acts_rate + 0.2 * least(score_avg / 0.9, 1.0), 2) AS health,
  array_to_string([x FOR x IN [CASE WHEN outcome_rate < 0.85 THEN 'outcomes' END, CASE WHEN acts_rate < 0.85 THEN 'acts' END, CASE WHEN score_min < 0.3 THEN 'scores' END] IF x IS NOT NULL], ',') AS anomalies FROM a""")
def year_audit(spark, sf_dir):
    return op.year_audit(cases(spark, sf_dir), F.col("value") / 600000, F.col("court"))


@query(f"""WITH {BASE_SQL} SELECT case_id, court, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY court ORDER BY value DESC, case_id)::INT AS rank FROM base) WHERE rank <= 4""")
def topn_per_group(spark, sf_dir):
    return op.top_per_group(base_cases(spark, sf_dir), ["court"], [F.desc("value"), F.col("case_id")], 4).select("case_id", "court", "value", "rank")


@query(f"WITH {BASE_SQL} SELECT court, arg_max(case_id, (value, -case_id)) AS case_id, max(value) AS value FROM base GROUP BY court")
def best_per_group(spark, sf_dir):
    best = base_cases(spark, sf_dir).groupBy("court").agg(F.max_by(F.struct("case_id", "value"), F.struct("value", -F.col("case_id"))).alias("b"))
    return best.select("court", "b.case_id", "b.value")


@query(f"WITH {BASE_SQL} SELECT case_id, court, round(100 * value / max(value) OVER (PARTITION BY court), 2) AS score FROM base")
def max_normalise(spark, sf_dir):
    rows = base_cases(spark, sf_dir)
    # A window would put a whole court into one task; the maximum is one row a court.
    top = rows.groupBy("court").agg(F.max("value").alias("top"))
    return rows.join(top, "court").select("case_id", "court", F.round(100 * F.col("value") / F.col("top"), 2).alias("score"))


@query(f"WITH {BASE_SQL} SELECT DISTINCT ON (party) party, case_id, decision_date FROM base ORDER BY party, decision_date DESC, case_id")
def distinct_on(spark, sf_dir):
    newest = base_cases(spark, sf_dir).groupBy("party").agg(F.max_by(F.struct("case_id", "decision_date"), F.struct("decision_date", -F.col("case_id"))).alias("c"))
    return newest.select("party", "c.case_id", "c.decision_date")


@query(f"WITH {BASE_SQL} SELECT case_id, CASE WHEN case_id % 3 <> 0 THEN decision_date END AS d FROM base ORDER BY d DESC NULLS LAST, case_id LIMIT 20 OFFSET 40")
def paged_nulls_last(spark, sf_dir):
    rows = base_cases(spark, sf_dir).select("case_id", F.when(F.col("case_id") % 3 != 0, F.col("decision_date")).alias("d"))
    return page(rows, [F.desc_nulls_last("d"), F.col("case_id")], page=3)


@query(f"""WITH {BASE_SQL}, {JUDGES_SQL} SELECT case_id, len(list(judge)) AS n FROM base JOIN judges USING (case_id) GROUP BY case_id ORDER BY n DESC, case_id LIMIT 10""")
def top_by_array_length(spark, sf_dir):
    return benches(spark, sf_dir).select("case_id", F.size("judge").cast("long").alias("n")).orderBy(F.desc_nulls_last("n"), "case_id").limit(10)


@query("""WITH flat AS (SELECT user_id, json_extract_string(props, '$.k') AS k, max(ts) AS newest, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY ALL)
SELECT user_id, k, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, newest DESC, k)::INT AS rank FROM flat) WHERE rank <= 5""")
def preference_topn(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.join(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 30 DAYS"))
    counted = recent.groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.max("ts").alias("newest"), F.count("*").alias("n"))
    return op.top_per_group(counted, ["user_id"], [F.desc("n"), F.desc("newest"), F.col("k")], 5).select("user_id", "k", "n", "rank")
