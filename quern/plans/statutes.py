"""Statutes, precedents and ingest checks over the driver's tables; parts stand for sections of acts (brands)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import precedents as pr
from quern.operators import statutes as st
from quern.plans.registry import query
from quern.plans.retrieval import BOTH_SQL, CITES_SQL, cites
from quern.sources.tables import table

MAPS_SQL = "maps AS (SELECT p_brand AS old_act, p_size::VARCHAR AS old_section, 'New ' || p_brand AS new_act, (p_partkey % 60)::VARCHAR AS new_section FROM part WHERE p_partkey % 3 = 0)"
STATUTES_SQL = "statutes AS (SELECT p_brand AS act, p_type || ' ' || p_brand AS name, p_size::VARCHAR AS section, min(p_name) AS text FROM part GROUP BY ALL)"


def _maps(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    return part.select(F.col("p_brand").alias("old_act"), F.col("p_size").cast("string").alias("old_section"), F.concat(F.lit("New "), "p_brand").alias("new_act"), (F.col("p_partkey") % 60).cast("string").alias("new_section"))


LOOKUP_SQL = f"""{MAPS_SQL}, both_ways AS (SELECT old_act AS act, old_section AS section, 'forward' AS direction, new_act || ' ' || new_section AS target FROM maps UNION SELECT new_act, new_section, 'back', old_act || ' ' || old_section FROM maps),
lookup AS (SELECT act, section, direction, string_agg(target, ', ' ORDER BY target) AS targets FROM both_ways GROUP BY ALL)"""


@query(f"WITH {LOOKUP_SQL} SELECT * FROM lookup")
def amendment_lookup(spark, sf_dir):
    return st.amendment_lookup(_maps(spark, sf_dir)).withColumn("targets", F.array_join("targets", ", "))


@query(f"WITH {LOOKUP_SQL}, s AS (SELECT DISTINCT p_brand AS act, p_size::VARCHAR AS section FROM part) SELECT s.act, s.section, coalesce(f.targets, '') AS replaced_by, coalesce(b.targets, '') AS replaces FROM s LEFT JOIN lookup f ON f.act = s.act AND f.section = s.section AND f.direction = 'forward' LEFT JOIN lookup b ON b.act = s.act AND b.section = s.section AND b.direction = 'back'")
def replacement_fields(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("act"), F.col("p_size").cast("string").alias("section")).distinct()
    return st.replacement_fields(own, _maps(spark, sf_dir))


@query(f"WITH {MAPS_SQL}, r AS (SELECT DISTINCT p_brand AS act, p_size::VARCHAR AS section FROM part WHERE p_size < 20) SELECT * FROM r UNION SELECT new_act, new_section FROM maps JOIN r ON act = old_act AND section = old_section UNION SELECT old_act, old_section FROM maps JOIN r ON act = new_act AND section = new_section")
def reference_expansion(spark, sf_dir):
    refs = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_brand").alias("act"), F.col("p_size").cast("string").alias("section")).distinct()
    return st.expand_references(refs, _maps(spark, sf_dir))


@query("""WITH statutes AS (SELECT p_brand AS act, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS name, p_size::VARCHAR AS section, min(p_name) AS text, p_brand || ' ' || (p_size + 1) AS replaced_by FROM part GROUP BY p_brand, p_size),
refs AS (SELECT lower(p_brand) AS asked, p_size::VARCHAR AS section FROM part WHERE p_partkey % 10 = 0 UNION SELECT lower(split_part(p_type, ' ', 1)), p_size::VARCHAR FROM part WHERE p_partkey % 7 = 0),
found AS (SELECT DISTINCT s.* FROM statutes s JOIN refs r ON r.section = s.section AND (lower(s.act) = asked OR contains(lower(s.name), asked)))
SELECT f.act, f.section, f.text, f.replaced_by, l.text AS replacement FROM found f LEFT JOIN statutes l ON f.replaced_by = l.act || ' ' || l.section""")
def section_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = part.groupBy(F.col("p_brand").alias("act"), F.col("p_size").alias("size")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), " ").alias("name"), F.min("p_name").alias("text"))
    own = own.select("act", "name", F.col("size").cast("string").alias("section"), "text", F.concat_ws(" ", "act", (F.col("size") + 1).cast("string")).alias("replaced_by"))
    codes = part.where("p_partkey % 10 = 0").select(F.upper("p_brand").alias("act"), F.col("p_size").cast("string").alias("section"))
    names = part.where("p_partkey % 7 = 0").select(F.substring_index("p_type", " ", 1).alias("act"), F.col("p_size").cast("string").alias("section"))
    return st.find_sections(own, codes.unionByName(names))


HITS_SQL = "hits AS (SELECT o_orderpriority AS issue, o_custkey AS \"case\", max(o_totalprice) AS score FROM orders GROUP BY ALL)"
CASES_SQL = "known AS (SELECT c_custkey AS \"case\", c_nationkey % 3 AS court_rank, c_acctbal AS ratio FROM customer)"


def _hits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("issue"), F.col("o_custkey").alias("case"), F.col("o_totalprice").alias("score"))


def _cases(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"), (F.col("c_nationkey") % 3).alias("court_rank"), F.col("c_acctbal").alias("ratio"))


@query(f"WITH {HITS_SQL} SELECT issue, \"case\", score, row_number() OVER (PARTITION BY issue ORDER BY score DESC, \"case\")::INT AS rank FROM hits QUALIFY rank <= 5")
def precedents_per_issue(spark, sf_dir):
    return pr.top_per_issue(_hits(spark, sf_dir))


@query(f"""WITH {HITS_SQL}, {CASES_SQL}, best AS (SELECT issue, "case" FROM hits WHERE issue IN ('1-URGENT', '2-HIGH', '3-MEDIUM') QUALIFY row_number() OVER (PARTITION BY issue ORDER BY score DESC, "case") <= 5)
SELECT issue, CASE WHEN n >= 2 THEN least(score + 1, 10) ELSE score END::INT AS score, n AS top_court FROM (SELECT issue, substr(issue, 1, 1)::INT * 4 AS score, count(*) FILTER (court_rank = 1) AS n FROM best JOIN known USING ("case") GROUP BY issue)""")
def issue_scores(spark, sf_dir):
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("issue")).distinct().select("issue", F.col("issue").alias("ord"), (F.substring("issue", 1, 1).cast("int") * 4).alias("score"))
    return pr.issue_scores(_hits(spark, sf_dir), _cases(spark, sf_dir), issues, least_top=2)


@query(f"""WITH RECURSIVE {CITES_SQL}, {BOTH_SQL}, {CASES_SQL}, found AS (SELECT o_custkey AS "case", max(o_totalprice) AS score FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
walk AS (SELECT "case" AS node, 0 AS depth FROM (SELECT "case" FROM found ORDER BY score DESC, "case" LIMIT 5) UNION SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 2),
every AS (SELECT "case", score, 'search' AS source FROM found UNION ALL SELECT DISTINCT node, 0.0, 'graph' FROM walk WHERE node NOT IN (SELECT "case" FROM found)),
bad AS (SELECT DISTINCT dst FROM cites WHERE treatment = 'overruled')
SELECT "case", score, source, dst IS NOT NULL AS overruled, CASE WHEN dst IS NOT NULL THEN 'OVERRULED' WHEN court_rank = 1 THEN 'BINDING' ELSE 'PERSUASIVE' END AS strength, ratio FROM every JOIN known USING ("case") LEFT JOIN bad ON dst = "case\"""")
def precedent_map(spark, sf_dir):
    chunks = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("chunk"), F.col("o_totalprice").alias("score"))
    return pr.precedent_map(chunks, _cases(spark, sf_dir), cites(spark, sf_dir))


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations), k AS (SELECT conv_id, list(text ORDER BY turn) AS l, max(CASE WHEN turn = 0 THEN text END) AS ratio FROM conversations GROUP BY conv_id)
SELECT conv_id || '_' || turn AS id, conv_id AS "case", 'chunk' AS kind, substr(text, 1, 2000) AS text FROM c WHERE length(trim(text)) >= 20
UNION ALL SELECT conv_id || '_prop_' || i, conv_id, 'proposition', substr(t, 1, 2000) FROM (SELECT conv_id, unnest(range(least(len(l), 3))) AS i, unnest(l[1:3]) AS t FROM k) WHERE length(trim(t)) >= 30
UNION ALL SELECT conv_id || '_ratio', conv_id, 'ratio', substr(ratio, 1, 2000) FROM k WHERE length(trim(ratio)) >= 30
UNION ALL SELECT conv_id || '_headnote_' || i, conv_id, 'headnote', substr(t, 1, 2000) FROM (SELECT conv_id, unnest(range(least(len(l), 2))) AS i, unnest(l[1:2]) AS t FROM k) WHERE length(trim(t)) >= 30""")
def vector_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    own = turns.groupBy(F.col("conv_id").alias("case")).agg(listed.alias("propositions"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("ratio")).withColumn("headnotes", F.col("propositions"))
    return pr.vector_rows(own, turns.select(F.col("conv_id").alias("case"), F.col("turn").alias("n"), "text"), props_most=3, notes_most=2)


@query("""WITH v AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id), r AS (SELECT doc_id, source, n_chars % 3 AS chunks, (doc_id % 10) / 10.0 AS confidence FROM documents)
SELECT doc_id AS "case", array_to_string([x FOR x IN [CASE WHEN source IS NULL OR trim(source) = '' THEN 'no_title' END, CASE WHEN chunks <= 0 THEN 'no_chunks' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN coalesce(u, 0) = 0 THEN 'no_user' END, CASE WHEN coalesce(a, 0) = 0 THEN 'no_assistant' END, CASE WHEN coalesce(u, 0) <> chunks THEN 'chunk_count' END] IF x IS NOT NULL], ',') AS faults
FROM r LEFT JOIN v ON conv_id = doc_id""")
def sample_check(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case"), F.col("source").alias("title"), (F.col("n_chars") % 3).alias("chunks"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    vectors = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case"), F.col("role").alias("kind"))
    return pr.sample_check(rows, vectors, ("user", "assistant"))


@query("SELECT 'vectors' AS store, count(*) AS held, CASE WHEN count(*) > 1000 * 0.95 THEN 'fail' WHEN count(*) > 1000 * 0.85 THEN 'warn' ELSE 'pass' END AS status FROM embeddings UNION ALL SELECT 'nodes', count(*), CASE WHEN count(*) > 1700 * 0.9 THEN 'fail' WHEN count(*) > 1700 * 0.75 THEN 'warn' ELSE 'pass' END FROM customer")
def capacity_check(spark, sf_dir):
    return pr.capacity({"vectors": (table(spark, sf_dir, "embeddings"), 1000, 0.85, 0.95), "nodes": (table(spark, sf_dir, "customer"), 1700, 0.75, 0.9)})


@query("""SELECT 'stage' AS counter, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'tier', CASE WHEN value > 50 THEN 'high' ELSE 'low' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'late', 'all', count(*) FILTER (ts > TIMESTAMP '2024-01-20') FROM events UNION ALL SELECT 'worthless', 'all', count(*) FILTER (value < 1) FROM events""")
def stage_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("tier", F.when(F.col("value") > 50, "high").otherwise("low"))
    return pr.stage_stats(rows, "event_type", "tier", {"late": F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz"), "worthless": F.col("value") < 1})


@query("SELECT source, count(*) AS results, sum(len(string_split(text, chr(10)))) AS items, count(*) FILTER (n_chars > 1000) AS read FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.split("text", "\n").alias("lines"), (F.col("n_chars") > 1000).alias("full"))
    return pr.source_counts(rows, "source", "lines", "full")


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS start, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 10000000) AS \"end\" FROM orders")
def next_bounds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"), F.lit(10_000_000).cast("long").alias("total"))
    return pr.next_bounds(rows, "o_custkey", "o_orderkey", "total").drop("total")


@query("SELECT text AS citation, min_by(doc_id, doc_id) AS doc_id, min_by(source, doc_id) AS source FROM (SELECT trim(text) AS text, doc_id, source FROM documents) GROUP BY text")
def first_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.trim("text").alias("citation"), "doc_id", "source")
    return st.first_by_order(rows, "citation", F.col("doc_id"))


@query("SELECT l_orderkey, '[' || string_agg('{\"supp\":' || l_suppkey || ',\"flag\":\"' || l_returnflag || '\"}', ',' ORDER BY l_suppkey, l_returnflag) || ']' AS json FROM lineitem GROUP BY l_orderkey")
def json_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"))
    return pr.as_json(rows, "l_orderkey", ["supp", "flag"])


@query("SELECT count(DISTINCT c_custkey) FILTER (o_orderkey IS NOT NULL) AS covered, count(DISTINCT o_clerk) AS cited FROM customer LEFT JOIN (SELECT *, o_totalprice::BIGINT % 97 AS o_clerk FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey")
def citation_coverage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", (F.round("o_totalprice").cast("long") % 97).alias("clerk"))
    both = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.agg(F.count_distinct(F.when(F.col("o_custkey").isNotNull(), F.col("c_custkey"))).alias("covered"), F.count_distinct("clerk").alias("cited"))


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (year(o_orderdate) >= 1998 - 3) AS recent FROM orders GROUP BY o_custkey")
def recent_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.year("o_orderdate") >= 1998 - 3).alias("recent"))


@query("SELECT conv_id, count(*) AS hits FROM conversations WHERE lower(json_extract_string(to_json({'name': text}), '$.name')) LIKE '%the%' GROUP BY conv_id")
def json_key_like(spark, sf_dir):
    said = F.to_json(F.struct(F.col("text").alias("name")))
    return table(spark, sf_dir, "conversations").where(F.lower(F.get_json_object(said, "$.name")).like("%the%")).groupBy("conv_id").agg(F.count("*").alias("hits"))
