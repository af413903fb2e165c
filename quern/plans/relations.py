"""Filters, joins, set operations and upserts over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import filters as fl
from quern.operators import joins as jo
from quern.plans.cases import ACTS_SQL, BASE_SQL, JUDGES_SQL, base_cases, case_arrays, cases
from quern.plans.registry import query
from quern.sources import tables as src
from quern.sources.tables import table


@query(f"""WITH {BASE_SQL}, {JUDGES_SQL}, {ACTS_SQL} SELECT case_id, court, year FROM base WHERE lower(court) IN ('france', 'germany', 'nation_3', 'nation_7') AND year >= 1993 AND year <= 1997 AND case_type ILIKE '%urgent%' AND disposal ILIKE '%allow%'
  AND case_id IN (SELECT case_id FROM judges WHERE judge::VARCHAR ILIKE '%3%') AND case_id IN (SELECT case_id FROM acts WHERE lower(act) = 'brand#11')""")
def filters_combo(spark, sf_dir):
    narrow = fl.SearchFilters(court=("FRANCE", "GERMANY", "NATION_3", "NATION_7"), year_from=1993, case_type="urgent").merged(fl.SearchFilters(year_from=1990, year_to=1997, judge="3", act="BRAND#11", disposal="allow"))
    return cases(spark, sf_dir).where(fl.search_predicate(narrow)).select("case_id", "court", "year")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3) AND vec_id >= 100 AND vec_id <= 400 AND vec_id <> 150")
def metadata_dsl(spark, sf_dir):
    known = {"label": "label", "id": "vec_id"}
    return table(spark, sf_dir, "embeddings").where(fl.metadata_predicate({"label": {"$in": [1, 3]}, "id": {"$gte": 100, "$lte": 400, "$ne": 150}}, known)).select("vec_id", "label")


@query(f"WITH {JUDGES_SQL} SELECT case_id FROM judges WHERE judge = 7")
def metadata_dsl_array(spark, sf_dir):
    return case_arrays(spark, sf_dir).where(fl.metadata_predicate({"judge": {"$in": [7]}}, {"judge": "judge"})).select("case_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%005%' ORDER BY s_suppkey DESC NULLS LAST, s_name LIMIT 10")
def suggest_ilike(spark, sf_dir):
    return fl.suggest(table(spark, sf_dir, "supplier"), "005", ["s_name"], "s_suppkey").select("s_suppkey", "s_name")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|\\s)the($|\\s|[,;.)\\]])')")
def exact_boundary_regex(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(fl.exact_mention("text", "the")).select("doc_id")


@query(f"WITH {JUDGES_SQL} SELECT case_id FROM judges WHERE judge IN (3, 7) GROUP BY case_id HAVING count(*) = 2")
def array_contains_all(spark, sf_dir):
    return case_arrays(spark, sf_dir).where(fl.has_all("judge", [3, 7])).select("case_id")


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' AND user_id < 50 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def audit_log_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.where((F.col("event_type") == "click") & (F.col("user_id") < 50) & fl.between_times("ts", "2024-01-10", "2024-01-20")).select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def review_queue(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return fl.sorted_by(pending, "o_totalprice", "desc", ["o_totalprice", "o_orderdate"], "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT conv_id, count(text) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def sessions_latest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("text").alias("n"), F.max("turn").alias("last_turn"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def sessions_left_count(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return jo.count_children(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("""SELECT p_partkey, coalesce(a.n, 0) AS returned, coalesce(b.n, 0) AS kept FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON p_partkey = a.l_partkey
  LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) b ON p_partkey = b.l_partkey""")
def preagg_left_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    parts = jo.count_children(table(spark, sf_dir, "part").select("p_partkey"), lines.where("l_returnflag = 'R'"), "p_partkey", "returned")
    return jo.count_children(parts, lines.where("l_returnflag <> 'R'"), "p_partkey", "kept")


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM customer) AS customer")
def scalar_subqueries(spark, sf_dir):
    return jo.scalar_counts(**{t: table(spark, sf_dir, t) for t in ("orders", "documents", "events", "customer")})


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 45)")
def semi_exists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return fl.having_ids(table(spark, sf_dir, "supplier"), lines, "s_suppkey").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_grounding(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return jo.not_among(table(spark, sf_dir, "customer").select("c_custkey"), large, "c_custkey")


@query("""WITH l AS (SELECT * FROM customer WHERE c_custkey % 10 <> 1), r AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 2 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 3)
SELECT c_custkey, CASE WHEN r.c_name IS NULL THEN 'only_left' WHEN l.c_name IS NULL THEN 'only_right' WHEN l.c_acctbal <> r.c_acctbal THEN 'differs' ELSE 'same' END AS status FROM l FULL JOIN r USING (c_custkey)""")
def dataset_reconcile(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    changed = customer.where("c_custkey % 10 <> 3").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 == 2, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return src.reconcile(customer.where("c_custkey % 10 <> 1"), changed, "c_custkey")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag = 'R' AS overruled FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 5""")
def subsequent_history(spark, sf_dir):
    newest = jo.newest_per_key(table(spark, sf_dir, "lineitem"), "l_suppkey", [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return newest.select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("overruled"))


@query("""WITH asked AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE 'x' || c_name END AS cited FROM orders JOIN customer ON o_custkey = c_custkey),
names AS (SELECT c_name AS key, c_custkey AS id FROM customer)
SELECT o_orderkey, coalesce(a.id, b.id) AS target, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 ELSE 0 END::INT AS tier FROM asked LEFT JOIN (SELECT key, max(id) AS id FROM names GROUP BY 1) a ON cited = a.key
LEFT JOIN (SELECT lower(key) AS key, max(id) AS id FROM names GROUP BY 1) b ON lower(cited) = b.key""")
def resolve_cascade(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.col("o_orderkey") % 3
    asked = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", F.when(kind == 0, F.col("c_name")).when(kind == 1, F.upper("c_name")).otherwise(F.concat(F.lit("x"), "c_name")).alias("cited"))
    names = customer.select(F.col("c_name").alias("key"), F.col("c_custkey").alias("id"))
    return jo.cascade(asked, F.col("cited"), [(names, F.col("cited")), (names.withColumn("key", F.lower("key")), F.lower("cited"))]).select("o_orderkey", "target", "tier")


PAGE = 1000


@query(f"""SELECT doc_id, n_chars // 2 AS point, (n_chars // 2) // {PAGE} AS page FROM documents WHERE n_chars > 1""")
def range_stab_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars > 1")
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 1) / PAGE))).alias("page")).withColumn("start", F.col("page") * PAGE).withColumn("end", F.col("start") + PAGE)
    points = docs.select("doc_id", F.floor(F.col("n_chars") / 2).alias("point"))
    return jo.stab(points, pages, "point", "start", "end", "doc_id", 4 * PAGE).select("doc_id", "point", "page")


@query("""SELECT e.event_id, p.value AS value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_author(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return jo.as_of(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "value").select("event_id", "value")


@query("""SELECT l_partkey, arg_min(l_orderkey, (r, l_orderkey, l_linenumber)) AS l_orderkey FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS r FROM lineitem) GROUP BY l_partkey""")
def source_priority_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("r"))
    return jo.first_by_source(rows, "l_partkey", [F.col("r"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey")


NEW_SQL = "new AS (SELECT c_custkey + 5 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 1.5 END AS c_acctbal FROM customer WHERE c_custkey > 100)"


def _changes(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    old = customer.select("c_custkey", "c_name", "c_acctbal")
    key = F.col("c_custkey")
    new = customer.where("c_custkey > 100").select((key + 5).alias("c_custkey"), F.when(key % 2 == 0, F.concat(F.lit("N"), "c_name")).alias("c_name"), F.when(key % 3 == 0, F.lit(1.5)).alias("c_acctbal"))
    return old, new


@query(f"""WITH {NEW_SQL} SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal::DOUBLE ELSE o.c_acctbal END AS c_acctbal
FROM customer o FULL JOIN new n USING (c_custkey)""")
def upsert_coalesce(spark, sf_dir):
    old, new = _changes(spark, sf_dir)
    return src.upsert(old, new, ["c_custkey"], overwrite=["c_acctbal"])


@query(f"WITH {NEW_SQL} SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, sf_dir):
    return src.insert_missing(*_changes(spark, sf_dir), ["c_custkey"])


@query("SELECT vec_id, label FROM embeddings WHERE NOT (label = 3) OR vec_id % 7 = 0")
def stale_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return src.delete_stale(rows, F.col("label") == 3, rows.where("vec_id % 7 = 0"), "vec_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def replace_latest(spark, sf_dir):
    return src.replace_latest(table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascading_purge(spark, sf_dir):
    bad = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return src.purge({"lines": table(spark, sf_dir, "lineitem")}, bad, "l_orderkey")["lines"].select("l_orderkey", "l_linenumber", "l_quantity")


@query("WITH j AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey)::INT - 1 AS place, l_suppkey AS judge FROM j")
def unnest_children(spark, sf_dir):
    parents = case_arrays(spark, sf_dir).select("case_id", F.transform("judge", lambda x: F.struct(x.alias("judge"))).alias("judges"))
    return src.unnest_children(parents, "case_id", "judges")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS list FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2) GROUP BY 1")
def cross_reference(spark, sf_dir):
    kinds = F.collect_set("event_type")
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("k")).where(F.size("k") >= 2)
    return found.select("user_id", F.size("k").cast("long").alias("kinds"), F.array_join(F.sort_array("k"), ",").alias("list"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40")
def set_difference(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return urgent.subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")))


@query(f"WITH {BASE_SQL} SELECT case_id, substr(court || ' ' || case_type, 1, 12) AS head FROM base WHERE court <> 'CHINA'")
def truncated_projection(spark, sf_dir):
    return base_cases(spark, sf_dir).where("court <> 'CHINA'").select("case_id", F.substring(F.concat_ws(" ", "court", "case_type"), 1, 12).alias("head"))


@query("SELECT user_id, event_id, event_type AS action, value FROM events WHERE event_id % 97 = 0")
def existence_probe(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    asked = events.where("event_id % 97 = 0").select("event_id")
    return fl.having_ids(events, asked, "event_id").select("user_id", "event_id", F.col("event_type").alias("action"), "value")
