"""Validation of records over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import validation as va
from quern.plans.registry import query
from quern.plans.texts import _ALTERNATIVES, _cited_sql, _cited_text
from quern.sources.tables import table


@query(r"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '.,; ' ELSE '' END || o_orderpriority AS title, year(o_orderdate) + CASE WHEN o_orderkey % 7 = 0 THEN 50 ELSE 0 END AS year,
  CASE o_orderkey % 5 WHEN 0 THEN 'soon' WHEN 1 THEN '2050-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderstatus WHEN 'F' THEN ' CIVIL' WHEN 'O' THEN 'IP' ELSE 'unheard' END AS kind, substr('abcdefghij', 1, (o_orderkey % 10)::INT) AS short FROM orders)
SELECT o_orderkey, trim(regexp_replace(title, '^[.\s,;:]+', '')) AS title, CASE WHEN year BETWEEN 1800 AND 2026 THEN year END::INT AS year, CASE WHEN try_cast(day AS DATE) <= DATE '2026-01-01' THEN try_cast(day AS DATE) END AS day,
  CASE lower(trim(kind)) WHEN 'civil' THEN 'civil' WHEN 'ip' THEN 'ip/commercial' END AS kind, CASE WHEN length(trim(short)) >= 3 THEN substr(short, 1, 6) END AS short FROM r""")
def field_validation(spark, sf_dir):
    key = F.col("o_orderkey")
    title = F.concat(F.when(key % 3 == 0, ".,; ").otherwise(""), "o_orderpriority")
    year = F.year("o_orderdate") + F.when(key % 7 == 0, 50).otherwise(0)
    day = F.when(key % 5 == 0, "soon").when(key % 5 == 1, "2050-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    kind = F.when(F.col("o_orderstatus") == "F", " CIVIL").when(F.col("o_orderstatus") == "O", "IP").otherwise("unheard")
    short = F.substring(F.lit("abcdefghij"), 1, 10).substr(F.lit(1), (key % 10).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", va.plain_start(title).alias("title"), va.year_in(year, 1800, 2026).alias("year"), va.past_date(day, F.lit("2026-01-01").cast("date")).alias("day"), va.one_of(kind, ("civil", "criminal", "ip/commercial"), {"ip": "ip/commercial"}).alias("kind"), va.text_between(short, 3, 6).alias("short"))


@query(r"""WITH w AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)),
firsts AS (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM w GROUP BY doc_id, lower(x)),
top AS (SELECT doc_id, string_agg(x, '|' ORDER BY i) AS words FROM (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 20) GROUP BY doc_id)
SELECT doc_id, words FROM documents LEFT JOIN top USING (doc_id)""")
def capped_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(va.short_list(F.split("text", " "), 20), "|").alias("words"))


@query("""WITH r AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 > 0 THEN text END AS ratio, CASE WHEN doc_id % 4 > 1 THEN lang END AS disposal FROM documents),
f AS (SELECT *, trim(CASE WHEN instr(ratio, '. ') > 0 THEN substr(ratio, 1, instr(ratio, '. ') - 1) ELSE ratio END) AS one FROM r),
c AS (SELECT *, CASE WHEN length(one) > 200 THEN CASE WHEN contains(substr(one, 1, 200), ' ') THEN regexp_replace(substr(one, 1, 200), ' [^ ]*$', '') ELSE substr(one, 1, 200) END ELSE one END AS held FROM f)
SELECT doc_id, CASE WHEN trim(source) <> '' AND (trim(coalesce(ratio, '')) <> '' OR disposal IS NOT NULL) THEN substr(concat_ws(' ', lang || ' — ' || trim(source) || '.', CASE WHEN trim(coalesce(ratio, '')) <> '' THEN 'The court held that ' || held || '.' END, 'The case was ' || lower(disposal) || '.'), 1, 500) END AS description FROM c""")
def case_descriptions(spark, sf_dir):
    ratio, disposal = F.when(F.col("doc_id") % 3 > 0, F.trim("text")), F.when(F.col("doc_id") % 4 > 1, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", va.describe("source", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("text")), F.lit(None).cast("string"), disposal).alias("description"))


@query(rf"""WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS disposal, text || CASE doc_id % 3 WHEN 0 THEN '. In the end the appeal is partly allowed on terms. Costs follow.' ELSE ' none' END AS text FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(disposal, '')) <> '' THEN substr('The ' || lower(lang) || ' was ' || lower(trim(disposal)) || '.', 1, 300) ELSE substr(nullif(trim(regexp_extract(right(text, 3000), '([^.]*{va.OUTCOME}[^.]*\.?)', 1)), ''), 1, 200) END AS outcome FROM r""")
def case_outcomes(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, ". In the end the appeal is partly allowed on terms. Costs follow.").otherwise(" none"))
    return table(spark, sf_dir, "documents").select("doc_id", va.outcome(F.when(F.col("doc_id") % 2 == 0, F.col("source")), "lang", F.lit(None).cast("string"), text).alias("outcome"))


@query("""WITH k AS (SELECT conv_id, list({'text': text, 'novel': turn % 2 = 0} ORDER BY turn) AS props, CASE WHEN conv_id % 2 = 0 THEN max(role) END AS ratio FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN [] ELSE props END AS props, props AS every, ratio FROM k)
SELECT conv_id, CASE WHEN len(props) > 0 THEN len(props) WHEN ratio IS NOT NULL THEN 1 ELSE len(list_filter(every, lambda p: trim(p.text) <> '')) END::INT AS n,
  CASE WHEN ratio IS NOT NULL THEN ratio WHEN len(props) > 0 THEN nullif(trim(array_to_string(list_transform(list_concat(list_filter(props, lambda p: NOT p.novel), list_filter(props, lambda p: p.novel))[1:3], lambda p: p.text), ' ')), '') END AS ratio FROM s""")
def proposition_fill(spark, sf_dir):
    every = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"), (x["turn"] % 2 == 0).alias("novel")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(every.alias("every"), F.max("role").alias("role"))
    props = F.when(F.col("conv_id") % 3 != 0, F.col("every"))
    filled, ratio = va.propositions_and_ratio(props, F.when(F.col("conv_id") % 2 == 0, F.col("role")), F.transform("every", lambda x: x["text"]))
    return rows.select("conv_id", F.size(filled).alias("n"), ratio.alias("ratio"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND k = 'Criminal Appeal' THEN 'Civil Appeal' WHEN o_orderkey % 4 = 1 AND k = 'Civil Appeal' THEN 'Criminal Appeal' WHEN o_orderkey % 4 = 2 AND k = 'Criminal Appeal' THEN 'Special Leave Petition' WHEN o_orderkey % 4 = 3 AND k = 'Criminal Appeal' THEN 'Writ Petition' ELSE k END AS kind
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Criminal Appeal' WHEN 'O' THEN 'Civil Appeal' ELSE 'Other' END AS k FROM orders)""")
def case_type_fixes(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "Criminal Appeal").when(F.col("o_orderstatus") == "O", "Civil Appeal").otherwise("Other")
    n = F.col("o_orderkey") % 4
    number = F.concat(F.when(n == 0, "CIVIL APPEAL No. ").when(n == 1, "Criminal Appeal ").when(n == 2, "SLP ( C ) ").otherwise("W.P.(C) "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", va.fix_case_type(kind, number).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' WHEN ts::DATE < DATE '2024-01-01' + 183 - 168 THEN 'old' ELSE 'new' END AS code FROM events""".replace("DATE '2024-01-01' + 183 - 168", "DATE '2024-01-16'"))
def primary_codes(spark, sf_dir):
    # Days are moved so that they lie on both sides of the day on which the new codes begin.
    day = F.date_add(F.to_date("ts"), 167)
    said = F.when(F.col("event_id") % 3 == 0, "unknown").when(F.col("event_id") % 3 == 1, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", va.primary_code(F.lit(None).cast("string"), said).alias("code"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 500) WHEN 1 THEN substr(text, 1, 500) WHEN 2 THEN substr(text, 1, 500) ELSE substr('plain ' || text, 1, 500) END AS note FROM documents WHERE lang = 'en' AND trim(text) <> '' AND NOT regexp_matches(text, '^\\s*[{\\[]')""")
def first_headnotes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang = 'en' AND trim(text) <> ''").where(~F.col("text").rlike(r"^\s*[{\[]"))
    listed = F.to_json(F.array(F.struct(F.col("text").alias("proposition"), F.lit("x").alias("n"))))
    plain, one = F.to_json(F.array("text", "source")), F.to_json(F.struct(F.lit("").alias("proposition"), F.col("text").alias("headnote")))
    kind = F.col("doc_id") % 4
    notes = F.when(kind == 0, listed).when(kind == 1, plain).when(kind == 2, one).otherwise(F.concat(F.lit("plain "), "text"))
    return rows.select("doc_id", va.headnote_text(notes).alias("note"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 4 >= 0.3 THEN 'strong' WHEN l_discount * 4 >= 0.15 THEN 'moderate' ELSE 'weak' END AS impact FROM lineitem")
def impact_labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", va.impact_label(F.col("l_discount") * 4).alias("impact"))


@query(rf"""WITH e AS (SELECT o_orderkey, list_transform([{_cited_sql()}, '(' || year(o_orderdate) || ') 3 SCC ' || o_custkey, '(' || year(o_orderdate) || ') 3  scc ' || o_custkey, 'Clerk ' || o_custkey || ' v. State', 'CLERK ' || o_custkey || ' v. State', 'section 3 of it', o_custkey::VARCHAR, '1040 of 2022'], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM orders),
v AS (SELECT o_orderkey, list_filter(l, lambda t: length(t) BETWEEN 5 AND 300 AND regexp_matches(t, '^[\p{{Lu}}\d(\[]') AND NOT regexp_matches(t, '^\d{{2,5}}\s+[Oo]f\s+\d{{4}}$|^[\d\s]+$|^\d{{3,4}}\s+[A-Z][a-z]\s*\d*$|[_~`\n\r]') AND NOT regexp_matches(t, '(?i)^(?:sections?|sec\.?|articles?|art\.?|order|rule|clause)\s')) AS l FROM e),
d AS (SELECT o_orderkey, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) AS l FROM v)
SELECT o_orderkey, array_to_string(list_sort(list_filter(l, lambda x: NOT regexp_matches(x, '^(?:{_ALTERNATIVES})\.?$'))), '|') AS named, array_to_string(list_sort(list_filter(l, lambda x: regexp_matches(x, '^(?:{_ALTERNATIVES})\.?$'))), '|') AS bare FROM d""")
def citation_classes(spark, sf_dir):
    year, cust = F.year("o_orderdate").cast("string"), F.col("o_custkey").cast("string")
    entries = F.array(_cited_text(), F.concat(F.lit("("), year, F.lit(") 3 SCC "), cust), F.concat(F.lit("("), year, F.lit(") 3  scc "), cust), F.concat(F.lit("Clerk "), cust, F.lit(" v. State")), F.concat(F.lit("CLERK "), cust, F.lit(" v. State")), F.lit("section 3 of it"), cust, F.lit("1040 of 2022"))
    found = va.classify_citations(entries)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("f")).select("o_orderkey", F.array_join("f.named", "|").alias("named"), F.array_join("f.bare", "|").alias("bare"))


@query(rf"""WITH t AS (SELECT o_orderkey, {_cited_sql()} || ' [' || year(o_orderdate) || '] 2 S.C.R. ' || o_custkey || ' and (' || year(o_orderdate) || ') SCC  OnLine Del ' || o_custkey AS text FROM orders),
m AS (SELECT o_orderkey, list_transform(regexp_extract_all(text, '(\[\d{{4}}\]\s+\d+\s+[A-Z][A-Za-z.]*\s+\d+|\(\d{{4}}\)\s+\d+\s+[A-Z][A-Za-z.]*\s+\d+|\(?\d{{4}}\)?\s+[A-Z][A-Za-z]*\s+OnLine\s+\w+\s+\d+)', 1), lambda x: trim(regexp_replace(replace(lower(x), '.', ''), '\s+', ' ', 'g'))) AS l FROM t)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS keys FROM m""")
def graph_keys(spark, sf_dir):
    year, cust = F.year("o_orderdate").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(_cited_text(), F.lit(" ["), year, F.lit("] 2 S.C.R. "), cust, F.lit(" and ("), year, F.lit(") SCC  OnLine Del "), cust)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(va.embedded_citations(text), "|").alias("keys"))


@query(rf"""WITH a AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_type || ' Act' WHEN 1 THEN 'The court held that ' || p_type || ' Act' WHEN 2 THEN 'ACT-' || p_size WHEN 3 THEN p_name WHEN 4 THEN 'X v. Y Act' ELSE '7 A' END AS t FROM part)
SELECT p_partkey, t = 'ACT-7' OR (length(t) BETWEEN 6 AND 120 AND regexp_matches(t, '^\p{{Lu}}') AND regexp_matches(t, '{va.ACT_WORDS}') AND NOT regexp_matches(t, '{va.SENTENCE_WORDS}') AND NOT regexp_matches(t, '[_~`|{{}}]|\d{{5,}}')) AS valid,
  regexp_matches(t, '{va.SENTENCE_WORDS}') OR regexp_matches(t, '(?i)\bv(?:s|ersus)?\.\s') OR regexp_matches(t, '^(?:{_ALTERNATIVES})\.?$') OR length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 3 AS garbage, CASE WHEN t = 'ACT-7' THEN 'Seventh Act, 1907' ELSE t END AS display FROM a""")
def act_checks(spark, sf_dir):
    key = F.col("p_partkey") % 6
    said = F.when(key == 0, F.concat("p_type", F.lit(" Act"))).when(key == 1, F.concat(F.lit("The court held that "), "p_type", F.lit(" Act"))).when(key == 2, F.concat(F.lit("ACT-"), F.col("p_size").cast("string"))).when(key == 3, F.col("p_name")).when(key == 4, "X v. Y Act").otherwise("7 A")
    return table(spark, sf_dir, "part").select("p_partkey", va.is_act_name(said, ("ACT-7",)).alias("valid"), va.is_act_garbage(said).alias("garbage"), va.act_display(said, {"ACT-7": ("Seventh Act", 1907)}).alias("display"))


@query(rf"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Legal provisions' WHEN 1 THEN 'grounds' ELSE 'Prayer' END AS section, CASE WHEN o_orderkey % 2 = 0 THEN {_cited_sql()} ELSE 'See (2001) 3 SCC ' || o_custkey END AS text FROM orders),
n AS (SELECT *, len(list_distinct(regexp_extract_all(text, '(^|[^\w:])({_ALTERNATIVES})', 2))) AS n FROM t)
SELECT o_orderkey, CASE WHEN section <> 'Prayer' AND n < 2 THEN CASE section WHEN 'grounds' THEN 'Grounds' ELSE 'Legal Provisions' END || ': only ' || n || ' citation(s)' END AS warning FROM n""")
def citation_warnings(spark, sf_dir):
    key = F.col("o_orderkey")
    section = F.when(key % 3 == 0, "Legal provisions").when(key % 3 == 1, "grounds").otherwise("Prayer")
    text = F.when(key % 2 == 0, _cited_text()).otherwise(F.concat(F.lit("See (2001) 3 SCC "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", va.citation_warning(text, section, ("legal_provisions", "grounds")).alias("warning"))


@query("""WITH b AS (SELECT l_orderkey AS case_id, year(o_orderdate) AS year, l_suppkey AS j FROM lineitem JOIN orders ON o_orderkey = l_orderkey), t AS (SELECT s_suppkey AS j, 1990 + s_suppkey % 5 AS first, 1993 + s_suppkey % 5 AS last FROM supplier WHERE s_suppkey % 4 > 0)
SELECT case_id, string_agg(DISTINCT j::VARCHAR, ',' ORDER BY j::VARCHAR) AS kept FROM b LEFT JOIN t USING (j) WHERE first IS NULL OR year BETWEEN first AND last + 1 GROUP BY case_id""")
def tenure_check(spark, sf_dir):
    names = F.transform(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), lambda x: x)
    bench = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(names.alias("judges"))
    rows = bench.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.year("o_orderdate").alias("year")), "case_id")
    key = F.col("s_suppkey")
    tenure = table(spark, sf_dir, "supplier").where("s_suppkey % 4 > 0").select(key.cast("string").alias("name"), (1990 + key % 5).alias("first"), (1993 + key % 5).alias("last"))
    return va.plausible_members(rows, "case_id", "judges", "year", tenure).where(F.size("judges") > 0).select("case_id", F.array_join("judges", ",").alias("kept"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)ignore (all )?(previous|prior|above) instructions|disregard (all )?(previous|prior) (instructions|rules)|you are now|system prompt|<\|im_(start|end)\|>|\[/?INST\]') AS injected, sha256(replace('{~doc_id~:' || doc_id || ',~lang~:~' || lang || '~}', '~', chr(34))) AS cache_key FROM documents")
def injection_and_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.tries_injection("text").alias("injected"), tx.cache_key("doc_id", "lang").alias("cache_key"))
