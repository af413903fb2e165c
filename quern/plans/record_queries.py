"""Record functions over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import records as rc
from quern.plans.registry import query
from quern.sources.tables import table


def values(pairs) -> str:
    """Pairs of texts as SQL rows."""
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in pairs)


def cases_sql(value: str, pairs, other: str) -> str:
    """The second text of the first pair whose first text the value holds."""
    return "CASE " + " ".join("WHEN contains({}, '{}') THEN '{}'".format(value, a.replace("'", "''"), b.replace("'", "''")) for a, b in pairs) + f" ELSE {other} END"


CODES = list(rc.COURT_NAMES)
FULL_NAMES = list(dict.fromkeys(rc.COURT_NAMES.values()))
KNOWN_COURTS = {k.lower(): v for k, v in rc.COURT_NAMES.items()} | {v.lower(): v for v in FULL_NAMES}


@query(f"""WITH names(low, name) AS (VALUES {values(KNOWN_COURTS.items())}), codes AS (SELECT [{", ".join(f"'{c}'" for c in CODES)}] AS c, [{", ".join("'" + p.replace("'", "''") + "'" for p, _ in rc.COURT_PHRASES)}] AS p),
raw AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c[c_custkey % {len(CODES)} + 1] WHEN 1 THEN ' ' || lower(c[c_custkey % {len(CODES)} + 1]) WHEN 2 THEN 'In the ' || upper(p[c_custkey % {len(rc.COURT_PHRASES)} + 1]) || ', ' || c_name WHEN 3 THEN 'High Court at ' || n_name WHEN 4 THEN 'Sessions Judge, ' || n_name ELSE 'Sales Tax Tribunal ' || c_mktsegment END AS said
  FROM customer JOIN nation ON c_nationkey = n_nationkey, codes),
found AS (SELECT c_custkey, coalesce(name, {cases_sql("lower(said)", rc.COURT_PHRASES, "said")}) AS court FROM raw LEFT JOIN names ON low = lower(trim(said)))
SELECT c_custkey, court, CASE WHEN court = 'Supreme Court of India' THEN 'supreme' WHEN lower(court) LIKE 'high court of %' THEN 'high' WHEN regexp_matches(lower(court), '{"|".join(rc.DISTRICT_WORDS)}') THEN 'district' WHEN contains(lower(court), 'high court') THEN 'high' WHEN contains(lower(court), 'supreme court') THEN 'supreme'
  WHEN contains(lower(court), 'tribunal') OR contains(lower(court), 'commission') THEN 'tribunal' ELSE 'unknown' END AS level FROM found""")
def court_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nth = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    kind, code = F.col("c_custkey") % 6, nth(CODES)
    said = F.when(kind == 0, code).when(kind == 1, F.concat(F.lit(" "), F.lower(code))).when(kind == 2, F.concat(F.lit("In the "), F.upper(nth([p for p, _ in rc.COURT_PHRASES])), F.lit(", "), "c_name"))
    said = said.when(kind == 3, F.concat(F.lit("High Court at "), "n_name")).when(kind == 4, F.concat(F.lit("Sessions Judge, "), "n_name")).otherwise(F.concat(F.lit("Sales Tax Tribunal "), "c_mktsegment"))
    return rows.select("c_custkey", rc.court_name(said).alias("court"), rc.court_level(said).alias("level"))


def repair_sql(x: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in rc.act_words()) + "]"
    known = f"CASE WHEN length({{0}}) >= {rc.LEAST_REPAIRED} THEN list_filter({words}, lambda k: levenshtein(k, {{0}}) <= 1)[1] END"
    w, at = f"string_split({x}, ' ')", "{}[{}]"
    one = lambda k: at.format("q.w", k)
    pair = lambda k: known.format(f"concat({one(k)}, {one(f'{k} + 1')})")
    fixed = f"CASE WHEN n > 1 AND {pair('n - 1')} IS NOT NULL THEN NULL WHEN n < len(q.w) AND {pair('n')} IS NOT NULL THEN {pair('n')} ELSE coalesce({known.format(one('n'))}, {one('n')}) END"
    listed = f"list_filter(list_transform(range(1, len(q.w) + 1), lambda n: {fixed}), lambda v: v IS NOT NULL)"
    years = f"list_transform({listed}, lambda v: CASE WHEN regexp_matches(v, '^[(]?[1lIzZ2][0-9oO]{{3}}[),.]*$') THEN translate(v, 'lIzZoO', '111100') ELSE v END)"
    return f"list_transform([{{'w': {w}}}], lambda q: array_to_string({years}, ' '))[1]"


def act_sql(x: str) -> str:
    x = f"trim({repair_sql(x)})"
    for prefix in (r"Section\s+\S+", r"Order\s+\S+\s+Rule\s+\S+", r"Article\s+\S+"):
        x = f"regexp_replace({x}, '(?i)^{prefix}\\s+of\\s+', '')"
    return rf"trim(regexp_replace(trim({x}), ',?\s*\(?\d{{4}}\)?\s*$', ''))"


@query(f"""WITH raw AS (SELECT p_partkey, ['Section ' || p_size || ' of Indian Con tract Act, l87' || p_size % 10, CASE WHEN p_size % 2 = 0 THEN 'indian contract act' ELSE 'The Limi tation Act, 19o' || p_size % 10 END, 'Article ' || p_size || ' of ' || p_type || ' Act, 1950', p_size || ' A', 'Order ' || p_size || ' Rule 2 of Code of Crimiual Proce dure ' || (1900 + p_size)] AS acts FROM part),
done AS (SELECT p_partkey, list_transform(list_transform(acts, lambda x: {act_sql('x')}), lambda a: CASE WHEN lower(a) = 'indian contract act' THEN 'CONTRACT' ELSE a END) AS acts FROM raw)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(acts, lambda a: length(regexp_replace(a, '[^\\p{{L}}]', '', 'g')) >= 3))), '|') AS acts FROM done""")
def act_lists(spark, sf_dir):
    size = F.col("p_size").cast("string")
    digit = (F.col("p_size") % 10).cast("string")
    acts = F.array(
        F.concat(F.lit("Section "), size, F.lit(" of Indian Con tract Act, l87"), digit), F.when(F.col("p_size") % 2 == 0, "indian contract act").otherwise(F.concat(F.lit("The Limi tation Act, 19o"), digit)),
        F.concat(F.lit("Article "), size, F.lit(" of "), "p_type", F.lit(" Act, 1950")), F.concat(size, F.lit(" A")), F.concat(F.lit("Order "), size, F.lit(" Rule 2 of Code of Crimiual Proce dure "), (1900 + F.col("p_size")).cast("string")),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rc.normalize_acts(acts, {"Indian Contract Act": "CONTRACT"}), "|").alias("acts"))


@query("""WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT floor(sum(n) / 3) AS goal FROM c), o AS (SELECT y, n, row_number() OVER (ORDER BY y) AS i FROM c)
SELECT part::INT AS part, min(y)::INT AS first, max(y)::INT AS last FROM (WITH RECURSIVE w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS y, 0::BIGINT AS s, -1 AS part, 0 AS next
  UNION ALL SELECT o.i, o.y, CASE WHEN s + n >= goal AND next < 2 THEN 0 ELSE s + n END, next, CASE WHEN s + n >= goal AND next < 2 THEN next + 1 ELSE next END FROM w JOIN o ON o.i = w.i + 1, g) SELECT * FROM w WHERE part >= 0) GROUP BY part""")
def even_year_ranges(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return rc.even_ranges(years, "year", "n", 3)


@query("""WITH e AS (SELECT user_id, CASE WHEN event_id % 5 > 0 THEN ts::DATE END AS d, event_id FROM events)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY d IS NULL, d, event_id))::INT AS place, d AS date, event_id FROM e""")
def timelines(spark, sf_dir):
    day = F.when(F.col("event_id") % 5 > 0, F.to_date("ts"))
    return rc.timeline_rows(table(spark, sf_dir, "events").select("user_id", day.alias("date"), "event_id"), "user_id", "date", "event_id")


@query(r"SELECT page_id, substr(replace(replace(lower(url), ' ', '_'), ',', ''), 1, 100) AS slug, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(url, '/', ' ANDD '), '\bANDD\b', 'AND', 'g'), '\bORR\b', 'OR', 'g'), '\bNOTT\b', 'NOT', 'g'), '\bNEAR\b', 'AND', 'g') AS line FROM pages")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rc.slug("url").alias("slug"), rc.search_words(F.replace("url", F.lit("/"), F.lit(" ANDD "))).alias("line"))


@query(r"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i % 40 = 1 THEN chr(10) || '[Per ' || upper(substr(regexp_replace(w, '[^A-Za-z]', '', 'g'), 1, 1)) || lower(substr(regexp_replace(w, '[^A-Za-z]', '', 'g'), 2)) || ', J.]' || chr(10) ELSE w END), ' ') AS text FROM documents),
w AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) <= 100), lambda x: list_filter(regexp_split_to_array(translate(x, '[](),:', '      '), '\s+'), lambda y: y <> '' AND lower(y) <> 'per')) AS lines FROM t)
SELECT doc_id, array_to_string(list_transform(list_filter(lines, lambda l: len(l) BETWEEN 2 AND 8 AND replace(upper(l[-1]), '.', '') IN ('J', 'JJ', 'CJ', 'CJI') AND len(list_filter(l, lambda y: NOT regexp_full_match(y, '[A-Z][A-Za-z.]*'))) = 0), lambda l: array_to_string(l[:-2], ' ')), '|') AS authors FROM w""")
def opinion_authors(spark, sf_dir):
    bare = lambda w: F.regexp_replace(w, "[^A-Za-z]", "")
    head = lambda w: F.concat(F.lit("\n[Per "), F.upper(F.substring(bare(w), 1, 1)), F.lower(F.substring(bare(w), 2, 1_000_000)), F.lit(", J.]\n"))
    text = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 40 == 0, head(w)).otherwise(w)), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rc.opinion_authors(text), "|").alias("authors"))


@query("SELECT doc_id, CASE WHEN contains(text, 'rights') THEN substr(text, greatest(1, instr(text, 'rights') - 40), least(instr(text, 'rights') - 1, 40) + 46)::VARCHAR END AS around FROM documents")
def window_around(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rc.window_around("text", "rights", 40).alias("around"))


@query(r"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(text, '[^ -~\s]', '', 'g')), '\s+', ' ', 'g')) AS x FROM conversations), t AS (SELECT *, lead(x) OVER w AS y, lead(turn) OVER w AS next FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN x = '' OR y = '' THEN 0.0 ELSE round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 4) END AS similarity FROM t WHERE next = turn + 1""")
def sequence_similarity(spark, sf_dir):
    plain = lambda c: F.regexp_replace(c, r"[^ -~\s]", "")
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(rc.text_similarity(plain("text"), plain("after")), 4).alias("similarity"))


@query("""WITH p AS (SELECT conv_id, list_filter(list(trim(text) ORDER BY turn), lambda x: x <> '') AS pages FROM conversations GROUP BY conv_id)
SELECT conv_id, list_reduce(list_prepend('', pages), lambda a, p: CASE WHEN a = '' THEN p WHEN regexp_matches(a, '\\p{L}-$') AND regexp_matches(p, '^\\p{Ll}') THEN regexp_replace(a, '-$', '') || p WHEN regexp_matches(p, '^\\p{Ll}') THEN a || ' ' || p ELSE a || chr(10) || chr(10) || p END) AS joined FROM p""")
def join_pages(spark, sf_dir):
    pages = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(pages.alias("pages")).select("conv_id", rc.join_pages("pages").alias("joined"))


@query("""WITH t AS (SELECT doc_id, [lower(source), 'Tax', ' tax ', lang, 'GST'] AS tags FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags FROM (SELECT doc_id, list_transform(list_filter(tags, lambda x: x IS NOT NULL), lambda x: CASE WHEN lower(trim(x)) = 'gst' THEN 'taxation' WHEN lower(trim(x)) = 'tax' THEN 'taxation' ELSE lower(trim(x)) END) AS l FROM t)""")
def issue_tags(spark, sf_dir):
    tags = F.array_compact(F.array(F.lower("source"), F.lit("Tax"), F.lit(" tax "), F.col("lang"), F.lit("GST")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rc.issue_tags(tags, {"tax": "taxation", "gst": "taxation"}), ",").alias("tags"))


@query("""SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'Urgent Appeal' WHEN '5-low' THEN 'Low Appeal' ELSE array_to_string(list_transform(string_split(lower(trim(o_orderpriority)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS kind FROM orders""")
def case_types(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", rc.case_type("o_orderpriority", {"1-URGENT": "Urgent Appeal", "5-LOW": "Low Appeal"}).alias("kind"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(?:identity\s+of\s+the\s+victim|licensed|rights\s+reserved)\b') OR contains(lower(source), 'pocso') AS sensitive FROM documents""")
def sensitive_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rc.is_sensitive("text", F.array("source"), ("identity of the victim", "licensed", "rights reserved")).alias("sensitive"))


@query(r"""WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'nowhere ' || text ELSE substr(text, 30, 220) END AS anchor FROM documents),
s AS (SELECT *, CASE WHEN length(anchor) > 0 THEN coalesce(nullif(instr(text, substr(anchor, 1, 200)), 0), nullif(instr(text, substr(anchor, 1, 100)), 0), nullif(instr(text, substr(anchor, 1, 50)), 0), 0) ELSE 0 END AS pos FROM t),
c AS (SELECT doc_id, pos, substr(text, greatest(1, pos - 100), 200) AS cut FROM s)
SELECT doc_id, CASE WHEN pos > 100 THEN regexp_replace(cut, '^[^.?!]{0,300}[.?!]\s+', '') WHEN pos > 0 THEN cut END AS passage FROM c""")
def passages(spark, sf_dir):
    anchor = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("nowhere "), "text")).otherwise(F.substring("text", 30, 220))
    return table(spark, sf_dir, "documents").select("doc_id", rc.passage("text", anchor, 100).alias("passage"))
