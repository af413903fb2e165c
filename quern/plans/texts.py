"""Text functions over the driver's documents and pages, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import provisions as pv
from quern.functions import text as tx
from quern.plans.registry import query
from quern.sources.tables import table

WORDS = ["the", "que", "der", "licensed", "copyright"]
SQUASH = r"regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT sha256({SQUASH}) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def hash_dedup(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(tx.content_hash("text").alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '\b(\d{4})\s(\d{4})\s(\d{4})\b', '[AADHAAR REDACTED]', 'g') AS t FROM documents),
b AS (SELECT doc_id, text, regexp_replace(t, '(?:\+91[\s-]?|91[\s-]?|0)[6-9]\d{9}\b|\b[6-9]\d{9}\b', '[PHONE REDACTED]', 'g') AS t FROM a),
c AS (SELECT doc_id, text, regexp_replace(regexp_replace(t, '\b\d{12}\b', '[AADHAAR REDACTED]', 'g'), '\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b', '[PAN REDACTED]', 'g') AS t FROM b)
SELECT doc_id, sha256(t) AS masked_hash, t <> text AS masked FROM c""")
def pii_mask(spark, sf_dir):
    masked = tx.mask_pii("text")
    return docs(spark, sf_dir).select("doc_id", F.sha2(masked, 256).alias("masked_hash"), (masked != F.col("text")).alias("masked"))


@query("WITH k AS (SELECT doc_id, length(text) AS n, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS) + r" AS known, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) AS share FROM documents) SELECT doc_id, CASE WHEN n > 0 AND share < 0.4 THEN 'low' WHEN n > 2000 AND known >= 3 THEN 'high' WHEN n > 500 AND known >= 1 THEN 'medium' ELSE 'low' END AS tier, round(share, 3) AS alpha_ratio FROM k")
def quality_tier(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.quality_tier("text", WORDS).alias("tier"), F.round(tx.letters_share("text"), 3).alias("alpha_ratio"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(lower(text), '\b(?:all rights|the|and of)\b')) / length(text) * 1000, 2) ELSE 0.0 END AS density FROM documents")
def signal_density(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.signal_density("text", ["all rights", "the", "and of"]).alias("density"))


@query(r"SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_hash, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.strip_html("html"), 256).alias("text_hash"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"""SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))::INT AS n FROM pages""")
def sanitize_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.sanitize("html")).alias("n"))


@query("""WITH lines AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), own AS (SELECT DISTINCT doc_id, line FROM lines WHERE line <> '' AND length(line) < 200)
SELECT line, count(*) AS docs FROM own GROUP BY line HAVING count(*) >= 3""")
def repeated_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> '' AND length(line) < 200")
    return lines.groupBy("line").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 3")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))::INT AS controls FROM documents")
def garble_check(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.control_characters("text").alias("controls"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 300) || '...' || right(text, 200) END) AS cut_hash FROM documents")
def head_and_tail(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(tx.head_and_tail("text", 300, 200, "..."), 256).alias("cut_hash"))


@query(r"""WITH t AS (SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN ' v. ' WHEN 1 THEN '_VS ' ELSE ' versus ' END || p_type || '.' AS title FROM part) SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\bv(?:s|ersus)?\b\.?', ' v ', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM t""")
def title_key(spark, sf_dir):
    sign = F.when(F.col("p_size") % 3 == 0, " v. ").when(F.col("p_size") % 3 == 1, "_VS ").otherwise(" versus ")
    return table(spark, sf_dir, "part").select("p_partkey", tx.title_key(F.concat("p_name", sign, "p_type", F.lit("."))).alias("key"))


REPORTERS = ["({y}) {n} SCC {k}", "[{y}] {n}  SCC {k}", "A.I.R. {y} SC {k}", "{y} Cr.L.J. {k}", "{y}:INSC:{k}", "MANU/SC/{k}/{y}", "[{y}] {n} SCR {k}", "({y}) {n} SCALE {k}", "{y} SCC On Line Del {k}", "[{y}] {n} ITR {k}", "{y} LiveLaw (SC) {k}", "({y}) {n} Xyz {k}"]


def _cited_text():
    y, n, k = F.year("o_orderdate").cast("string"), (F.col("o_custkey") % 9 + 1).cast("string"), F.col("o_orderkey").cast("string")

    def filled(form):
        for name, value in (("{y}", y), ("{n}", n), ("{k}", k)):
            form = F.replace(form, F.lit(name), value)
        return form

    # One form is chosen, then filled in.
    nth = lambda shift: filled(F.element_at(F.array(*map(F.lit, REPORTERS)), ((F.col("o_orderkey") * 7 + shift) % len(REPORTERS) + 1).cast("int")))
    return F.concat(F.lit("See "), nth(0), F.lit(", relied on in "), nth(5), F.lit("; also "), nth(0), F.lit("."))


def _cited_sql() -> str:
    forms = "[" + ", ".join(f"'{f}'" for f in REPORTERS) + "]"
    nth = lambda shift: f"replace(replace(replace({forms}[(o_orderkey * 7 + {shift}) % {len(REPORTERS)} + 1], '{{y}}', year(o_orderdate)::VARCHAR), '{{n}}', (o_custkey % 9 + 1)::VARCHAR), '{{k}}', o_orderkey::VARCHAR)"
    return f"'See ' || {nth(0)} || ', relied on in ' || {nth(5)} || '; also ' || {nth(0)} || '.'"


#: The normalisation of citations, as SQL over x.
NORMAL_SQL = r"""list_transform(list_transform(list_transform(list_transform({}, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
  lambda x: CASE WHEN regexp_matches(x, '^\d{{4}} ?:') THEN regexp_replace(x, ' ?: ?', ':', 'g') WHEN regexp_matches(x, '^MANU ?/') THEN regexp_replace(x, ' ?/ ?', '/', 'g') ELSE x END),
  lambda x: regexp_replace(array_to_string(list_transform(string_split(x, ' '), lambda w: CASE replace(upper(w), '.', '') WHEN 'AIR' THEN 'AIR' WHEN 'CRLJ' THEN 'CrLJ' WHEN 'VS' THEN 'v.' WHEN 'VERSUS' THEN 'v.' ELSE w END), ' '), 'SCC [Oo]n ?[Ll]ine', 'SCC OnLine', 'g')),
  lambda x: regexp_replace(regexp_replace(x, '^\[(\d{{4}})\] (\d+) (SCC|ITR|taxmann\.com) ', '(\1) \2 \3 '), '(\d) ?\.$', '\1'))"""
_ALTERNATIVES = "|".join(f"(?:{p})" for _, p, _ in tx.CITATIONS)


@query(f"""WITH t AS (SELECT o_orderkey, {_cited_sql()} AS text FROM orders), m AS (SELECT o_orderkey, regexp_extract_all(text, '(^|[^\\w:])({_ALTERNATIVES})', 2) AS marks FROM t),
n AS (SELECT o_orderkey, {NORMAL_SQL.format('marks')} AS l FROM m)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS cited FROM n""")
def citation_extract(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(tx.extract_citations(_cited_text()), lambda x: x["citation"]), "|").alias("cited"))


@query(rf"""WITH t AS (SELECT o_orderkey, 'As held in Messrs ' || replace(o_orderpriority, '-', '. ') || ' and Sons ' || CASE o_orderkey % 3 WHEN 0 THEN 'v.' WHEN 1 THEN 'vs' ELSE 'versus' END || ' State of  Orders' || o_custkey || '. Relied on in Anil Kumar v. Ram Das' || o_custkey % 3 || ', and in Anil  Kumar vs. Ram Das' || o_custkey % 3 || ' too.' AS text FROM orders),
n AS (SELECT o_orderkey, list_transform(regexp_extract_all(text, '\b(?:{tx.NAMING})\s+({tx.PARTY.replace("'", "''")}(?:\s+{tx.PARTY.replace("'", "''")})*\s+(?:v\.?s?\.?|versus)\s+{tx.PARTY.replace("'", "''")}(?:\s+{tx.PARTY.replace("'", "''")})*)', 1), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), ' (?:v\.?s?\.?|versus) ', ' v. ', 'g'), '\.$', '')) AS l FROM t)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS names FROM n""")
def case_names(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    sign = F.when(key % 3 == 0, "v.").when(key % 3 == 1, "vs").otherwise("versus")
    third = (cust % 3).cast("string")
    text = F.concat(F.lit("As held in Messrs "), F.replace("o_orderpriority", F.lit("-"), F.lit(". ")), F.lit(" and Sons "), sign, F.lit(" State of  Orders"), cust.cast("string"), F.lit(". Relied on in Anil Kumar v. Ram Das"), third, F.lit(", and in Anil  Kumar vs. Ram Das"), third, F.lit(" too."))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.case_names(text), "|").alias("names"))


@query(r"""WITH t AS (SELECT p_partkey, unnest(range(len(m))) AS i, unnest(m) AS x FROM (SELECT p_partkey, regexp_extract_all(p_size || CASE p_partkey % 4 WHEN 0 THEN ', ' WHEN 1 THEN ' to ' WHEN 2 THEN '-' ELSE ' & ' END || (p_size + p_partkey % 30) || ' and ' || p_size || '-A, 9A(1) of ' || p_type, '\d+(?:-?[A-Z]{1,2}\b)?(?:\(\w+\))*|[-–]|\bto\b') AS m FROM part)),
k AS (SELECT *, lag(x) OVER w IN ('-', '–', 'to') AS joined, lag(x, 2) OVER w AS low, lead(x) OVER w IN ('-', '–', 'to') AS opens, lead(x, 2) OVER w AS high FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
o AS (SELECT p_partkey, i, CASE WHEN x IN ('-', '–', 'to') THEN [] WHEN coalesce(joined, false) AND try_cast(x AS INT) > try_cast(low AS INT) AND try_cast(x AS INT) - try_cast(low AS INT) <= 20 THEN list_transform(range(try_cast(low AS INT) + 1, try_cast(x AS INT) + 1), lambda v: v::VARCHAR)
  WHEN coalesce(joined, false) THEN [low || '-' || x] WHEN coalesce(opens, false) AND high IS NOT NULL AND NOT coalesce(try_cast(high AS INT) > try_cast(x AS INT) AND try_cast(high AS INT) - try_cast(x AS INT) <= 20, false) THEN [] ELSE [x] END AS l FROM k)
SELECT p_partkey, array_to_string(flatten(list(l ORDER BY i)), ',') AS sections FROM o GROUP BY p_partkey""")
def section_lists(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_partkey") % 4
    sign = F.when(kind == 0, ", ").when(kind == 1, " to ").when(kind == 2, "-").otherwise(" & ")
    text = F.concat(size.cast("string"), sign, (size + F.col("p_partkey") % 30).cast("string"), F.lit(" and "), size.cast("string"), F.lit("-A, 9A(1) of "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.expand_sections(text), ",").alias("sections"))


@query(r"""WITH b AS (SELECT c_custkey, 'Hon''ble Mr. Justice ' || c_name || '; Dr. B.' || c_nationkey || ', J.; MR. ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' ; Shri ' || c_name ELSE '' END AS bench, CASE c_custkey % 3 WHEN 0 THEN 'Mr. ' WHEN 1 THEN 'Smt. Dr. ' ELSE '' END || c_name || CASE c_custkey % 4 WHEN 0 THEN ', Sr. Adv.' WHEN 1 THEN ' Advocate' WHEN 2 THEN ', AOR' ELSE '' END AS counsel FROM customer),
j AS (SELECT c_custkey, counsel, list_filter(list_transform(string_split(bench, ';'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '(?i)^(?:(?:hon''?ble|the|mr|mrs|ms|dr|justice|shri|smt|chief)\.?\s+)+', ''), '(?i),?\s*\b(?:JJ?|CJI?)\.?\s*$', ''), '^[.,\s]+|[.,\s]+$', '', 'g'))), lambda x: x <> '') AS l FROM b)
SELECT c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS judges, regexp_replace(regexp_replace(counsel, '^(?:(?:Mr|Smt|Dr)\. )+', ''), '(?:,? (?:Sr\.|Adv\.|Advocate|AOR))+$', '') AS counsel FROM j""")
def name_parsing(spark, sf_dir):
    name, key = F.col("c_name"), F.col("c_custkey")
    bench = F.concat(F.lit("Hon'ble Mr. Justice "), name, F.lit("; Dr. B."), F.col("c_nationkey").cast("string"), F.lit(", J.; MR. "), "c_mktsegment", F.when(key % 2 == 0, F.concat(F.lit(" ; Shri "), name)).otherwise(""))
    before = F.when(key % 3 == 0, "Mr. ").when(key % 3 == 1, "Smt. Dr. ").otherwise("")
    after = F.when(key % 4 == 0, ", Sr. Adv.").when(key % 4 == 1, " Advocate").when(key % 4 == 2, ", AOR").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tx.parse_judges(bench), "|").alias("judges"), tx.normalize_counsel(F.concat(before, name, after)).alias("counsel"))


TREATMENT_TEXT = "text || ' was ' || ['followed', 'not followed and then applied', 'stood overruled', 'upheld', 'doubted', 'explained'][doc_id % 6 + 1] || ' in ' || source"
_REST = f"regexp_replace(text, '{dict((n, p) for n, p, _ in tx.TREATMENTS)['not_followed']}', ' ', 'g')"


def _treated():
    said = F.element_at(F.array(*map(F.lit, ["followed", "not followed and then applied", "stood overruled", "upheld", "doubted", "explained"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return F.concat("text", F.lit(" was "), said, F.lit(" in "), "source")


@query(f"""WITH t AS (SELECT doc_id, {TREATMENT_TEXT} AS text FROM documents)
SELECT doc_id, array_to_string([x FOR x IN [{", ".join(f"CASE WHEN regexp_matches({_REST if name == 'followed' else 'text'}, '{pattern}') THEN '{name}:' || len(regexp_extract_all({_REST if name == 'followed' else 'text'}, '{pattern}')) END" for name, pattern, _ in tx.TREATMENTS)}] IF x IS NOT NULL], ',') AS treatments, regexp_matches(text, '{tx.TREATMENTS[0][1]}') AS overruling FROM t""")
def treatment_detection(spark, sf_dir):
    found = F.transform(tx.treatments(_treated()), lambda x: F.concat_ws(":", x["treatment"], x["n"].cast("string")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("treatments"), tx.is_overruling(_treated()).alias("overruling"))


@query(f"""WITH t AS (SELECT doc_id, {TREATMENT_TEXT} AS text, ' in ' || source AS needle FROM documents),
near AS (SELECT doc_id, instr(text, needle) AS pos, substr(text, greatest(1, instr(text, needle) - 60), least(instr(text, needle) - 1, 60) + length(needle) + 60) AS text FROM t),
k AS (SELECT doc_id, pos, [{", ".join(f"CASE WHEN regexp_matches({_REST if name == 'followed' else 'text'}, '{pattern}') THEN {sure} ELSE 0.0 END" for name, pattern, sure in tx.TREATMENTS)}] AS s FROM near)
SELECT doc_id, CASE WHEN pos > 0 AND list_max(s) > 0 THEN [{", ".join(f"'{n}'" for n, _, _ in tx.TREATMENTS)}][list_position(s, list_max(s))] END AS treatment FROM k""")
def treatment_in_window(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.best_treatment(_treated(), F.concat(F.lit(" in "), "source"), 60)["treatment"].alias("treatment"))


@query(r"""WITH q AS (SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS x, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS p, trim(regexp_replace(lower(CASE WHEN doc_id % 2 = 0 THEN substr(text, 20, 60) ELSE substr(text, 1, 50) || ' other words' END), '\s+', ' ', 'g')) AS q FROM documents)
SELECT doc_id, CASE WHEN q = '' OR p = '' THEN false ELSE contains(p, q) OR len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(p, ' ')))) / greatest(len(list_distinct(string_split(q, ' '))), 1) >= 0.85
  OR (length(q) >= 3 AND len(list_intersect(list_distinct([substr(q, i::BIGINT, 3) FOR i IN range(1, length(q) - 1)]), list_distinct([substr(p, i::BIGINT, 3) FOR i IN range(1, length(p) - 1)]))) / greatest(len(list_distinct([substr(q, i::BIGINT, 3) FOR i IN range(1, length(q) - 1)])), 1) >= 0.85) END AS found FROM q""")
def fuzzy_quotes(spark, sf_dir):
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 20, 60)).otherwise(F.concat(F.substring("text", 1, 50), F.lit(" other words")))
    return docs(spark, sf_dir).select("doc_id", tx.fuzzy_match(quote, F.col("text")).alias("found"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(flatten([[substr('  ' || w || ' ', i::BIGINT, 3) FOR i IN range(1, length(w) + 2)] FOR w IN regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+') IF w <> ''])) AS g FROM part),
q AS (SELECT list_distinct(flatten([[substr('  ' || w || ' ', i::BIGINT, 3) FOR i IN range(1, length(w) + 2)] FOR w IN ['part', '11']])) AS g)
SELECT p_partkey, round(len(list_intersect(w.g, q.g)) / len(list_distinct(w.g || q.g)), 4) AS similarity FROM w, q ORDER BY similarity DESC, p_partkey LIMIT 5""")
def trigram_title(spark, sf_dir):
    scored = table(spark, sf_dir, "part").select("p_partkey", F.round(tx.trigram_similarity("p_name", F.lit("part 11")), 4).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "p_partkey").limit(5)


@query("""SELECT doc_id, list_reduce(list_concat([0], [length(x) FOR x IN string_split(text, chr(10))]), lambda a, b: greatest(a, b))::INT AS longest_line, len(string_split(text, chr(10)))::INT AS lines FROM documents""")
def line_shape(spark, sf_dir):
    lengths = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    return docs(spark, sf_dir).select("doc_id", F.array_max(lengths).alias("longest_line"), F.size(lengths).alias("lines"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 50")
def json_access(spark, sf_dir):
    parsed = tx.safe_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("k")).where("k > 50")


@query("""SELECT o_orderkey, o_orderdate::DATE AS d FROM orders""")
def date_formats(spark, sf_dir):
    day = F.to_date("o_orderdate")
    text = F.element_at(F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.parse_date(text).alias("d"))


@query(r"""WITH f AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations)
SELECT conv_id, turn, coalesce(text = previous, false) AS repeated FROM f""")
def previous_row(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.col("text") == before, F.lit(False)).alias("repeated"))


#: A reference put into each document, by its number; what it means stands in the SQL, which knows no pattern.
REFERENCE = """CASE doc_id % 4 WHEN 0 THEN ' under Sections ' || doc_id || ', ' || (doc_id + 1) || 'A and ' || (doc_id + 2) || '(1) read with Section ' || (doc_id + 3) || ' IPC. '
  WHEN 1 THEN ' Articles ' || (doc_id % 300 + 1) || ' to ' || (doc_id % 300 + 3) || '; Order ' || (doc_id % 50 + 1) || ' Rules ' || (doc_id % 20 + 1) || ' and ' || (doc_id % 20 + 2) || ' CPC. '
  WHEN 2 THEN ' u/s ' || doc_id || ' of the Water Supply Act, 1974, r. ' || (doc_id + 5) || ' of it. ' ELSE ' Section of Article and Order. ' END"""


@query(f"""SELECT doc_id, array_to_string(CASE doc_id % 4
  WHEN 0 THEN ['Indian Penal Code: Section ' || doc_id, 'Indian Penal Code: Section ' || (doc_id + 1) || 'A', 'Indian Penal Code: Section ' || (doc_id + 2) || '(1)', 'Indian Penal Code: Section ' || (doc_id + 3)]
  WHEN 1 THEN ['Constitution of India: Article ' || (doc_id % 300 + 1), 'Constitution of India: Article ' || (doc_id % 300 + 2), 'Constitution of India: Article ' || (doc_id % 300 + 3), 'Code of Civil Procedure: Order ' || (doc_id % 50 + 1) || ' Rule ' || (doc_id % 20 + 1), 'Code of Civil Procedure: Order ' || (doc_id % 50 + 1) || ' Rule ' || (doc_id % 20 + 2)]
  WHEN 2 THEN ['Water Supply Act: Section ' || doc_id, '?: Rule ' || (doc_id + 5)] ELSE [] END, '|') AS provisions FROM documents""")
def statute_provisions(spark, sf_dir):
    """The provisions that whole texts name, with one reference put in front of each."""
    found = pv.statute_references(F.concat(F.expr(REFERENCE), F.coalesce("text", F.lit(""))))
    said = F.transform(found, lambda x: F.concat(F.coalesce(x["act"], F.lit("?")), F.lit(": "), x["provision"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(said, "|").alias("provisions"))
