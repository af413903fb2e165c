"""Sources, sinks, sections and row checks over the driver's tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import records as rc
from quern.functions import scores as sc
from quern.functions import text as tx
from quern.operators import graph as gr
from quern.operators import joins as jo
from quern.operators import quality as qa
from quern.operators.sections import chunk_documents, drop_repeated_lines, merge_short, section_map, strip_leading_bleed
from quern.plans.registry import query
from quern.sources import tables as so
from quern.sources.tables import table
from quern.storage import shared_dir


@query("SELECT p_partkey, p_name, coalesce(CASE WHEN isnan(p_retailprice) THEN NULL ELSE p_retailprice END, 0) AS price, p_name AS key FROM part")
def metadata_scan(spark, sf_dir):
    rows = so.read_metadata(spark, f"{sf_dir}/part.parquet", key=("p_name", "p_partkey"))
    return rows.select("p_partkey", "p_name", F.coalesce("p_retailprice", F.lit(0.0)).alias("price"), "key")


@query("SELECT doc_id, lang, n_chars, sha256(text) AS text_hash FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read back."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    so.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"), path)
    return so.read_json_lines(spark, path, "doc_id long, lang string, n_chars long, text string").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_hash"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, sum(o_custkey) AS keys FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1")
def one_partition(spark, sf_dir):
    """Orders written by year, of which one year's folder is read."""
    path = f"{shared_dir(spark)}/years-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).repartition("year").write.partitionBy("year").parquet(path)
    return so.read_partition(spark, path, 1995).groupBy("year").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("SELECT s_suppkey::VARCHAR AS number, s_name AS title, 'supplier' AS kind FROM supplier UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE p_size::VARCHAR END, p_name, 'part' FROM part")
def record_adapters(spark, sf_dir):
    """Records of two shapes written as JSON and read by aliases of their fields."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("no"), F.col("s_name").alias("title")).write.json(f"{path}/a")
    table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("number"), F.col("p_size").alias("section"), F.col("p_name").alias("name")).write.json(f"{path}/b")
    names = {"number": ("number", "no", "section"), "title": ("title", "name")}
    parts = [so.read_records(spark, f"{path}/{x}", names, lines=True).withColumn("kind", F.lit(kind)) for x, kind in (("a", "supplier"), ("b", "part"))]
    return so.union_sources(parts)


@query("SELECT conv_id, (turn + 1)::VARCHAR AS section_number, trim(replace(text, chr(10), ' ')) AS section_text FROM conversations")
def statute_sections(spark, sf_dir):
    """Numbered sections put together from turns and taken apart again."""
    one = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.replace("text", F.lit("\n"), F.lit(" ")))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", one.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return so.split_sections(texts).select("conv_id", "section_number", "section_text")


@query("""WITH f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || '_EN' WHEN 2 THEN 'copy of ' || c_name || ' scanned' ELSE 'nothing ' || c_custkey END AS stem FROM customer)
SELECT c_custkey, stem, CASE WHEN c_custkey % 4 < 3 THEN (SELECT min(m.c_name) FROM customer m WHERE CASE WHEN c_custkey % 4 < 2 THEN m.c_name = f.stem OR m.c_name || '_EN' = f.stem ELSE contains(f.stem, m.c_name) END) END AS meta_key, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS tier FROM f""")
def file_match(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    kind, name = F.col("c_custkey") % 4, F.col("c_name")
    stem = F.when(kind == 0, name).when(kind == 1, F.concat(name, F.lit("_EN"))).when(kind == 2, F.concat(F.lit("copy of "), name, F.lit(" scanned"))).otherwise(F.concat(F.lit("nothing "), F.col("c_custkey").cast("string")))
    return so.match_files(rows.select("c_custkey", stem.alias("stem")), rows.select(name.alias("key"))).select("c_custkey", "stem", "meta_key", "tier")


@query("""SELECT vec_id, label BETWEEN 1 AND 500 AND len(embedding) = 64 AND label = 1 AND label % 3 > 0 AS passed,
  array_to_string([x FOR x IN [CASE WHEN label = 0 THEN 'no_pieces' END, CASE WHEN label <> 1 THEN 'vector_count' END, CASE WHEN len(embedding) <> 64 THEN 'dimension' END, CASE WHEN label % 3 = 0 THEN 'no_title' END] IF x IS NOT NULL], ',') AS failures FROM embeddings""")
def row_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    pieces = F.array_repeat(F.lit("piece"), F.col("label").cast("int"))
    return qa.row_gate(rows, "vec_id", pieces, F.array("embedding"), F.when(F.col("label") % 3 != 0, F.lit("t")), 64)


@query()
def stable_sample(spark, sf_dir):
    """Fifty rows by the smallest hashes; sampling is the feature. XXH64 with Spark's seed has no SQL elsewhere."""
    return qa.stable_sample(table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id", "lang")


@query("""WITH t(name, ord, word) AS (VALUES ('money', 0, 'BUILDING'), ('money', 0, 'AUTOMOBILE'), ('home', 1, 'HOUSEHOLD'), ('home', 1, 'FURNITURE')), w AS (SELECT c_nationkey, c_mktsegment AS word, count(*) AS n FROM customer GROUP BY ALL),
hit AS (SELECT c_nationkey, name, ord, count(*) AS k FROM w JOIN t USING (word) GROUP BY ALL), named AS (SELECT c_nationkey, arg_max(name, (k, -ord)) AS name FROM hit GROUP BY 1),
top AS (SELECT c_nationkey, string_agg(word, ' / ' ORDER BY word) AS other FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, word) AS r FROM w) WHERE r <= 2 GROUP BY 1)
SELECT c_nationkey, coalesce(name, other) AS name FROM top LEFT JOIN named USING (c_nationkey)""")
def community_labels(spark, sf_dir):
    triggers = spark.createDataFrame([("money", 0, "BUILDING"), ("money", 0, "AUTOMOBILE"), ("home", 1, "HOUSEHOLD"), ("home", 1, "FURNITURE")], "name string, ord int, word string")
    return gr.label_groups(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", triggers)


@query("""WITH l AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_name END AS name, c_mktsegment AS segment FROM customer), r AS (SELECT o_custkey AS c_custkey, 'order ' || max(o_orderkey) AS name FROM orders GROUP BY 1)
SELECT l.c_custkey, CASE WHEN l.name IS NULL OR trim(l.name) = '' THEN r.name ELSE l.name END AS name, segment FROM l LEFT JOIN r USING (c_custkey)""")
def fill_missing(spark, sf_dir):
    key = F.col("c_custkey")
    left = table(spark, sf_dir, "customer").select(key, F.when(key % 3 == 0, F.lit(None).cast("string")).when(key % 3 == 1, "  ").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("order "), F.max("o_orderkey").cast("string")).alias("name"))
    return jo.fill_missing(left, right, "c_custkey", ["name"])


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0")
def enrich_hits(spark, sf_dir):
    details = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return jo.enrich(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), details, "o_custkey")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def enrich_or_keep(spark, sf_dir):
    details = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return jo.enrich(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), details, "o_custkey", keep_unmatched=True)


@query("""WITH k AS (SELECT doc_id, text, ['rights of all', 'no', 'licensed apache', lang || source] AS words FROM documents)
SELECT doc_id, array_to_string(list_filter(words, lambda k: len(list_filter(string_split(lower(k), ' '), lambda w: length(w) >= 4 AND contains(lower(text), w))) > 0), '|') AS grounded FROM k""")
def grounded_words(spark, sf_dir):
    words = F.array(F.lit("rights of all"), F.lit("no"), F.lit("licensed apache"), F.concat("lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sc.grounded(words, F.col("text")), "|").alias("grounded"))


@query(r"""WITH k AS (SELECT doc_id, upper(substr(text, 1, 300)) AS head, ['A. Rights J', 'the licensed one', 'B. C', source] AS names FROM documents),
l AS (SELECT doc_id, head, list_transform(names, lambda n: {'n': n, 'w': list_filter(regexp_split_to_array(upper(n), '[^\p{L}]+'), lambda w: length(w) >= 4)}) AS names FROM k)
SELECT doc_id, array_to_string(list_transform(list_filter(names, lambda x: len(x.w) > 0 AND contains(head, list_reduce(list_prepend('', x.w), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END))), lambda x: x.n), '|') AS kept FROM l""")
def header_names(spark, sf_dir):
    names = F.array(F.lit("A. Rights J"), F.lit("the licensed one"), F.lit("B. C"), F.col("source"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(sc.in_header(names, F.col("text"), 300), "|").alias("kept"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[\[\]\n]', ' ', 'g') AS body FROM documents WHERE length(text) > 40)
SELECT doc_id, substr(body, 1, 30) || '[1] (' || trim('note ' || doc_id) || ')' || substr(body, 31) || chr(10) AS text FROM t""")
def footnotes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("length(text) > 40").select("doc_id", F.regexp_replace("text", r"[\[\]\n]", " ").alias("body"))
    text = F.concat(F.substring("body", 1, 30), F.lit("[1]"), F.substring("body", 31, 1 << 30), F.lit("\n[1] note "), F.col("doc_id").cast("string"))
    return rows.select("doc_id", rc.inline_footnotes(text).alias("text"))


@query("SELECT o_orderkey, replace(replace(replace('STATE ' || CASE o_orderkey % 3 WHEN 0 THEN '0F' WHEN 1 THEN '1N' ELSE 'T0' END || ' ' || o_orderpriority || ' 0FX', ' 0F ', ' OF '), ' 1N ', ' IN '), ' T0 ', ' TO ') AS title FROM orders")
def title_repairs(spark, sf_dir):
    word = F.when(F.col("o_orderkey") % 3 == 0, "0F").when(F.col("o_orderkey") % 3 == 1, "1N").otherwise("T0")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.fix_title_ocr(F.concat(F.lit("STATE "), word, F.lit(" "), "o_orderpriority", F.lit(" 0FX"))).alias("title"))


@query(r"""SELECT doc_id, min(n)::INT AS least, max(n)::INT AS most FROM (SELECT doc_id, unnest(CASE WHEN len(m) = 0 THEN [NULL] ELSE m END)::INT AS n FROM (SELECT doc_id, regexp_extract_all(doc_id % 50 || '. ' || text || chr(10) || '(' || n_chars || ') end', '(?m)^\s*(?:[(\[]|Para\.?\s*)?(\d{1,9})[.)\]]?\s', 1) AS m FROM documents)) GROUP BY doc_id""")
def paragraph_ranges(spark, sf_dir):
    text = F.concat((F.col("doc_id") % 50).cast("string"), F.lit(". "), "text", F.lit("\n("), F.col("n_chars").cast("string"), F.lit(") end"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.paragraph_range(text).alias("r")).select("doc_id", "r.least", "r.most")


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' x–y' || chr(10) || 'Page 3 of 9' || chr(10) || chr(10) || chr(10) || 'z', '[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '(?m)^[ \t]*(?:[Pp]age[ \t]+)?\d{1,4}(?:[ \t]+of[ \t]+\d{1,4})?[ \t]*$', '', 'g'), '(\w)[\x{2013}\x{2014}](\w)', '\1-\2', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS clean_hash FROM documents""")
def cleaned_texts(spark, sf_dir):
    text = F.concat("text", F.lit(" x–y\nPage 3 of 9\n\n\nz"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.clean_text(text), 256).alias("clean_hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE 1900 END::INT AS year, CASE WHEN o_orderkey % 7 >= 5 THEN 'constitutional' WHEN o_orderkey % 7 = 4 THEN 'full' WHEN o_orderkey % 7 IN (2, 3) THEN 'division' WHEN o_orderkey % 7 = 1 THEN 'single' ELSE 'named' END AS bench_type FROM orders")
def cross_field_fixes(spark, sf_dir):
    key = F.col("o_orderkey")
    year = F.when(key % 3 != 0, 1900)
    day = F.when(key % 2 == 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *sc.fix_record(year, day, F.lit("named"), key % 7))


@query("""SELECT o_orderkey, round(least(1, greatest(0, CASE WHEN o_orderkey % 11 = 0 THEN b * 0.3 ELSE b END / (1 + greatest(0, 2000 - year(o_orderdate)) / 10) * CASE WHEN o_orderstatus = 'F' THEN 1.1 ELSE 1 END)), 6)::DOUBLE AS strength
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN {BINDING} WHEN 1 THEN {PERSUASIVE} ELSE 0.4 END AS b FROM orders)""".format(**{k: sc.STRENGTHS.get(k, 0.4) for k in ("BINDING", "PERSUASIVE")}))
def effective_strengths(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.when(key % 3 == 0, "BINDING").when(key % 3 == 1, "PERSUASIVE").otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(sc.effective_strength(said, key % 11 == 0, F.year("o_orderdate"), F.col("o_orderstatus") == "F", 2000), 6).alias("strength"))


@query()
def section_bodies(spark, sf_dir):
    """Sections of texts with headings put in; the chunker has no SQL, tests hold its spans against the whole texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Preamble\nFACTS\n"), "text", F.lit("\nORDER\nThe appeal is allowed.")).alias("text"))
    return section_map(rows).select("doc_id", "section", F.length("body").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))) > 0")
def chunk_coverage(spark, sf_dir):
    """The chunks of each text cover it: how many characters lie in one or more of them."""
    rows = chunk_documents(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["to"]))).alias("n")), lambda a: a["n"])
    return rows.select("doc_id", covered.alias("n"))


@query(r"""WITH t AS (SELECT doc_id, text || chr(10) || CASE doc_id % 2 WHEN 0 THEN 'IN THE SUPREME COURT OF INDIA' ELSE '  Reportable' END || ' ' || source AS text FROM documents),
p AS (SELECT doc_id, text, instr(substr(text, 1, 400), regexp_extract(substr(text, 1, 400), '(?im)^[ \t]*(?:IN THE (?:SUPREME|HIGH) COURT|REPORTABLE\b|NON-?REPORTABLE\b|(?:CIVIL|CRIMINAL) (?:APPELLATE|ORIGINAL) JURISDICTION)')) AS pos, regexp_matches(substr(text, 1, 400), '(?im)^[ \t]*(?:IN THE (?:SUPREME|HIGH) COURT|REPORTABLE\b|NON-?REPORTABLE\b|(?:CIVIL|CRIMINAL) (?:APPELLATE|ORIGINAL) JURISDICTION)') AS hit FROM t)
SELECT doc_id, sha256(CASE WHEN hit AND pos > 100 THEN substr(text, pos) ELSE text END) AS text_hash FROM p""")
def leading_bleed(spark, sf_dir):
    text = F.concat("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "IN THE SUPREME COURT OF INDIA").otherwise("  Reportable"), F.lit(" "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(strip_leading_bleed(text, 400), 256).alias("text_hash"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
c AS (SELECT doc_id, trim(line) AS bare, count(*) AS times, min(n) AS first FROM l WHERE trim(line) <> '' AND length(line) < 200 GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY n)) AS text_hash FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.bare = trim(line) WHERE times IS NULL OR length(line) >= 200 OR n = first GROUP BY l.doc_id""".replace("SELECT doc_id, sha256(string_agg", "SELECT l.doc_id, sha256(string_agg"))
def repeated_line_removal(spark, sf_dir):
    return drop_repeated_lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("""WITH s AS (SELECT conv_id, turn, text, CASE WHEN length(text) >= 100 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM s) SELECT conv_id, min(turn) AS turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, part""")
def short_section_merge(spark, sf_dir):
    return merge_short(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")
