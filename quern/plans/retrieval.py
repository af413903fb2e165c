"""Retrieval and graph queries over the driver's tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph as gr
from quern.operators import search as se
from quern.plans.registry import query
from quern.sources.tables import table

QUERY_ID, DIM = 7, 64
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where(F.col("vec_id") == QUERY_ID).first().embedding


@query(f"SELECT a.vec_id, a.label, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {QUERY_ID} ORDER BY score DESC, a.vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    return se.nearest(vectors, asked, 10)


@query(f"SELECT a.vec_id, a.label, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {QUERY_ID} AND a.label IN (2, 4) ORDER BY score DESC, a.vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    return se.nearest(vectors, asked, 10, F.col("label").isin(2, 4))


@query(f"WITH s AS (SELECT a.vec_id, a.label, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {QUERY_ID} ORDER BY score DESC, a.vec_id LIMIT 100) SELECT label, arg_max(vec_id, (score, -vec_id)) AS vec_id, max(score) AS score FROM s GROUP BY label")
def chunk_rollup(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    return se.roll_up(se.nearest(vectors, asked, 100), "label", "vec_id")


@query(f"SELECT a.vec_id, a.label, round(round({COS}, 6), 4) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {QUERY_ID} AND a.vec_id <> {QUERY_ID} ORDER BY round({COS}, 6) DESC, a.vec_id LIMIT 5")
def similar_items(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    return se.nearest(vectors, asked, 5, F.col("vec_id") != QUERY_ID).withColumn("score", F.round("score", 4))


@query(f"SELECT b.vec_id AS query, a.vec_id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({COS}, 6) DESC, a.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 QUALIFY rank <= 5")
def batch_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return se.batch_nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query(f"SELECT a.vec_id, a.label, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {QUERY_ID} AND round({COS}, 6) >= 0.92 ORDER BY score DESC, a.vec_id LIMIT 1")
def semantic_cache_hit(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    return se.cache_hit(vectors, asked)


@query(f"SELECT a.vec_id, round({COS}, 6) AS score, CASE WHEN round({COS}, 6) < 0.5 THEN 'misrepresented' WHEN round({COS}, 6) < 0.75 THEN 'partially_accurate' ELSE 'accurate' END AS verdict FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def holding_verification(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return se.verify_holding(vectors.join(other, "vec_id"), "embedding", "other").select("vec_id", "score", "verdict")


TERMS = ["the", "licensed", "que"]
POSTED = r"posted AS (SELECT doc_id, term, count(*) / 10 AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL)"


@query(f"WITH {POSTED} SELECT doc_id, sum(round(weight * 10)::BIGINT) / 10 AS score FROM posted WHERE term IN ('the', 'licensed', 'que') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def fts_weighted(spark, sf_dir):
    posted = se.postings(table(spark, sf_dir, "documents"), "doc_id", {"text": "D"})
    return se.rank_terms(posted, "doc_id", TERMS)


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id FROM w WHERE (list_contains(w, 'license') OR list_contains(w, 'rights')) AND NOT list_contains(w, 'apache') AND contains(' ' || array_to_string(w, ' ') || ' ', ' all rights reserved ')""")
def fts_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(se.matches("text", 'license OR rights -apache "all rights reserved"')).select("doc_id")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
hits AS (SELECT doc_id, i, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN ('all', 'rights', 'reserved')),
last AS (SELECT doc_id, i, max(CASE WHEN term = 'all' THEN i END) OVER o AS a, max(CASE WHEN term = 'rights' THEN i END) OVER o AS b, max(CASE WHEN term = 'reserved' THEN i END) OVER o AS c FROM hits WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ends AS (SELECT doc_id, least(a, b, c) AS began, min(i) AS i FROM last WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY ALL)
SELECT doc_id, round(sum(1.0::DOUBLE / (i - began + 1)), 9) AS score FROM ends GROUP BY doc_id""")
def fts_cover_density(spark, sf_dir):
    return se.cover_density(table(spark, sf_dir, "documents"), "doc_id", "text", ["all", "rights", "reserved"])


def stem_sql(words: str) -> str:
    """A list of words without English inflection."""
    chain = "x"
    for pattern, said in se.STEM_STEPS:
        chain = f"regexp_replace({chain}, '{pattern}', '\\{said}')"
    return f"list_transform({words}, lambda x: CASE WHEN regexp_matches(x, '{se.STEM_END}') THEN {chain} ELSE x END)"


WORDS_SQL = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
STOP_SQL = ", ".join(f"'{w}'" for w in se.STOP_WORDS)


def lexemes_sql(text: str, english: str = "true") -> str:
    words = WORDS_SQL.format(text)
    return f"CASE WHEN {english} THEN {stem_sql(f'list_filter({words}, lambda x: x NOT IN ({STOP_SQL}))')} ELSE {words} END"


FIELDS = {"source": "A", "lang": "B", "head": "C", "text": "D"}
LINE = "licensed rights reserving the warranties"


def _fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("head", F.substring("text", 1, 100))


@query(f"""WITH d AS (SELECT *, substr(text, 1, 100) AS head FROM documents),
terms AS ({' UNION ALL '.join(f"SELECT doc_id, unnest({lexemes_sql(c, 'lang = ' + chr(39) + 'en' + chr(39))}) AS term, {round(se.WEIGHTS[k] * 10)} AS w FROM d" for c, k in FIELDS.items())}),
asked AS (SELECT unnest({lexemes_sql(f"'{LINE}'")}) AS term)
SELECT doc_id, sum(w) / 10 AS score FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def fts_fields_stemmed(spark, sf_dir):
    posted = se.postings(_fields(spark, sf_dir), "doc_id", FIELDS, F.col("lang") == "en")
    return se.rank_terms(posted, "doc_id", se.query_lexemes(spark, LINE), 50)


@query(f"""SELECT doc_id, array_to_string({lexemes_sql('text', "lang = 'en'")}, ' ') AS lexemes FROM documents""")
def text_lexemes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(se.lexemes("text", F.col("lang") == "en"), " ").alias("lexemes"))


@query(f"""WITH s AS (SELECT doc_id, unnest(range(len(p)))::INT AS section, unnest(p) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE lang = 'en')),
w AS (SELECT *, list_filter({lexemes_sql('content')}, lambda x: x IN ('right', 'reserv')) AS hits FROM s)
SELECT doc_id, section, len(hits)::INT AS score, substr(content, 1, 500) AS snippet FROM w WHERE len(list_distinct(hits)) = 2 ORDER BY score DESC, doc_id, section LIMIT 20""")
def section_search(spark, sf_dir):
    sections = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("section", "content"))
    return se.section_search(sections, ["doc_id", "section"], "content", se.query_lexemes(spark, "rights reserved"), F.col("lang") == "en")


@query(f"""WITH fts AS (SELECT p_name AS title, p_partkey AS id, 0 AS list FROM part WHERE list_has_all({lexemes_sql('p_name')}, ['blue']) ORDER BY p_partkey LIMIT 10),
near AS (SELECT p_name AS title, p_partkey AS id, 1 AS list FROM part WHERE p_size = 7 ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
SELECT title, id, list FROM (SELECT * FROM fts UNION ALL SELECT * FROM near) QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY list, title, id) = 1""")
def statute_search(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    words = part.where(F.array_contains(se.lexemes("title"), "blue")).orderBy("id").limit(10).select("title", "id")
    near = part.where("p_size = 7").orderBy(F.desc("p_retailprice"), "id").limit(10).select("title", "id")
    return se.merge_by_title([words, near], "title")


@query(f"SELECT a.vec_id, CASE a.label WHEN 1 THEN 'ratio' WHEN 2 THEN 'headnote' ELSE 'chunk' END AS kind, round(round({COS}, 6) * CASE WHEN a.label IN (1, 2) THEN 1.5 ELSE 1 END, 9) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {QUERY_ID} ORDER BY round({COS}, 6) DESC, a.vec_id LIMIT 100")
def proposition_boost(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    hits = se.nearest(vectors, asked, 100).select("vec_id", F.when(F.col("label") == 1, "ratio").when(F.col("label") == 2, "headnote").otherwise("chunk").alias("kind"), "score")
    return se.boost_kinds(hits, "kind").withColumn("score", F.round("score", 9))


@query("""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS title, substr(text, 1, 50) AS chunk FROM documents WHERE doc_id % 3 <> 1), w AS (SELECT doc_id, substr(text, 1, 20) AS snippet FROM documents WHERE doc_id % 3 <> 2)
SELECT doc_id, CASE WHEN trim(coalesce(snippet, '')) <> '' THEN snippet WHEN trim(coalesce(title, '')) <> '' THEN title WHEN trim(coalesce(chunk, '')) <> '' THEN chunk ELSE '' END AS snippet FROM w FULL JOIN v USING (doc_id)""")
def snippet_precedence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.where("doc_id % 3 <> 2").select("doc_id", F.substring("text", 1, 20).alias("snippet"))
    vectors = docs.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("title"), F.substring("text", 1, 50).alias("chunk"))
    return se.best_snippet(words, vectors, "doc_id")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN regexp_replace(regexp_extract(text, '(?is)((?:\S+\s+){0,3}\b(?:the)\b(?:\s+\S+){0,4})', 1), '(?i)\b(the)\b', '**\1**', 'g') ELSE substr(text, 1, 500) END AS headline FROM documents""")
def fts_headline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", se.headline("text", ["the"], 3, 4).alias("headline"))


LISTS = f"""{POSTED}, fts AS (SELECT doc_id AS id, sum(round(weight * 10)::BIGINT) AS s FROM posted WHERE term IN ('the', 'licensed', 'que') GROUP BY 1 ORDER BY s DESC, id LIMIT 20),
vec AS (SELECT a.vec_id AS id, round({COS}, 6) AS s FROM embeddings a, embeddings b WHERE b.vec_id = {QUERY_ID} ORDER BY s DESC, id LIMIT 20),
ranks AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r, 2.0 AS w FROM fts UNION ALL SELECT id, row_number() OVER (ORDER BY s DESC, id), 1.0 FROM vec),
merged AS (SELECT id, round(sum(w::DOUBLE / (30 + r)), 9) AS score FROM ranks GROUP BY id)"""


def _merged(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    of_vectors, of_words, k = se.STRATEGIES["keyword_heavy"]
    words = fts_weighted(spark, sf_dir).select(F.col("doc_id").alias("id"), "score")
    near = se.nearest(vectors, asked, 20).select(F.col("vec_id").alias("id"), "score")
    return se.fuse([se.ranked(words, "words", "id"), se.ranked(near, "vectors", "id")], "id", k, [of_words, of_vectors])


@query(f"WITH {LISTS} SELECT * FROM merged")
def rrf_weighted(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(f"WITH {LISTS} SELECT id, round(score * (1 + coalesce(n_chars / 100.0, 0) / 500), 9) AS score FROM merged LEFT JOIN documents ON id = doc_id")
def signal_boost(spark, sf_dir):
    signals = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 100.0).alias("signal"))
    return se.boost(_merged(spark, sf_dir), signals, "id")


@query(f"WITH {LISTS} SELECT id, score, (SELECT count(*) FROM merged) AS total FROM merged ORDER BY score DESC, id LIMIT 10 OFFSET 10")
def hybrid_page(spark, sf_dir):
    return se.paged(_merged(spark, sf_dir), "id", page=2, size=10)


# The citation graph: a customer cites the customer of the next order.
TREATMENT = {"1-URGENT": "overruled", "2-HIGH": "followed", "3-MEDIUM": None, "4-NOT SPECIFIED": "distinguished", "5-LOW": "applied"}
CITES_SQL = """cites AS (SELECT a.o_custkey AS src, b.o_custkey AS dst, a.o_orderkey AS ord, CASE a.o_orderpriority WHEN '1-URGENT' THEN 'overruled' WHEN '2-HIGH' THEN 'followed' WHEN '4-NOT SPECIFIED' THEN 'distinguished' WHEN '5-LOW' THEN 'applied' END AS treatment
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey)"""
NODES_SQL = "nodes AS (SELECT c_custkey AS id, (1990 + c_custkey % 10)::INT AS year FROM customer)"


def cites(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kind = F.lit(None).cast("string")
    for priority, said in TREATMENT.items():
        if said:
            kind = F.when(F.col("o_orderpriority") == priority, said).otherwise(kind)
    a = orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("ord"), kind.alias("treatment"), (F.col("o_orderkey") + 1).alias("next"))
    b = orders.select(F.col("o_orderkey").alias("next"), F.col("o_custkey").alias("dst"))
    return a.join(b, "next").where("src <> dst").select("src", "dst", "ord", "treatment")


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (1990 + F.col("c_custkey") % 10).cast("int").alias("year"))


def _seed(spark, value=1):
    return spark.range(1).select(F.lit(value).cast("long").alias("seed"))


BOTH_SQL = "both_ways AS (SELECT src, dst FROM cites UNION SELECT dst, src FROM cites)"


@query(f"""WITH RECURSIVE {CITES_SQL}, {BOTH_SQL}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 3)
SELECT 1::BIGINT AS seed, node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def khop(spark, sf_dir):
    return gr.k_hop(cites(spark, sf_dir), _seed(spark), 3)


@query(f"""WITH RECURSIVE {CITES_SQL}, {BOTH_SQL}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 2), near AS (SELECT DISTINCT node FROM walk)
SELECT DISTINCT src, dst FROM cites WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)""")
def neighbourhood_edges(spark, sf_dir):
    edges = cites(spark, sf_dir)
    return gr.induced(edges, gr.k_hop(edges, _seed(spark), 2))


@query(f"""WITH RECURSIVE {CITES_SQL}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN cites ON src = node WHERE depth < 4)
SELECT DISTINCT src, dst FROM cites WHERE src IN (SELECT node FROM walk)""")
def citation_chain(spark, sf_dir):
    return gr.chain(cites(spark, sf_dir), 1, 5)


@query(f"""WITH RECURSIVE {CITES_SQL}, {BOTH_SQL}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 2),
cited AS (SELECT dst, count(*) AS n, bool_or(coalesce(treatment = 'overruled', false)) AS bad FROM cites GROUP BY dst)
SELECT node, coalesce(n, 0) AS cited_by FROM (SELECT DISTINCT node FROM walk WHERE node <> 1) LEFT JOIN cited ON dst = node WHERE NOT coalesce(bad, false) ORDER BY cited_by DESC, node LIMIT 20""")
def authorities(spark, sf_dir):
    return gr.authorities(cites(spark, sf_dir), 1)


def _paths_sql(name: str, start: str, goal: str) -> str:
    """Best paths by exact length: at a node's least depth that is its first shortest path."""
    return f"""{name} AS (SELECT {start} AS node, [{start}] AS path, 0 AS depth
  UNION ALL SELECT dst, min(list_append(path, dst)), depth + 1 FROM {name} JOIN links ON src = node WHERE depth < 10 GROUP BY dst, depth),
{name}_best AS (SELECT path FROM {name} WHERE node = {goal} ORDER BY depth LIMIT 1)"""


LINKS_SQL = "links AS (SELECT DISTINCT src, dst FROM cites)"
FIRST, LAST = "(SELECT min(src) FROM cites)", "(SELECT max(dst) FROM cites)"


def _ends(edges):
    ends = edges.agg(F.min("src").alias("a"), F.max("dst").alias("b")).first()
    return ends.a, ends.b


@query(f"WITH RECURSIVE {CITES_SQL}, {LINKS_SQL}, {_paths_sql('there', FIRST, LAST)} SELECT (unnest(range(len(path))))::INT AS step, unnest(path) AS node FROM there_best")
def shortest_path(spark, sf_dir):
    edges = cites(spark, sf_dir)
    return gr.shortest_path(edges, *_ends(edges), 10)


@query(f"""WITH RECURSIVE {CITES_SQL}, {LINKS_SQL}, {_paths_sql('there', FIRST, LAST)}, {_paths_sql('back', LAST, FIRST)}
SELECT 'forward' AS direction, (unnest(range(len(path))))::INT AS step, unnest(path) AS node FROM there_best UNION ALL SELECT 'reverse', (unnest(range(len(path))))::INT, unnest(path) FROM back_best""")
def shortest_paths(spark, sf_dir):
    edges = cites(spark, sf_dir)
    return gr.shortest_paths(edges, *_ends(edges), 10)


@query(f"WITH {CITES_SQL}, {NODES_SQL} SELECT id, count(dst) AS cited_by FROM nodes LEFT JOIN cites ON dst = id GROUP BY id")
def in_degree(spark, sf_dir):
    return gr.in_degree(cites(spark, sf_dir), nodes(spark, sf_dir))


@query(f"""WITH {CITES_SQL}, {NODES_SQL} SELECT n.id, count(dst) AS citers, coalesce(round(avg(CASE WHEN dst IS NULL THEN NULL WHEN c.year >= 1996 THEN 1.0 ELSE 0.0 END), 4), 0.0) AS rising
FROM nodes n LEFT JOIN cites ON dst = n.id LEFT JOIN nodes c ON c.id = src GROUP BY n.id""")
def rising(spark, sf_dir):
    return gr.rising(cites(spark, sf_dir), nodes(spark, sf_dir), 1996)


@query(f"""WITH {CITES_SQL}, c AS (SELECT dst AS id, count(*) AS incoming, round(count(*) FILTER (coalesce(treatment, 'referred_to') IN ('affirmed', 'followed', 'referred_to', 'explained')) / count(*), 4) AS positive_pct, count(*) FILTER (treatment = 'overruled') AS bad FROM cites GROUP BY dst)
SELECT id, incoming, positive_pct, CASE WHEN bad > 0 THEN 'Overruled' WHEN positive_pct < 0.5 THEN 'Cautionary' WHEN positive_pct >= 0.8 THEN 'Followed' ELSE 'Mixed' END AS verdict FROM c""")
def treatment_verdict(spark, sf_dir):
    return gr.treatment_verdict(cites(spark, sf_dir))


@query(f"WITH {CITES_SQL}, {NODES_SQL} SELECT id, coalesce(round(avg(CASE WHEN treatment IN ('followed', 'affirmed', 'applied', 'explained') THEN 1.0 WHEN treatment IS NOT NULL THEN 0.0 END), 4), 1.0) AS positive_pct FROM nodes LEFT JOIN cites ON dst = id GROUP BY id")
def treatment_shares(spark, sf_dir):
    return gr.treatment_shares(cites(spark, sf_dir), nodes(spark, sf_dir))


def _rank_sql(links: str, nodes: str, tolerance: float, rounds: int) -> str:
    return f"""deg AS (SELECT src, count(*) AS out FROM {links} GROUP BY src), n AS (SELECT count(*) AS n FROM {nodes}),
pr AS (SELECT id, 0 AS step, 1.0::DOUBLE / (SELECT n FROM n) AS rank, 1.0::DOUBLE AS change FROM {nodes}
  UNION ALL SELECT id, step + 1, new, abs(new - rank) FROM (
    SELECT p.id, s.step, p.rank, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS new
    FROM pr p CROSS JOIN n CROSS JOIN (SELECT max(step) AS step, sum(change) AS change, coalesce(sum(rank) FILTER (id NOT IN (SELECT src FROM deg)), 0) AS lost FROM pr) s
    LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM pr JOIN {links} l ON l.src = pr.id JOIN deg ON deg.src = l.src GROUP BY dst) g ON g.dst = p.id WHERE s.step < {rounds} AND s.change > {tolerance}))"""


@query(f"WITH RECURSIVE {CITES_SQL}, {NODES_SQL}, {LINKS_SQL}, {_rank_sql('links', 'nodes', 1e-6, 200)} SELECT id, round(rank, 8) AS rank FROM pr WHERE step = (SELECT max(step) FROM pr)")
def pagerank(spark, sf_dir):
    return gr.page_rank(cites(spark, sf_dir), nodes(spark, sf_dir)).select("id", F.round("rank", 8).alias("rank"))


@query(f"""WITH RECURSIVE {CITES_SQL}, {NODES_SQL}, {BOTH_SQL}, walk AS (SELECT id, id AS label FROM nodes UNION SELECT dst, label FROM walk JOIN both_ways ON src = id WHERE label < dst)
SELECT id, min(label) AS component FROM walk GROUP BY id""")
def components(spark, sf_dir):
    return gr.components(cites(spark, sf_dir), nodes(spark, sf_dir))


@query()
def communities(spark, sf_dir):
    return gr.louvain(cites(spark, sf_dir), nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {CITES_SQL}, m AS (SELECT c_custkey AS id, c_nationkey AS community FROM customer), links AS (SELECT DISTINCT src, dst FROM cites JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.community = b.community), deg AS (SELECT src, count(*) AS out FROM links GROUP BY src),
z AS (SELECT community, count(*) AS n FROM m GROUP BY community),
pr AS (SELECT id, community, 0 AS step, 1.0::DOUBLE / n AS rank, 1.0::DOUBLE AS change FROM m JOIN z USING (community)
  UNION ALL SELECT id, community, step + 1, new, abs(new - rank) FROM (SELECT p.id, p.community, s.step, s.change, p.rank, 0.15 / n + 0.85 * (coalesce(got, 0) + coalesce(lost, 0) / n) AS new FROM pr p JOIN z USING (community) CROSS JOIN (SELECT max(step) AS step, sum(change) AS change FROM pr) s
    LEFT JOIN (SELECT community, sum(rank) AS lost FROM pr WHERE id NOT IN (SELECT src FROM deg) GROUP BY community) l ON l.community = p.community LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM pr JOIN links k ON k.src = pr.id JOIN deg ON deg.src = k.src GROUP BY dst) g ON g.dst = p.id WHERE s.step < 200 AND s.change > 1e-3))
SELECT id, community, round(rank, 8) AS rank FROM pr WHERE step = (SELECT max(step) FROM pr)""")
def pagerank_within(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    return gr.page_rank_within(cites(spark, sf_dir), members, tolerance=1e-3).withColumn("rank", F.round("rank", 8))


@query(f"WITH {CITES_SQL}, {NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(DISTINCT dst) AS cited FROM cites")
def graph_stats(spark, sf_dir):
    return gr.graph_stats(cites(spark, sf_dir), nodes(spark, sf_dir))


@query("""WITH c AS (SELECT o_custkey AS src, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'followed' END AS treatment, 'SUPPLIER#' || lpad((o_orderkey % 10)::VARCHAR, 9, '0') AS cited FROM orders),
t AS (SELECT upper(s_name) AS key, max(s_suppkey) AS id FROM supplier GROUP BY 1)
SELECT src, id AS dst, arg_max(coalesce(treatment, '-'), ord) AS treatment FROM c JOIN t ON cited = key WHERE src <> id GROUP BY ALL""")
def edge_build(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cited = F.concat(F.lit("Supplier#"), F.lpad((F.col("o_orderkey") % 10).cast("string"), 9, "0"))
    found = orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, "followed").otherwise("-").alias("treatment"), cited.alias("cited"))
    targets = table(spark, sf_dir, "supplier").select(F.upper("s_name").alias("key"), F.col("s_suppkey").alias("id"))
    return gr.build_edges(found, targets, F.upper("cited"))
