"""Searches over an index instead of texts: Boolean lines, many lines at once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import index as ix
from quern.operators import vector_index as vx
from quern.plans.registry import query
from quern.plans.retrieval import WORDS_SQL, lexemes_sql, stem_sql
from quern.sources.tables import table
from quern.storage import shared_dir


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


def _searched(spark, path: str, lines, english: bool) -> DataFrame:
    found = [ix.boolean_search(spark, path, line, english).select(F.lit(n).alias("line"), F.col("key").alias("doc_id")) for n, line in enumerate(lines)]
    return reduce(DataFrame.unionByName, found)


HAS, PHRASE = "list_contains(w, '{}')".format, "contains(' ' || array_to_string(w, ' ') || ' ', ' {} ')".format
#: Search lines with what they mean, over the list ``w`` of a text's words.
BOOLEAN_LINES = {
    'license OR rights -apache "all rights reserved"': f"{PHRASE('all rights reserved')} AND ({HAS('license')} OR {HAS('rights')} AND NOT {HAS('apache')})",
    "the of -and": f"{HAS('the')} AND {HAS('of')} AND NOT {HAS('and')}",
    "le la OR der die -und OR los": f"{HAS('le')} AND {HAS('la')} OR {HAS('der')} AND {HAS('die')} AND NOT {HAS('und')} OR {HAS('los')}",
    "-the -le": f"NOT {HAS('the')} AND NOT {HAS('le')}",
    "apache OR -the": f"{HAS('apache')} OR NOT {HAS('the')}",
    '"all rights" "licensed under" -que': f"{PHRASE('all rights')} AND {PHRASE('licensed under')} AND NOT {HAS('que')}",
    'the -"of the" OR "in the"': f"{PHRASE('in the')} AND {HAS('the')} AND NOT {PHRASE('of the')}",
    "of-the OR word-that-nobody-wrote": PHRASE("of the"),
    '"" -': "FALSE",
    "zzzz": "FALSE",
}


@query(f"WITH d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents) " + " UNION ALL ".join(f"SELECT {n}::INT AS line, doc_id FROM d WHERE {meant}" for n, meant in enumerate(BOOLEAN_LINES.values())))
def fts_boolean_index(spark, sf_dir):
    """Boolean lines and phrases over a positional index of all texts."""
    path = _folder(spark)
    ix.build_index(table(spark, sf_dir, "documents"), "doc_id", {"text": "D"}, path)
    return _searched(spark, path, BOOLEAN_LINES, False)


STEMMED, GAPS = "list_contains(w, '{}')".format, r"regexp_matches(' ' || array_to_string(every, ' ') || ' ', ' {} ')".format
#: As above; ``every`` has the stems of all words, those that searches leave out too.
STEMMED_LINES = {
    "licenses OR reserving -apache": f"{STEMMED('license')} OR {STEMMED('reserv')} AND NOT {STEMMED('apache')}",
    '"rights reserved"': GAPS("right reserv"),
    '"reserving all the rights" OR the': GAPS(r"reserv \S+ \S+ right"),
    '"licensed under the"': GAPS("licens under") + " AND FALSE OR " + STEMMED("licens"),
    "the of and": "FALSE",
}


@query(f"WITH d AS (SELECT doc_id, {lexemes_sql('text')} AS w, {stem_sql(WORDS_SQL.format('text'))} AS every FROM documents) " + " UNION ALL ".join(f"SELECT {n}::INT AS line, doc_id FROM d WHERE {meant}" for n, meant in enumerate(STEMMED_LINES.values())))
def fts_boolean_stemmed(spark, sf_dir):
    """English stems: words that searches leave out leave gaps in phrases."""
    path = _folder(spark)
    ix.build_index(table(spark, sf_dir, "documents"), "doc_id", {"text": "D"}, path, True)
    return _searched(spark, path, STEMMED_LINES, True)


@query(f"""WITH terms AS (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS term, 1 AS w FROM documents UNION ALL SELECT doc_id, unnest({WORDS_SQL.format('source')}), 10 FROM documents),
posted AS (SELECT doc_id, term, sum(w) AS weight FROM terms GROUP BY ALL),
rarity AS (SELECT term, length(bin((SELECT count(*) FROM documents) // count(*))) AS rarity FROM posted GROUP BY term),
asked AS (SELECT conv_id, turn, unnest(list_distinct({WORDS_SQL.format('text')})) AS term FROM conversations WHERE role = 'user'),
scored AS (SELECT conv_id, turn, doc_id, sum(weight * rarity)::BIGINT AS score FROM asked JOIN rarity USING (term) JOIN posted USING (term) GROUP BY ALL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id))::INT AS rank, doc_id AS doc, score FROM scored QUALIFY rank <= 10""")
def rank_many_lines(spark, sf_dir):
    """The ten best documents for every turn of a user, all turns in one plan."""
    path = _folder(spark)
    ix.build_index(table(spark, sf_dir, "documents"), "doc_id", {"text": "D", "source": "A"}, path)
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("of"), "text")
    return ix.rank_many(spark, path, asked, "of", "text").select("query.conv_id", "query.turn", "rank", "doc", "score")


def _vectors(spark, sf_dir) -> tuple[str, DataFrame, DataFrame]:
    """The folder of an index of all embeddings, the rows, and the queries: ids divisible by 50."""
    path, rows = _folder(spark), table(spark, sf_dir, "embeddings")
    vx.build_vectors(rows, path)
    return path, rows, rows.where("vec_id % 50 = 0")


def _named(found: DataFrame) -> DataFrame:
    return found.select("query", "rank", F.col("key").alias("vec_id"), "score")


@query()
def ann_nearest(spark, sf_dir):
    """The ten nearest of all rows for each id divisible by 50, from as many cells as a sample needs. Tests measure the recall."""
    path, rows, asked = _vectors(spark, sf_dir)
    return _named(vx.search_vectors(spark, path, asked, 10, probes=vx.probes_for(spark, path, rows, 10)))


COSINE = "round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6)"


@query(f"""WITH rows AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT b.vec_id AS query, (row_number() OVER (PARTITION BY b.vec_id ORDER BY {COSINE} DESC, a.vec_id))::INT AS rank, a.vec_id, {COSINE} AS score FROM rows a, rows b WHERE b.vec_id % 50 = 0 QUALIFY rank <= 10""")
def ann_every_cell(spark, sf_dir):
    """The same over all cells: what is left to chance is the rounding of bytes alone."""
    path, _, asked = _vectors(spark, sf_dir)
    return _named(vx.search_vectors(spark, path, asked, 10, probes=vx.MAX_CELLS, rerank=200))
