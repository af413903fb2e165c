"""Fuzzy joins: citations to keys, quotes to the passages that have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import fuzzy as fz
from quern.plans.registry import query
from quern.sources.tables import table

KEY = "p_type || ' ' || p_name || ' ' || p_brand"
#: Citations of parts as people write them: as it is, in capitals, cut off, inside more words, in another order, with a word more, and none at all.
CITED = f"""CASE p_partkey % 7 WHEN 0 THEN {KEY} WHEN 1 THEN '  See ' || upper({KEY}) WHEN 2 THEN substr({KEY}, 1, length({KEY}) - 3) WHEN 3 THEN 'in ' || {KEY} || ' of 1999'
  WHEN 4 THEN p_brand || ' ' || p_name || ' ' || p_type WHEN 5 THEN p_type || ' other ' || p_name || ' ' || p_brand ELSE 'nothing like no. ' || p_partkey END"""
NORMAL = r"regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '^(see|cf\.?|per|in)\s+', '')"


@query(f"""WITH asked AS (SELECT p_partkey, {CITED} AS text FROM part), names AS (SELECT {KEY} AS key, max(p_partkey) AS id FROM part GROUP BY ALL),
texts AS (SELECT DISTINCT text, {NORMAL.format('text')} AS t FROM asked), keys AS (SELECT {NORMAL.format('key')} AS k, max(id) AS id FROM names GROUP BY ALL),
pairs AS (SELECT text, id, k, length(k) AS n, t = k AS alike, contains(t, k) OR contains(k, t) AS inside, string_split(t, ' ') AS a, string_split(k, ' ') AS b FROM texts, keys),
scored AS (SELECT *, len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(len(list_distinct(a)), len(list_distinct(b))) AS share FROM pairs),
best AS (SELECT text, max(id) FILTER (alike) AS alike, arg_max(id, (n, -id)) FILTER (inside) AS inside, arg_max(id, (share, -id)) FILTER (share >= 0.6 AND len(list_distinct(a)) >= 2) AS near FROM scored GROUP BY text)
SELECT p_partkey, coalesce(names.id, alike, inside, near) AS target, CASE WHEN names.id IS NOT NULL THEN 1 WHEN alike IS NOT NULL THEN 2 WHEN inside IS NOT NULL THEN 3 WHEN near IS NOT NULL THEN 4 ELSE 0 END::INT AS tier
FROM asked LEFT JOIN best USING (text) LEFT JOIN names ON names.key = asked.text""")
def fuzzy_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.expr(KEY).alias("key")).agg(F.max("p_partkey").alias("id"))
    return fz.fuzzy_join(part.select("p_partkey", F.expr(CITED).alias("text")), names).select("p_partkey", "target", "tier")


@query()
def quotes_in_documents(spark, sf_dir):
    """The sentences of the benchmark and of all turns, of five words or more, in all documents, with up to 15 % of their words changed."""
    said = table(spark, sf_dir, "benchmark").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    sentences = said.select(F.explode(F.split("text", r"[.\n]")).alias("text")).where(F.size(F.split(F.trim("text"), r"\s+")) >= 5).distinct()
    quotes = sentences.select(F.xxhash64("text").alias("quote"), "text")
    return fz.find_quotes(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage"), "text"))
