"""Queries over the driver's tables that apply the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate as op7
from quern.llm import exact_dedup as op1
from quern.llm import hard_negatives as op13
from quern.llm import language_id as op4
from quern.llm import line_dedup as op12
from quern.llm import lm_score as op6
from quern.llm import piece_codec as op9
from quern.llm import secrets as op5
from quern.llm import sharding as op10
from quern.llm import simhash as op2
from quern.llm import token_output as op8
from quern.llm import tokenizer_alignment as op11
from quern.llm import url_filter as op3
from quern.llm.common import fold, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The operator leaves texts unhashed that are proved unique; the contract wants every digest.
    return op1.exact_dedup(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.simhash_dedup(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.judge_urls(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = op4.identify(docs, op4.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans", "margin")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = op5.find_secrets(docs, op5.train(op5.labelled_samples(docs)))
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold("doc_id", 10)
    found = op6.score_documents(docs, training=part != 0, held=part == 1)
    return found.select("doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all($doc, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all($item, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM spots JOIN windows USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""".replace("$doc", LOWER_SQL.format("coalesce(text, '')")).replace("$item", LOWER_SQL.format("text"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    op8.save_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path)
    found = op8.read_tokens(spark, path)
    return found.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


SHARDS = 40


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


#: CRC-32 byte by byte, over a table that is made from its rule.
OP10_SQL = f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS t FROM range(256) r(i)),
rows AS (SELECT doc_id, coalesce(text, '') AS t, hex(coalesce(text, '')) AS h, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
marked AS (
  SELECT doc_id, k, strlen(rows.t) + 16 AS size,
         xor(list_reduce(list_transform(range(strlen(rows.t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32
  FROM rows, crc),
drawn AS (SELECT marked.*, s.shard::INT AS s, ('0x' || substr(md5(k || ':' || s.shard), 1, 13))::BIGINT AS u FROM marked, range({SHARDS + 1}) AS s(shard)),
best AS (SELECT doc_id, k, size, text_crc32, arg_max(s, u) FILTER (s < {SHARDS}) AS shard, arg_max(s, u) AS grown_shard FROM drawn GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM best
"""


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.score_alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op12.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(w) AS line, unnest(range(len(w))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)),
keyed AS (SELECT doc_id, pos, line, $key AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 3),
judged AS (SELECT keyed.*, repeated.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS dropped FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""".replace("$key", LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return op13.mine_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM rows a, rows r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Query]:
    found = [op1_exact_dedup, op2_simhash_dedup, op3_url_filter, op4_language_id, op5_secret_scan, op6_lm_scoring, op7_decontamination, op8_token_output, op9_sentencepiece, op10_sharding, op11_tokenizer_alignment, op12_line_dedup, op13_hard_negatives]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op7_decontamination": OP7_SQL, "op10_sharding": OP10_SQL, "op12_line_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
