"""A training corpus from ``documents``: five stages, each by one operator of ``quern.llm``.

``run(spark, sf_dir)`` applies STAGES in turn. A stage takes (spark, docs, sf_dir)
and returns a DataFrame; it is written as Parquet into the shared folder and
read again as the next one's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialise, table
from quern.llm.decontaminate import drop_contaminated
from quern.llm.exact_dedup import drop_exact_copies
from quern.llm.language_id import keep_languages
from quern.llm.piece_codec import encode_documents
from quern.llm.queries import tokenizer_path
from quern.llm.similar import similar_components
from quern.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no language explains better than chance.

    Learns from the rows with a language. Null and empty texts go; rows that repeat
    are judged alike; if no row has a language, every text with a letter stays.
    Here and in the other stages texts may be of any length, columns may have any
    name, and an empty table gives an empty one.
    """
    return keep_languages(docs, F.col("lang").isNotNull())


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, of rows that repeat both any one. A null text equals an empty one, a null id is the smallest."""
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingle similarity 0.8 or more connect, the one with the smallest doc_id stays.

    SimHash proposes links first, an exact join finds those that it misses. A null id counts as the largest. Texts without words, null ones too, are alike; of rows that repeat id and text any one stays.
    """
    return drop_near_copies(docs, components=similar_components)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more from benchmark windows go. Null and empty texts stay; rows that repeat go or stay together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, round_trip of every document that is left; a null text has no ids."""
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Fingerprints, language models and pieces have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
