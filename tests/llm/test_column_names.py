"""Columns with dots, back-ticks and maps, below and above each bound on samples: nothing depends on how many rows there are."""

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, exact_dedup, language_id, piece_codec, secrets, sharding, simhash
from quern.llm.queries import tokenizer_path

MORE = "`a.b` map<string,int>, `tick``ed` string, `x y` array<int>, payload struct<text:string>, `of.it` double"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names") / "d")
    lines = ["the cat sat on the mat", "der Hund lief in das Haus", "password = abcdefghijkl0123", None, "", "the cat sat on the mat"]
    rows = [(n, f"{lines[n % 6]} {n}" if n % 5 and lines[n % 6] else lines[n % 6], "en" if n % 2 else "de", {"k": n}, "t", [n], ("z",), 1.0) for n in range(60)]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, {MORE}").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("most", [5, 50_000])
def test_language_id(docs, most):
    model = language_id.train(docs, max_texts=most)
    assert model.languages == ["de", "en"]
    assert language_id.identify(docs, model).count() == 60


def test_language_stage_keeps_all_columns(docs):
    kept = language_id.keep_languages(docs, F.col("lang").isNotNull())
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = {r.doc_id: r for r in docs.collect()}
    found = kept.collect()
    assert 0 < len(found) < 60 and all(r == rows[r.doc_id] for r in found)


@pytest.mark.parametrize("most", [5, 50_000])
def test_secret_samples(docs, most):
    samples = secrets.labelled_samples(docs, max_texts=most)
    assert secrets.find_secrets(docs, secrets.train(samples)).count() == 60


def test_a_repeated_text_does_not_fill_the_sample(spark):
    rows = spark.createDataFrame([("the same text again",)] * 400 + [(f"text number {n} in line",) for n in range(40)], "text string").withColumn("lang", F.lit("en"))
    for most in (5, 1000):
        texts = secrets.labelled_samples(rows, max_texts=most).where("string = 'again'").count()
        assert texts <= 1


def test_shards_are_written(docs, spark, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), [1.0] * 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 60


def test_other_stages(docs):
    bench = docs.limit(3).select(F.col("doc_id").alias("item_id"), "text")
    for kept in (exact_dedup.drop_exact_copies(docs), simhash.drop_near_copies(docs), decontaminate.drop_contaminated(docs, bench)):
        assert kept.columns == docs.columns and 0 < kept.count() <= 60
    assert piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).count() == 60
