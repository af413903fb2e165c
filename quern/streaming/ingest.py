"""Incremental ingestion: a file stream that resumes, drops what was delivered before, and upserts each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import content_hash


def read_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drop_redelivered(stream: DataFrame, text: str, at: str, delay: str = "1 day") -> DataFrame:
    """Rows whose normalised text was not seen within ``delay``; the state forgets older hashes."""
    return stream.withWatermark(at, delay).withColumn("text_hash", content_hash(text)).dropDuplicatesWithinWatermark(["text_hash"])


def ingest(stream: DataFrame, table_path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append each batch's rows whose key the table lacks. A batch that is run again adds nothing, so a restart is safe."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(table_path).select(key), key, "left_anti")
        except Exception as error:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh.write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(stream: DataFrame, at: str, kind: str, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """(start, kind, n) in tumbling windows; rows later than ``delay`` are left out."""
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, length).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), kind, "n")


def retryable(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Pending jobs with tries left, oldest first."""
    return jobs.where((F.col("status") == "pending") & (F.col("retries") < most)).orderBy("created_at", "id")


def reset_orphans(jobs: DataFrame, now: str, age: str = "1 hour") -> DataFrame:
    """Jobs that have been processing for longer than ``age`` count as failed."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {age}"))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
