"""Tables that are written: versioned upserts, a queue of retries, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.sources.archive import register, write_archives
from quern.sources.tables import table
from quern.sources.versioned import VersionedTable
from quern.storage import shared_dir
from quern.streaming.retry import retry_plan

#: The batches of events: each user's last event of the batch; clicks have no value to tell.
BATCH = "least((dayofmonth(ts) - 1) // 10, 2)"
LAST = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(CASE WHEN event_type = 'click' THEN -1 ELSE value END, event_id) AS value FROM events WHERE {batch} = {n} GROUP BY user_id"


@query(f"""WITH b AS ({' UNION ALL '.join(f"SELECT {n} AS n, * REPLACE (CASE WHEN value = -1 AND event_type = 'click' THEN NULL ELSE value END AS value) FROM ({LAST.format(batch=BATCH, n=n)})" for n in range(3))}),
versions AS (SELECT unnest([1, 2, 3])::INT AS version)
SELECT version, user_id, arg_max(event_id, n) AS event_id, arg_max(event_type, n) AS event_type, arg_max(value, n) FILTER (value IS NOT NULL) AS value FROM versions JOIN b ON b.n < version GROUP BY version, user_id""")
def versioned_upsert(spark, sf_dir):
    """Three batches of users' last events, each delivered twice, into a table of versions; all versions read back."""
    events = table(spark, sf_dir, "events").withColumn("batch", F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)))
    held = VersionedTable.create(spark, f"{shared_dir(spark)}/users-{uuid.uuid4().hex}", "user_id long, event_id long, event_type string, value double", ["user_id"], 16)
    for n in range(3):
        value = F.when(F.col("event_type") != "click", F.col("value")).alias("value")
        for _ in range(2):
            held.upsert(events.where(F.col("batch") == n).select("user_id", "event_id", "event_type", value), f"batch-{n}", order="event_id")
    found = [held.read(n).select(F.lit(n).alias("version"), "*") for n in (1, 2, 3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed, event_type = 'purchase' AS good FROM events WHERE event_type IN ('error', 'purchase')),
runs AS (SELECT *, sum(good::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM e),
tried AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS tries FROM runs WHERE failed),
due AS (SELECT *, ts + to_seconds(3600 * 2 ** (tries - 1)) AS due FROM tried WHERE tries <= 4)
SELECT user_id, event_id, CASE WHEN tries > 3 THEN 'dead' ELSE 'retry' END AS action, least(tries, 3)::INT AS tries, CASE WHEN tries > 3 THEN ts ELSE due END AS at FROM due WHERE tries > 3 OR next IS NULL OR next > due""")
def retry_queue(spark, sf_dir):
    """Errors of users as failed jobs, purchases as successes: retries after one, two and four hours, then the dead letters."""
    kind = F.col("event_type")
    return retry_plan(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", kind == "error", kind == "purchase", base=3600)


@query("SELECT doc_id || '.' || lang AS name, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS content_sha256 FROM documents")
def archive_round_trip(spark, sf_dir):
    """All texts into TAR archives, and their members back by offset, in splits of 1 MB."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), "lang").alias("name"), "text").repartition(8)
    write_archives(docs, path, "name", "text").count()
    register(spark)
    found = spark.read.format("quern_tar").option("splitBytes", 1 << 20).load(path)
    return found.select("name", "size", F.sha2("content", 256).alias("content_sha256"))
