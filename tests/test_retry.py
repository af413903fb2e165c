"""The retry queue: the plan over a table against a replay, and the stream with timers, restarted in between, against the plan."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.streaming.retry import retry_plan, retry_stream

BASE, MOST = 60, 2
START = datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


def replay(events):
    out, jobs = [], {}
    for key, at, tie, kind in sorted(events, key=lambda e: (e[1], e[2])):
        if kind == "other":
            continue
        tries, due, pending = jobs.get(key, (0, None, None))
        if due is not None and due < at:
            out.append((key, pending, "retry", tries, due))
        due = None
        if kind == "good":
            tries = 0
        else:
            tries += 1
            if tries <= MOST:
                due, pending = at + timedelta(seconds=BASE * 2 ** (tries - 1)), tie
            elif tries == MOST + 1:
                out.append((key, tie, "dead", MOST, at))
        jobs[key] = (tries, due, pending)
    out += [(key, pending, "retry", tries, due) for key, (tries, due, pending) in jobs.items() if due is not None]
    return sorted(out)


def events(n, seed=1):
    rng = random.Random(seed)
    at, out = START, []
    for tie in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 20, 60, 90]))
        out.append((rng.randrange(6), at, tie, rng.choice(["bad", "bad", "bad", "good", "other"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "job long, at timestamp_ntz, tie long, kind string").withColumn("at", F.col("at").cast("timestamp"))


def test_plan(spark):
    for seed in range(3):
        rows = events(200, seed)
        found = retry_plan(frame(spark, rows), "job", "at", "tie", F.col("kind") == "bad", F.col("kind") == "good", base=BASE, most=MOST)
        assert sorted(map(tuple, found.collect())) == replay(rows)
    assert retry_plan(frame(spark, []), "job", "at", "tie", F.lit(True), F.lit(False)).collect() == []


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield spark
    spark.conf.set(STORE, before)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_with_restarts_equals_the_plan(rocks, tmp_path, parts):
    """The input comes in several deliveries; between these the stream ends and begins again from its checkpoint."""
    spark, rows = rocks, events(160, 7)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [len(rows) * k // parts for k in range(parts + 1)]
    # A last delivery of another job moves the watermark past all timers, an empty one lets them fire.
    late = [[(99, START + timedelta(days=9), 10_000, "good")], [(99, START + timedelta(days=9, hours=1), 10_001, "good")]]
    for part in [*(rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), *late]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("job long, at timestamp, tie long, kind string").parquet(source)
        found = retry_stream(stream, "job", "at", "tie", F.col("kind") == "bad", F.col("kind") == "good", base=BASE, most=MOST, delay="1 second")
        found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == replay(rows)
