"""A queue of failed jobs: retries after growing waits, a dead-letter side, as a stream with timers and as a plan over a table.

A job's n-th failure since it last succeeded asks for a retry ``base * 2^(n - 1)``
seconds later. A success ends the queue's interest in the job; a further outcome
before the retry is due replaces it. After ``most`` retries the next failure goes to
the dead letters, once, and failures after that are ignored until the job succeeds.

Both give (key, tie, action, tries, at): ``retry`` with the time that it is due,
``dead`` with the time of the last failure; ``tie`` is the failure's own id. The
stream gives the same rows whatever batches its input comes in, as long as a job's
outcomes are no later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

BASE_SECONDS, MOST = 60, 3


def retry_plan(events: DataFrame, key: str, at: str, tie: str, failed: Column, succeeded: Column, *, base: int = BASE_SECONDS, most: int = MOST) -> DataFrame:
    """The rows of the queue over a table of outcomes; rows that are neither outcome are left out, a null key is a job of its own."""
    rows = events.select(F.col(key).alias("key"), F.col(at).alias("when"), F.col(tie).alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed"), F.coalesce(succeeded, F.lit(False)).alias("good")).where("failed or good")
    order = Window.partitionBy("key").orderBy("when", "tie")
    rows = rows.withColumn("run", F.sum(F.col("good").cast("int")).over(order)).withColumn("next", F.lead("when").over(order))
    tries = F.row_number().over(Window.partitionBy("key", "run").orderBy("when", "tie"))
    rows = rows.where("failed").withColumn("tries", tries).where(F.col("tries") <= most + 1)
    due = F.col("when") + F.make_dt_interval(secs=base * F.pow(F.lit(2), F.col("tries") - 1).cast("long"))
    dead = F.col("tries") > most
    rows = rows.withColumn("due", due).where(dead | F.col("next").isNull() | (F.col("next") > F.col("due")))
    return rows.select(F.col("key").alias(key), F.col("tie").alias(tie), F.when(dead, "dead").otherwise("retry").alias("action"), F.least("tries", F.lit(most)).alias("tries"), F.when(dead, F.col("when")).otherwise(F.col("due")).alias("at"))


class RetryQueue(StatefulProcessor):
    """State of a job: failures since its last success, and the pending retry with its timer."""

    def __init__(self, key: str, at: str, tie: str, base: int, most: int):
        self.names, self.base, self.most = (key, at, tie), base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # due: microseconds, -1 where no retry is pending.
        self.job = handle.getValueState("job", "tries int, due long, tie long")

    def _rows(self, key, out: list[tuple]):
        import pandas as pd

        frame = pd.DataFrame(out, columns=["tie", "action", "tries", "at"])
        frame["at"] = pd.to_datetime(frame["at"], unit="us")
        key_name, _, tie_name = self.names
        frame.insert(0, key_name, key[0])
        return frame.rename(columns={"tie": tie_name})

    @staticmethod
    def _timer(due: int) -> int:
        return -(-due // 1000)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        _, at, tie = self.names
        frame = pd.concat(list(rows)).sort_values([at, tie])
        tries, due, pending = self.job.get() if self.job.exists() else (0, -1, -1)
        if due >= 0:
            self.handle.deleteTimer(self._timer(due))
        out: list[tuple] = []
        for when, own, failed in zip(frame[at].astype("datetime64[us]").astype("int64"), frame[tie], frame["quern_failed"], strict=True):
            if 0 <= due < when:
                out.append((pending, "retry", tries, due))
            due = -1
            if not failed:
                tries = 0
            elif tries < self.most:
                tries, pending = tries + 1, int(own)
                due = int(when) + self.base * 1_000_000 * 2 ** (tries - 1)
            elif tries == self.most:
                tries += 1
                out.append((int(own), "dead", self.most, int(when)))
        if tries == 0:
            self.job.clear()
        else:
            self.job.update((tries, due, pending))
            if due >= 0:
                self.handle.registerTimer(self._timer(due))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.job.exists():
            tries, due, pending = self.job.get()
            if 0 <= due and self._timer(due) <= expiredTimerInfo.getExpiryTimeInMs():
                self.job.update((tries, -1, -1))
                yield self._rows(key, [(pending, "retry", tries, due)])

    def close(self) -> None:
        pass


def retry_stream(stream: DataFrame, key: str, at: str, tie: str, failed: Column, succeeded: Column, *, base: int = BASE_SECONDS, most: int = MOST, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream of outcomes, in event time; a retry comes out when the watermark has passed its time.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = stream.select(key, at, tie, F.coalesce(failed, F.lit(False)).alias("quern_failed"), F.coalesce(succeeded, F.lit(False)).alias("quern_good")).where("quern_failed or quern_good").withWatermark(at, delay)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, tie)}
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, action string, tries int, at timestamp_ntz"
    return rows.groupBy(key).transformWithStateInPandas(RetryQueue(key, at, tie, base, most), schema, "Append", "EventTime")
