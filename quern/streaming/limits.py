"""Sequential rules over requests in time order: sliding-window rate limits and circuit breakers.

Both depend on their own earlier answers (a denied request is not recorded), so
no window function can express them. In batch, rows are dealt by key and sorted
inside partitions, and a fold reads them as a stream: its memory is one key's
state, never one key's rows. As a stream, the state lives in Spark's store.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Window:
    """Allows ``limit`` requests in any ``seconds``; what it denies it does not record."""

    def __init__(self, limit: int, seconds: float, times: list[float] = ()):
        self.limit, self.seconds, self.times = limit, seconds, deque(times)

    def __call__(self, now: float, failed: bool = False) -> bool:
        while self.times and self.times[0] <= now - self.seconds:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(now)
        return True


class Breaker:
    """Closed until ``threshold`` failures in a row, then open for ``cooldown`` seconds, then half open for a probe."""

    def __init__(self, threshold: int, cooldown: float):
        self.threshold, self.cooldown = threshold, cooldown
        self.state, self.failures, self.opened = "closed", 0, 0.0

    def __call__(self, now: float, failed: bool = False) -> bool:
        """Whether the request goes through; if so, its outcome changes the state."""
        if self.state == "open":
            if now - self.opened < self.cooldown:
                return False
            self.state = "half_open"
        if not failed:
            self.state, self.failures = "closed", 0
            return True
        self.failures += 1
        if self.state == "half_open" or self.failures >= self.threshold:
            self.state, self.opened = "open", now
        return True


def _fold(rows: DataFrame, key: str, at: str, tie: str, failed, make) -> DataFrame:
    asked = rows.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).alias("tie"), failed.alias("failed"))
    kinds = {n: asked.schema[n].dataType.simpleString() for n in ("key", "tie")}

    def answers(source) -> Iterator:
        import pyarrow as pa

        held, rule = object(), None
        for batch in source:
            out = []
            for k, t, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != held:
                    held, rule = k, make()
                out.append(rule(t / 1e6, bool(bad)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], names=["key", "tie", "allowed"])

    dealt = asked.repartition("key").sortWithinPartitions("key", "at", "tie")
    return dealt.mapInArrow(answers, f"key {kinds['key']}, tie {kinds['tie']}, allowed boolean").select(F.col("key").alias(key), F.col("tie").alias(tie), "allowed")


def rate_limit(rows: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """(key, tie, allowed) for every request in order of time, then ``tie``."""
    return _fold(rows, key, at, tie, F.lit(False), lambda: Window(limit, seconds))


def circuit_breaker(rows: DataFrame, key: str, at: str, tie: str, failed, threshold: int = 5, cooldown: float = 60.0) -> DataFrame:
    """(key, tie, allowed) for every request; ``failed`` is the outcome a request has if it goes through."""
    return _fold(rows, key, at, tie, failed, lambda: Breaker(threshold, cooldown))


def rate_limit_stream(stream: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """The same over a stream: the times that still count are the state of a key, which ends when they have passed."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = {n: stream.schema[n].dataType.simpleString() for n in (key, tie)}

    def step(group, frames, state):
        import pandas as pd

        rule = Window(limit, seconds, list(state.get[0]) if state.exists else [])
        for frame in frames:
            frame = frame.sort_values([at, tie])
            yield pd.DataFrame({key: frame[key], tie: frame[tie], "allowed": [rule(t.timestamp()) for t in frame[at]]})
        state.update((list(rule.times),))

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n): runs of events less than ``gap`` apart; works on tables and, with a watermark, on streams."""
    return rows.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
