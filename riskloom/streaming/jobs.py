"""Streams over score and request events. Each works with any source; tests run them on files with AvailableNow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_scores(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends scored changes to the history table, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def notify(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, repo: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to ``publish``; nothing is stored."""
    rows = stream.filter(F.col("repo") == repo) if repo else stream
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_tokens(stream: DataFrame) -> DataFrame:
    """Additive counters by user and month."""
    return stream.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("tokens_used"))


def daily_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by day and type; days close once the watermark has passed them. Times without zone are taken as UTC."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def sliding_limit(stream: DataFrame, key: str, most: int, seconds: int, reset_on: str | None = None) -> DataFrame:
    """(key, ts, allowed): at most ``most`` recorded requests of a key in ``seconds``. Rejected requests are not recorded.

    ``stream`` has ``key`` and ``ts``; with ``reset_on`` (a boolean column, a success) an allowed success clears the key.
    The state of a key is the times still inside the window, at most ``most``; it is dropped when the key is idle that
    long in event time. Late rows of a batch are taken in time order.
    """
    flag = F.col(reset_on) if reset_on else F.lit(False)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), flag.alias("clears")).withWatermark("ts", f"{seconds} seconds")

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        allowed = []
        for ts, clears in zip(pdf["ts"].astype("int64") // 1000, pdf["clears"], strict=True):
            times = [t for t in times if t > ts - seconds * 1_000_000]
            ok = len(times) < most
            if ok:
                times = [] if clears else [*times, int(ts)]
            allowed.append(ok)
        state.update((times,))
        last = int(pdf["ts"].astype("int64").max() // 1_000_000)
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key_[0]] * len(pdf), "ts": pdf["ts"].to_numpy(), "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def quota(stream: DataFrame, limits: dict[str, int], default: int, reserve: int = 3000, base: int = 1500, per_call: int = 500) -> DataFrame:
    """(user_id, ts, degraded, used): each request reserves ``reserve`` tokens, then settles at ``base`` + ``per_call`` x calls.

    A request whose reservation would pass the user's quota is degraded and uses nothing.
    """

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        limit = limits.get(key_[0], default)
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for calls in pdf["tool_calls"]:
            degraded = used + reserve > limit
            used += 0 if degraded else base + per_call * int(calls)
            out.append((degraded, used))
        state.update((used,))
        yield pd.DataFrame({"user_id": [key_[0]] * len(pdf), "ts": pdf["ts"].to_numpy(), "degraded": [o[0] for o in out], "used": [o[1] for o in out]})

    rows = stream.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "tool_calls")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id string, ts timestamp, degraded boolean, used bigint", "used bigint", "append", GroupStateTimeout.NoTimeout)
