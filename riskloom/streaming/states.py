"""Streams that remember more than counts: states of graph builds, sessions, and pairs of events of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: characters of an error that are kept.
MAX_ERROR_CHARS = 500
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMED_OUT = "timed out"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; it holds state beyond memory. For streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def next_status(status: str | None, kind: str) -> str | None:
    """The status after an event, or None if the event changes nothing.

    A request makes an idle repository pending, a start any but a running build building; the end of a build counts only
    while it runs.
    """
    if kind == "request":
        return "pending" if status in (None, "ready", "error") else None
    if kind == "start":
        return "building" if status != "building" else None
    if kind in ("done", "fail"):
        return {"done": "ready", "fail": "error"}[kind] if status == "building" else None
    return None


class BuildStates(StatefulProcessor):
    """One repository's build. Times are event times in milliseconds."""

    def __init__(self, stale_ms: int, ttl_ms: int):
        self.stale_ms, self.ttl_ms = stale_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since bigint")

    def _remember(self, status: str, since: int, now: int) -> None:
        """Notes the status, with one timer: when a build counts as stale, or when an idle state is forgotten."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update((status, since))
        self.handle.registerTimer(max(since + (self.stale_ms if status == "building" else self.ttl_ms), now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, since = self.state.get() if self.state.exists() else (None, -1)
        out = []
        for ts, _, kind, message in sorted((int(t.value // 1_000_000), int(i), k, m) for pdf in rows for t, i, k, m in zip(pdf["ts"], pdf["ord"], pdf["kind"], pdf["message"].fillna(""), strict=True)):
            if status == "building" and ts - since > self.stale_ms:
                status, since = "error", since + self.stale_ms
                out.append((since, status, TIMED_OUT))
            if ts < since:
                continue  # older than what is known
            new = next_status(status, kind)
            if new is not None:
                status, since = new, ts
                out.append((ts, new, message[:MAX_ERROR_CHARS] if new == "error" else None))
        if status is not None:
            self._remember(status, since, timerValues.getCurrentWatermarkInMs())
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, since = self.state.get() if self.state.exists() else (None, -1)
        if status == "building":
            self._remember("error", since + self.stale_ms, timerValues.getCurrentWatermarkInMs())
            yield self._rows(key, [(since + self.stale_ms, "error", TIMED_OUT)])
        else:
            self.state.clear()
            yield self._rows(key, [])

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"repo": pd.Series([key[0]] * len(out), dtype="object"), "ts": pd.to_datetime(pd.Series([t for t, _, _ in out], dtype="int64"), unit="ms", utc=True), "status": pd.Series([s for _, s, _ in out], dtype="object"), "error": pd.Series([e for _, _, e in out], dtype="object")})

    def close(self) -> None:
        pass


def build_states(stream: DataFrame, stale: int = 1800, ttl: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """(repo, ts, status, error): each change of the status of a repository's graph build.

    ``stream`` (repo, ts, ord, kind, message): kinds are request, start, done and fail; of equal times ``ord`` decides. Events older
    than the status known are ignored, as are repeated ones and those that fit no status; rows later than the watermark are
    dropped. A build that runs for over ``stale`` seconds ends with an error. An idle repository's state is forgotten ``ttl``
    seconds after its last change, so state doesn't grow with all repositories ever seen. Call ``use_rocksdb`` before.
    """
    rows = stream.select(F.col("repo").cast("string").alias("repo"), F.col("ts").cast("timestamp").alias("ts"), F.col("ord").cast("long").alias("ord"), "kind", F.coalesce("message", F.lit("")).alias("message")).withWatermark("ts", late)
    return rows.groupBy("repo").transformWithStateInPandas(BuildStates(stale * 1000, ttl * 1000), "repo string, ts timestamp, status string, error string", "Append", "EventTime")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): stretches of a key's events with less than ``gap`` between; ``end`` is ``gap`` after the last event.

    A session is given out once the watermark has passed its end; rows later than that are dropped (Spark judges late rows by the
    watermark of the batch before).
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def followed_by(first: DataFrame, second: DataFrame, key: str, within: str = "1 hour", late: str = "1 hour", how: str = "leftOuter") -> DataFrame:
    """(key, id, ts, next_id): rows of ``first`` (key, id, ts) with each row of ``second`` of the key up to ``within`` later.

    Both have a watermark, so state ends: with ``leftOuter``, a row that nothing follows is given out with a null next_id once the
    watermark says that nothing can follow any more. Rows later than the watermark are dropped on either side.
    """
    a = first.select(F.col(key).alias("_key"), "id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    b = second.select(F.col(key).alias("_key2"), F.col("id").alias("next_id"), F.col("ts").cast("timestamp").alias("_ts2")).withWatermark("_ts2", late)
    fits = (F.col("_key") == F.col("_key2")) & (F.col("_ts2") > F.col("ts")) & (F.col("_ts2") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, fits, how).select(F.col("_key").alias(key), "id", "ts", "next_id")
