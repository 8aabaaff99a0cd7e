"""Sliding-window rate limits and lifetime quotas, as streams and as batches.

Requests are rows ``(key, at, request_id)`` with ``at`` in seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.operators.groups import top_n

DECISION = "key string, at double, request_id long, accepted boolean, retry_after long, late boolean"


def admitted(at: np.ndarray, recent: np.ndarray, window: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(accepted, seconds to wait, the last ``most`` accepted times) of requests in time order.

    ``recent`` has the accepted times before them, oldest first. The n-th
    accepted request is the first one after its predecessor that lies more than
    the window after the accepted one ``most`` places back. So the accepted ones
    are reached by jumps, each a sorted search; requests in between are refused
    until the window after the oldest of the last ``most`` has passed.
    """
    places, times, place, left = [], list(recent[-most:]), 0, at - window
    while place < len(at):
        if len(times) >= most:
            place = max(place, int(np.searchsorted(left, times[-most], side="right")))
            if place >= len(at):
                break
        places.append(place)
        times.append(float(at[place]))
        place += 1
    accepted = np.zeros(len(at), bool)
    accepted[places] = True
    # For a refused request the full window's oldest entry is the ``most``-th last accepted one before it.
    known = np.array(times, float)
    oldest = np.cumsum(accepted) + (len(times) - len(places)) - most
    wait = np.zeros(len(at))
    refused = ~accepted
    wait[refused] = np.maximum(1.0, window - (at[refused] - known[oldest[refused]]))
    return accepted, np.floor(wait).astype(np.int64), known[-most:]


def sessions(requests: DataFrame, window: int, slice_seconds: int) -> DataFrame:
    """Add ``session``: the start of the run of requests with gaps of at most
    ``window``. Runs do not influence each other.

    Keys are cut into time slices, so that not even a very busy key is sorted
    by one task; the slices of a key are then linked through one row per slice.
    """
    cut = F.floor(F.col("at") / slice_seconds)
    # Requests without a key share one; joins would lose a null.
    named = F.coalesce(F.concat(F.lit("="), "key"), F.lit(""))
    rows = requests.withColumn("slice", cut).withColumn("named", named)
    w = Window.partitionBy("named", "slice").orderBy("at", "request_id")
    rows = rows.withColumn("before", F.lag("at").over(w))
    edges = rows.groupBy("named", "slice").agg(F.max("at").alias("last"))
    by_slice = Window.partitionBy("named").orderBy("slice")
    edges = edges.select("named", "slice", F.lag("last").over(by_slice).alias("before_slice"))
    rows = rows.join(edges, ["named", "slice"]).withColumn("before", F.coalesce("before", "before_slice"))
    opens = F.when(F.col("before").isNull() | (F.col("at") - F.col("before") > window), F.col("at"))
    rows = rows.withColumn("opens", opens)
    starts = rows.groupBy("named", "slice").agg(F.max("opens").alias("open_last"))
    so_far = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("named", "slice", F.max("open_last").over(so_far).alias("open_before"))
    inside = F.max("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", inside).join(starts, ["named", "slice"]).select(
        "key", "at", "request_id", F.coalesce("own", "open_before").alias("session")
    )


def rate_limit(requests: DataFrame, window: int, most: int, slice_seconds: int | None = None) -> DataFrame:
    """Decision per request. Only accepted requests count against the window.

    Sessions are spread over tasks and sorted inside them; a task takes its rows
    in Arrow batches, holds at most ``most`` times between them, and its work on
    a session is one search for each accepted request. Sessions of no more than
    ``most`` requests are accepted at once, all those of a batch together.
    """
    window, most = max(1, int(window)), max(1, int(most))
    parts = sessions(requests, window, slice_seconds or 64 * window)
    placed = parts.repartition("key", "session").sortWithinPartitions("key", "session", "at", "request_id")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, np.zeros(0)
        for frame in frames:
            if not len(frame):
                continue
            key, start, at = frame["key"].to_numpy(object), frame["session"].to_numpy(float), frame["at"].to_numpy(float)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (start[1:] != start[:-1])) + 1
            low, high = np.concatenate(([0], edges)), np.concatenate((edges, [len(at)]))
            accepted, wait = np.ones(len(at), bool), np.zeros(len(at), np.int64)
            judged = high - low > most
            # The first run may have begun in the batch before, the last one may go on in the next.
            judged[0] = judged[-1] = True
            for a, b in zip(low[judged].tolist(), high[judged].tolist(), strict=True):
                run = key[a], start[a]
                if run != current:
                    current, recent = run, np.zeros(0)
                accepted[a:b], wait[a:b], recent = admitted(at[a:b], recent, window, most)
            out = frame[["key", "at", "request_id"]].assign(accepted=accepted)
            out["retry_after"] = pd.arrays.IntegerArray(wait, accepted)
            yield out.assign(late=False)

    return placed.mapInPandas(decide, DECISION)


def with_state_store(spark: SparkSession) -> None:
    """Processors with state of several kinds need the RocksDB store; set it unless the session names another."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _key_rows(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """(times, ids) of a key's rows of a micro-batch in time order: two numbers a row."""
    parts = [(f["at"].to_numpy(float), f["request_id"].to_numpy()) for f in frames]
    at, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((ids, at))
    return at[order], ids[order]


class WindowLimiter(StatefulProcessor):
    """The accepted times of a key, ``most`` at most, and the newest time decided; both are forgotten ``keep`` seconds after their last change."""

    def __init__(self, window: int, most: int, keep: float):
        self.window, self.most, self.keep = window, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "accepted array<double>, newest double", ttlDurationMs=int(self.keep * 1000))

    def handleInputRows(self, key, rows, timerValues):
        at, ids = _key_rows(rows)
        times, newest = self.state.get() if self.state.exists() else ([], float("-inf"))
        accepted, wait, kept = admitted(at, np.array(times, float), self.window, self.most)
        self.state.update(([float(x) for x in kept], max(newest, float(at[-1]))))
        out = pd.DataFrame({"key": [key[0]] * len(at), "at": at, "request_id": ids, "accepted": accepted})
        out["retry_after"] = pd.arrays.IntegerArray(wait, accepted)
        yield out.assign(late=at < newest)

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, window: int, most: int, keep: float | None = None) -> DataFrame:
    """The same decisions on a stream.

    A row older than one already decided for its key is judged by the state of
    now and marked ``late``. A key's state is a list of at most ``most`` times and
    one more; it is dropped when nothing of the key was decided for ``keep``
    seconds of the stream's own clock (two windows by default), so idle keys take
    no room. ``keep`` must be no less than a window plus what the stream may lag.
    """
    window, most = max(1, int(window)), max(1, int(most))
    with_state_store(requests.sparkSession)
    return requests.groupBy("key").transformWithStateInPandas(
        WindowLimiter(window, most, keep or 2 * window), DECISION, "append", "ProcessingTime"
    )


class QuotaCounter(StatefulProcessor):
    """How many requests of a key were accepted, for ever."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows, timerValues):
        at, ids = _key_rows(rows)
        before = self.used.get()[0] if self.used.exists() else 0
        used = np.minimum(before + 1 + np.arange(len(at)), self.limit)
        accepted = before + 1 + np.arange(len(at)) <= self.limit
        self.used.update((int(used[-1]),))
        yield pd.DataFrame({"key": [key[0]] * len(at), "request_id": ids, "accepted": accepted, "used": used, "remaining": self.limit - used})

    def close(self) -> None:
        pass


def quota_stream(requests: DataFrame, limit: int) -> DataFrame:
    """(key, request_id, accepted, used, remaining) on a stream: the first ``limit`` requests of a key to arrive, by time within a micro-batch."""
    with_state_store(requests.sparkSession)
    return requests.groupBy("key").transformWithStateInPandas(
        QuotaCounter(max(0, int(limit))), "key string, request_id long, accepted boolean, used long, remaining long", "append", "None"
    )


def two_key_limit(requests: DataFrame, window: int, ip_most: int, user_most: int) -> DataFrame:
    """(request_id, ip, user, accepted, limited_by, retry_after): the address is judged first, then the user.

    Only requests that the address lets through are counted for the user.
    """
    by_ip = rate_limit(requests.select(F.col("ip").alias("key"), "at", "request_id"), window, ip_most)
    passed = requests.join(by_ip.where("accepted").select("request_id"), "request_id")
    by_user = rate_limit(passed.select(F.col("user").alias("key"), "at", "request_id"), window, user_most)
    ip = by_ip.select("request_id", F.col("accepted").alias("ip_ok"), F.col("retry_after").alias("ip_wait"))
    user = by_user.select("request_id", F.col("accepted").alias("user_ok"), F.col("retry_after").alias("user_wait"))
    rows = requests.join(ip, "request_id").join(user, "request_id", "left")
    return rows.select(
        "request_id", "ip", "user", (F.col("ip_ok") & F.coalesce("user_ok", F.lit(False))).alias("accepted"),
        F.when(~F.col("ip_ok"), "ip").when(~F.col("user_ok"), "user").alias("limited_by"), F.coalesce("ip_wait", "user_wait").alias("retry_after"),
    )


def quota_usage(requests: DataFrame, limit: int) -> DataFrame:
    """Lifetime quota per key: one count, however many requests a key makes."""
    limit = max(0, int(limit))
    n = requests.groupBy("key").agg(F.count("*").alias("asked"))
    used = F.least("asked", F.lit(limit))
    return n.select(
        "key", F.lit(limit).cast("long").alias("limit"), used.cast("long").alias("used"),
        (F.lit(limit) - used).cast("long").alias("remaining"), (used < limit).alias("can_ask"),
        (F.col("asked") - used).cast("long").alias("rejected"),
    )


def quota_accepted(requests: DataFrame, limit: int) -> DataFrame:
    """The accepted requests: the first ``limit`` of each key."""
    return top_n(requests, ["key"], [F.asc("at"), F.asc("request_id")], max(0, int(limit)), rank="used")
