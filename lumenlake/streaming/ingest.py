"""Continuous forms: new photos, activity windows, duplicate guard and bursts over a stream of frames.

Each takes a streaming DataFrame and returns one; `settled` runs one over what is there now and
returns the result as a table, which is also how queries and tests use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lumenlake.operators.tables import shared_dir


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of frames (id, path, session_id, t)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return rows.select(F.col("event_id").alias("id"), F.concat(F.lit("/shoot/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 500).cast("string")).alias("path"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("t"))


#: Setting that chooses where a stream keeps its state, and the store that processors with timers need.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, brief: Callable[[DataFrame], DataFrame] | None = None, store: str | None = None, progress: list | None = None) -> DataFrame:
    """Run the stream over all input that is there and return what it wrote.

    Each micro-batch writes a folder of its own, which it replaces if it runs again.  Complete results replace each other; in
    update mode the row of the latest batch counts for each of the keys, so the state may forget what the watermark has passed.
    brief: what to keep of a batch, with the stream's columns.  store: class of the state store, where the stream needs another than the
    session's.  progress: takes the reports of the stream's batches.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        (brief(batch) if brief else batch).write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    before = spark.conf.get(STORE, None)
    if store:
        spark.conf.set(STORE, store)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        if store:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    if progress is not None:
        progress += query.recentProgress
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch=-1")
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    if mode == "append":
        return out.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)


def folded(stream: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per key of all that has arrived; rules: aggregates that may be taken again over their own results, under their inputs' names.

    Each micro-batch keeps its own aggregates in a folder of its number, which it replaces if it runs again; so a batch costs what
    it brings, and reading combines the batches.
    """
    brief = lambda rows: rows.groupBy(key).agg(*(rule.alias(name) for name, rule in rules.items()))
    return brief(settled(stream.select(key, *rules), brief=brief))


def activity(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Frames and sessions' frames per tumbling window."""
    by = stream.withWatermark("t", late).groupBy(F.window("t", width).alias("w"), "session_id").agg(F.count(F.lit(1)).alias("frames"))
    return by.select(F.col("w.start").alias("start"), "session_id", "frames")


def shoots(stream: DataFrame, late: str | None = "1 hour", gap: str = "2 hours") -> DataFrame:
    """Frames of each session between pauses of `gap`.

    Without `late` no frame comes too late, and the result is to be taken as complete: the state holds every shoot.
    """
    by = (stream.withWatermark("t", late) if late else stream).groupBy(F.session_window("t", gap).alias("w"), "session_id").agg(F.count(F.lit(1)).alias("frames"))
    return by.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each path with its time once, as long as the watermark remembers it."""
    return stream.withWatermark("t", late).dropDuplicatesWithinWatermark(["path", "t"])


class BurstProcessor(StatefulProcessor):
    """State of one session: times that the watermark has not passed yet, the burst that is open, and the timer that is set.

    Frames may come in any order until the watermark passes their time; then they are folded in order of time, so the result does not depend on how
    the stream was cut into batches.  The state holds no more than the frames behind the watermark and one burst.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as every call on a state is a round trip between Python and the JVM
        self.held = handle.getValueState("held", "waiting array<bigint>, start bigint, n bigint, alarm bigint")

    def _keep(self, waiting: list[int], start: int | None, n: int, alarm: int | None) -> None:
        """Hold waiting times and the open burst, with one timer: where the first of those times, or else the end of the burst, has passed for good."""
        ends = [start + self.gap] if start is not None else []
        at = min([*ends, *waiting], default=None)
        new = None if at is None else (at + 1) * 1000
        if alarm is not None and alarm != new:
            self.handle.deleteTimer(alarm)
        if new is None:
            self.held.clear()
            return
        if alarm != new:
            self.handle.registerTimer(new)
        self.held.update((waiting, start, n, new))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # whole seconds at or before the time, also before 1970
        times = [t for batch in rows for t in (batch["t"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist()]
        waiting, start, n, alarm = self.held.get() or ([], None, 0, None)
        self._keep([*waiting, *times], start, n, alarm)
        # nothing rather than an empty frame, which costs as much as one with rows
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # whole seconds before this one are past
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        # the timer that went off is gone by itself
        waiting, start, n, _ = self.held.get() or ([], None, 0, None)
        times = sorted(waiting)
        past, later = [t for t in times if t < mark], [t for t in times if t >= mark]
        done = []
        for t in past:
            if start is None or t - start > self.gap:
                done.append((start, n))
                start, n = t, 0
            n += 1
        if start is not None and start + self.gap < mark:
            done.append((start, n))
            start, n = None, 0
        self._keep(later, start, n, None)
        done = [(s, n) for s, n in done if n > 1]
        if done:
            yield self._sent(key, done)

    @staticmethod
    def _sent(key: tuple, done: list[tuple[int, int]]) -> pd.DataFrame:
        starts = pd.to_datetime(pd.Series([s for s, _ in done], dtype="int64"), unit="s")
        return pd.DataFrame({"session_id": pd.Series([key[0]] * len(done), dtype="int64"), "start": starts, "photos": pd.Series([n for _, n in done], dtype="int64")})

    def close(self) -> None:
        pass


def bursts(stream: DataFrame, gap: int = 3, late: str = "1 hour") -> DataFrame:
    """(session_id, start, photos): bursts measured from their first frame, sent once no frame can join them any more.

    Frames that come later than the watermark are dropped and counted by Spark (`late_rows`).  Runs on the RocksDB store, see `settled`.
    """
    rows = stream.withWatermark("t", late).select("session_id", "t")
    return rows.groupBy("session_id").transformWithStateInPandas(BurstProcessor(gap), "session_id long, start timestamp, photos long", "append", "EventTime")


def late_rows(progress: list) -> int:
    """Rows that a finished stream dropped because the watermark had passed them, from its progress reports."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
