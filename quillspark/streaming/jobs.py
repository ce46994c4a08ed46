"""The batch operators on streams: incremental indexing, duplicate suppression, task state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILES = "path string, size long, mtime timestamp"


def index_new_files(spark: SparkSession, listings: str, checkpoint: str, indexed: Callable[[], DataFrame], work: Callable[[DataFrame], None], once: bool = True):
    """Reads file lists (Parquet of ``FILES``) as they arrive and hands ``work`` the newest version of each path
    whose path and mtime are not in ``indexed()``. ``work`` may run again for a batch, so it has to be an upsert."""

    def batch(rows: DataFrame, _: int) -> None:
        newest = rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime"), F.struct("mtime", "size")).alias("last")).select("path", "last.*")
        work(newest.join(indexed().select("path", "mtime"), ["path", "mtime"], "left_anti"))

    stream = spark.readStream.schema(FILES).parquet(listings).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="5 seconds")).start()


def suppress_duplicates(tasks: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Tasks (file_path, task_type, added_at) without those that repeat another within the time; the watermark
    bounds the state."""
    return tasks.withWatermark("added_at", within).dropDuplicatesWithinWatermark(["file_path", "task_type"])


def task_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, stuck_after_ms: int) -> Iterator[pd.DataFrame]:
    """One task's events of a batch, or its timeout, which leaves the place in the log as it was: older events
    that come late stay without effect."""
    seq, status, failures = state.get if state.exists else (-1, "pending", 0)
    if state.hasTimedOut:
        status = "pending" if status == "processing" else status
    else:
        for f in frames:
            failures += int((f.status == "failed").sum())
            last = f.loc[f.seq.idxmax()]
            if last.seq > seq:
                seq, status = int(last.seq), last.status
    state.update((seq, status, failures))
    if status == "processing":
        state.setTimeoutDuration(stuck_after_ms)
    yield pd.DataFrame({"task": [key[0]], "status": [status], "failures": [failures]})


def task_states(events: DataFrame, stuck_after_ms: int = 600_000) -> DataFrame:
    """task, status, failures after each batch of events (task, seq, status); a task that stays in processing
    past the limit goes back to pending."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return task_step(key, frames, state, stuck_after_ms)

    return events.groupBy("task").applyInPandasWithState(
        step, "task long, status string, failures long", "seq long, status string, failures long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


class TaskProcessor(StatefulProcessor):
    """The state of one task: its last event, its last start and its failures (times in microseconds). A task in
    processing has a timer, after which it is pending again, unless a later event has come."""

    STATE = "us long, seq long, status string, started_us long, failures long"
    SCHEMA = "task long, status string, started_us long, failures long"

    def __init__(self, stuck_after_ms: int):
        self.stuck_after_ms = stuck_after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.STATE)

    def _timer(self, us: int) -> int:
        return us // 1000 + self.stuck_after_ms

    def _put(self, key: tuple, us: int, seq: int, status: str, started: int | None, failures: int) -> pd.DataFrame:
        self.last.update((us, seq, status, started, failures))
        started = pd.Series([started], dtype="Int64")
        return pd.DataFrame({"task": [key[0]], "status": [status], "started_us": started, "failures": [failures]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, seq, status, started, failures = self.last.get() if self.last.exists() else (-(2**62), -1, "pending", None, 0)
        if status == "processing":
            self.handle.deleteTimer(self._timer(us))
        for f in rows:
            failures += int((f.status == "failed").sum())
            starts = f.us[f.status == "processing"]
            if len(starts):
                started = max(int(starts.max()), -(2**62) if started is None else started)
            newest = f.sort_values(["us", "seq"]).iloc[-1]
            if (newest.us, newest.seq) > (us, seq):
                us, seq, status = int(newest.us), int(newest.seq), str(newest.status)
        if status == "processing":
            self.handle.registerTimer(self._timer(us))
        yield self._put(key, us, seq, status, started, failures)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, seq, _, started, failures = self.last.get()
        yield self._put(key, us, seq, "pending", started, failures)

    def close(self) -> None:
        pass


def task_machine(events: DataFrame, stuck_after_ms: int = 600_000, late: str = "0 seconds") -> DataFrame:
    """As ``TaskProcessor.SCHEMA``: a row for each task of (task, seq, ts, status) with news. Times are those of the
    events: a task in processing is pending again once the log has gone on for longer than the limit. Needs the state
    store that ``state_store`` sets."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select("task", "seq", "status", ts.alias("ts"), F.unix_micros(ts).alias("us"))
    return rows.withWatermark("ts", late).groupBy("task").transformWithStateInPandas(
        TaskProcessor(stuck_after_ms), TaskProcessor.SCHEMA, outputMode="Update", timeMode="EventTime"
    )


@contextmanager
def state_store(spark: SparkSession, provider: str = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
    """The session's streams keep their state in ``provider`` meanwhile; what was set before comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(source: str, batches: Iterable[DataFrame], start: Callable[[], object]) -> None:
    """Appends each of ``batches`` to the folder ``source`` and then runs the stream that ``start`` starts until it has read
    all there is; each run but the first goes on from the checkpoint of the one before."""
    for rows in batches:
        rows.write.mode("append").parquet(source)
        start().awaitTermination()


def versions(rows: DataFrame, out: str, checkpoint: str, mode: str = "update"):
    """Writes what a stream gives in a folder for each of its batches; a batch that runs again replaces its own."""

    def batch(rows: DataFrame, n: int) -> None:
        rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/run={n}")

    stream = rows.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_versions(spark: SparkSession, out: str, schema: str, *keys: str) -> DataFrame:
    """The newest row of each key that ``versions`` has written, of ``schema``."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(out)
    own = [c for c in rows.columns if c not in ("batch", "run", *keys)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("x")).select(*keys, "x.*")


def summary_stream(parts: DataFrame, out: str, checkpoint: str):
    """Upserts doc_id, part, text of a stream of partial summaries (doc_id, part, text) as they come: each batch is
    a folder of its own under ``out``, so a batch that runs again replaces itself. ``read_summaries`` joins them."""

    return versions(parts, out, checkpoint, "append")


def read_summaries(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, parts, text: what is there of each summary, its parts in order; of a part's versions the newest."""
    rows = spark.read.schema("doc_id long, part int, text string, batch long").parquet(out)
    last = rows.groupBy("doc_id", "part").agg(F.max_by("text", "batch").alias("text"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return last.groupBy("doc_id").agg(F.count("part").alias("parts"), F.array_join(texts, "\n\n").alias("text"))
