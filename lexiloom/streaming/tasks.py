"""Task queues and service metrics as Structured Streaming queries; the same
functions run over batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = "task_id string, batch_id string, status string, phase string, retry int, chunks int, started_at double, completed_at double, error string"
OUTPUT = STATE


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(ts, event_type, value) -> counts, errors and values of tumbling or sliding
    windows; ``late`` is a stream's watermark."""
    if late:
        events = events.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    agg = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "most")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(ts, user_id, value) -> sessions of a user with no pause of ``gap``."""
    if late:
        events = events.withWatermark("ts", late)
    agg = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def batch_rollup(tasks: DataFrame) -> DataFrame:
    """(batch_id, task_id, status) -> how many of a batch are completed and
    failed, and whether all are."""
    agg = tasks.groupBy("batch_id").agg(F.count("*").alias("total"), F.sum((F.col("status") == "completed").cast("long")).alias("completed"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"))
    return agg.withColumn("done", F.col("completed") + F.col("failed") >= F.col("total"))


def _ranged(events: DataFrame, by: str, width: str) -> DataFrame:
    """Adds _slice (``width`` of time) and what a key had before it (_rows, and
    _failed of a column of that name), from counts of slices; so running numbers
    are taken in slices and no key is one task."""
    cut = events.withColumn("_slice", F.window("ts", width)["start"])
    failed = "_failed" in events.columns
    sums = cut.groupBy(by, "_slice").agg(F.count("*").alias("_n"), *([F.sum("_failed").alias("_f")] if failed else []))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_rows": F.coalesce(F.sum("_n").over(before), F.lit(0))} | ({"_before": F.coalesce(F.sum("_f").over(before), F.lit(0))} if failed else {})
    return cut.join(sums.withColumns(carried).drop("_n", "_f"), [by, "_slice"])


def error_alerts(events: DataFrame, failed: Column, by: str, least: int = 20, every: int = 10, rate: float = 0.05, width: str = "1 day") -> DataFrame:
    """Every tenth event of a key from the twentieth on at which the rate of
    failures so far is at least ``rate``."""
    ranged = _ranged(events.withColumn("_failed", failed.cast("long")), by, width)
    so_far = Window.partitionBy(by, "_slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumns({"n": F.col("_rows") + F.count("*").over(so_far), "errors": F.col("_before") + F.sum("_failed").over(so_far)})
    return counted.where((F.col("n") >= least) & (F.col("n") % every == 0) & (F.col("errors") / F.col("n") >= rate)).select(by, "event_id", "n", "errors")


def rolling(events: DataFrame, by: str, value: str, rows: int = 1000, width: str = "1 day") -> DataFrame:
    """Mean and maximum of the last ``rows`` values of a key at every event. A
    key's events are numbered in slices of time, and each stretch of ``rows``
    numbers is worked out with the stretch before it."""
    numbered = _ranged(events, by, width)
    at = Window.partitionBy(by, "_slice").orderBy("ts", "event_id")
    numbered = numbered.select(by, "ts", "event_id", F.col(value).alias("_v"), F.floor((F.col("_rows") + F.row_number().over(at) - 1) / rows).alias("_b"))
    both = numbered.select(by, "ts", "event_id", "_v", F.explode(F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own")))).alias("x")).select(by, "ts", "event_id", "_v", "x.*")
    last = Window.partitionBy(by, "b").orderBy("ts", "event_id").rowsBetween(1 - rows, 0)
    return both.select(by, "event_id", "own", F.avg("_v").over(last).alias("mean"), F.max("_v").over(last).alias("most"), F.count("_v").over(last).alias("n")).where("own").drop("own")


def enqueue(messages: DataFrame, ttl: int = 24 * 3600) -> tuple[DataFrame, DataFrame]:
    """Task messages (task_id, batch_id, file_path, source, user_id, at) -> the
    pending states of their tasks, with when they expire, and a row for each batch."""
    states = messages.dropDuplicates(["task_id"]).select("task_id", "batch_id", "source", "user_id", F.lit("pending").alias("status"), F.lit("queued").alias("phase"), F.lit(0).alias("retry"), F.col("at").alias("started_at"), (F.col("at") + ttl).alias("expires_at"))
    batches = states.groupBy("batch_id").agg(F.count("*").alias("total")).withColumns({"completed": F.lit(0).cast("long"), "failed": F.lit(0).cast("long")})
    return states, batches


def replay_cache(requests: DataFrame, ttl: int = 300) -> DataFrame:
    """(key, ts) requests in order -> whether a cache with this time to live would
    have answered each. An entry is written at a miss and lives ``ttl`` seconds from then."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, written = None, 0.0
        for batch in batches:
            hits = []
            for k, at in zip(batch["key"], batch["at"], strict=True):
                hit = k == key and at - written <= ttl
                hits.append(hit)
                if not hit:
                    key, written = k, at
            yield batch.assign(hit=hits)

    timed = requests.select("key", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return timed.repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, "key string, at double, hit boolean")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A task's messages in order: started, then completed or failed; a failure
    goes back to pending, in the high queue, three times at most."""
    if state.hasTimedOut:
        state.remove()
        return
    batch, status, phase, retry, chunks, started, completed, error = state.get if state.exists else (None, "pending", "queued", 0, 0, None, None, None)
    messages = pd.concat(list(batches)).sort_values("at")
    for m in messages.itertuples():
        batch = m.batch_id
        if status in ("completed", "failed"):
            continue
        if m.event == "started":
            status, phase, started = "processing", "parsing", m.at
        elif m.event == "completed":
            status, phase, completed, chunks = "completed", "done", m.at, int(m.chunks)
        elif m.event == "failed":
            error = m.error
            status, phase, retry = ("pending", "queued high", retry + 1) if retry < 3 else ("failed", "done", retry)
    state.update((batch, status, phase, retry, chunks, started, completed, error))
    state.setTimeoutDuration(24 * 3600 * 1000)
    yield pd.DataFrame([(key[0], batch, status, phase, retry, chunks, started, completed, error)], columns=[x.split()[0] for x in OUTPUT.split(", ")])


def task_states(messages: DataFrame) -> DataFrame:
    """A stream (task_id, batch_id, event, at, chunks, error) -> each touched
    task's state, in update mode; a state is dropped a day after its last message."""
    state = STATE.removeprefix("task_id string, ")
    return messages.groupBy("task_id").applyInPandasWithState(_advance, OUTPUT, state, "update", "ProcessingTimeTimeout")


def prioritized(messages: DataFrame, priority: str = "priority") -> DataFrame:
    """Messages of one micro-batch, high priority first, then as they came."""
    return messages.orderBy((F.col(priority) != "high").cast("int"), "at", "task_id")
