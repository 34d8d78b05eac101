"""Streams over the archive's feeds: outbox, tasks, history, leases, queue depth and ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vocarium.functions import identity
from vocarium.operators.people import HISTORY_KEPT, LEASE_SEC
from vocarium.streaming.sinks import drain_append, drain_batches, drain_update, store, stored

MAX_RETRIES = identity.DEFAULT_MAX_RETRIES


# -- change feed ---------------------------------------------------------------------------

def _last_per_chunk(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("event_type", "version", "event_key"), F.struct("version", "event_key")).alias("e")
    return events.groupBy("chunk_id").agg(last).select("chunk_id", "e.*")


_CHANGE = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("event_type", T.StringType()),
                        T.StructField("version", T.LongType()), T.StructField("event_key", T.StringType())])

#: Batches of changes after which the state is written as a whole.
FOLDED = 64


def _unique(outbox: DataFrame, delay: str) -> DataFrame:
    return outbox.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_key"]).select(
        "chunk_id", "event_type", "version", "event_key")


def apply_outbox_stream(outbox: DataFrame, folder: str, delay: str) -> DataFrame:
    """Index state after an idempotent feed: ``(chunk_id, event_type, version, event_key)``.

    The highest version of a chunk wins, whenever it arrives; deleted chunks stay as markers, so
    that an older upsert arriving later cannot bring them back. Each batch writes only its own
    changes; every ``FOLDED`` batches the state before and the changes since are folded into one.
    ``delay`` is how much later than the newest event a repeat of an event key may come and still
    be dropped; after that it is read again, which leaves the state as it is.
    """
    spark = outbox.sparkSession

    def state(upto: int) -> DataFrame:
        base = (upto + 1) // FOLDED * FOLDED - 1
        changes = stored(spark, folder, _CHANGE).filter(F.col("batch").between(max(base, -1) + 1, upto)).drop("batch")
        if base > 0:
            changes = changes.unionByName(spark.read.schema(_CHANGE).parquet(f"{folder}/state/upto={base}"))
        return _last_per_chunk(changes)

    def apply(batch: DataFrame, number: int) -> None:
        store(_last_per_chunk(batch), folder, number)
        if (number + 1) % FOLDED == 0:
            before = state(number - 1).unionByName(
                stored(spark, folder, _CHANGE).filter(F.col("batch") == number).drop("batch"))
            _last_per_chunk(before).write.mode("overwrite").parquet(f"{folder}/state/upto={number}")

    store(spark.createDataFrame([], _CHANGE), folder, -1)
    drain_batches(_unique(outbox, delay), folder, apply)
    # The highest number of a folder; the empty first batch is read only where there is no other.
    newest = stored(spark, folder, _CHANGE).agg(F.max("batch")).first()[0]
    return state(-1 if newest is None else newest)


def live_chunks(state: DataFrame) -> DataFrame:
    return state.filter("event_type = 'upsert'").select("chunk_id", "version")


def deletes_after_upserts(outbox: DataFrame, folder: str, delay: str) -> DataFrame:
    """Order of index writes of every batch: all upserts, then the deletes.

    Gives ``(step, chunk_id, event_type)``; a step is the batch number doubled, plus one for its
    deletes, so a failure between the two leaves every old row searchable.
    """
    spark = outbox.sparkSession
    schema = T.StructType(_CHANGE.fields[:2])

    def apply(batch: DataFrame, number: int) -> None:
        last = _last_per_chunk(batch).select("chunk_id", "event_type").persist()
        store(last.filter("event_type = 'upsert'"), folder, 2 * number)
        store(last.filter("event_type = 'delete'"), folder, 2 * number + 1)
        last.unpersist()

    store(spark.createDataFrame([], schema), folder, -1)
    drain_batches(_unique(outbox, delay), folder, apply)
    return stored(spark, folder, schema).withColumnRenamed("batch", "step")


# -- stateful keys -------------------------------------------------------------------------

_TASK = "user_id BIGINT, retries INT, status STRING"


def _task_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Failures since the last success, which does not depend on arrival order.

    Only the newest few failures matter, as after these a task is given up; the state is
    bounded whatever the number of events.
    """
    success, failures = state.get if state.exists else (0, [])
    failures = list(failures)
    for batch in batches:
        failed = batch["event_type"] == "error"
        if (~failed).any():
            success = max(success, int(batch.loc[~failed, "at"].max()))
        failures = sorted(failures + batch.loc[failed, "at"].nlargest(MAX_RETRIES).astype(int).tolist())[-MAX_RETRIES:]
    failures = [t for t in failures if t > success]
    state.update((success, failures))
    status = "failed" if len(failures) >= MAX_RETRIES else "pending" if failures else "completed"
    yield pd.DataFrame({"user_id": [key[0]], "retries": [len(failures)], "status": [status]})


def task_states(runs: DataFrame, folder: str) -> DataFrame:
    """Current state of every task from its run events ``(user_id, event_type, ts)``."""
    slim = runs.select("user_id", "event_type", F.unix_micros("ts").alias("at"))
    states = slim.groupBy("user_id").applyInPandasWithState(
        _task_state, _TASK, "success BIGINT, failures ARRAY<BIGINT>", "update", GroupStateTimeout.NoTimeout)
    return drain_update(states, folder, ["user_id"])


_HISTORY = "user_id STRING, queries ARRAY<STRING>"


def _history_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    times: dict[str, int] = dict(zip(*state.get)) if state.exists else {}
    for batch in batches:
        for query, at in batch.groupby("query")["at"].max().items():
            times[query] = max(times.get(query, 0), int(at))
        newest = sorted(times.items(), key=lambda item: (-item[1], item[0]))[:HISTORY_KEPT]
        times = dict(newest)
    state.update((list(times), list(times.values())))
    yield pd.DataFrame({"user_id": [key[0]], "queries": [list(times)]})


def history_newest(log: DataFrame, folder: str) -> DataFrame:
    """Newest distinct queries of every user, newest first; the state holds no more than is kept."""
    slim = log.select("user_id", "query", F.unix_micros("created_at").alias("at"))
    lists = slim.groupBy("user_id").applyInPandasWithState(
        _history_state, _HISTORY, "queries ARRAY<STRING>, times ARRAY<BIGINT>", "update", GroupStateTimeout.NoTimeout)
    return drain_update(lists, folder, ["user_id"])


_LEASE = "chunk_id BIGINT, holder STRING, granted BIGINT, refused BIGINT"


def _lease_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    holder, since, granted, refused = state.get if state.exists else (None, 0, 0, 0)
    requests = pd.concat(batches).sort_values(["at", "event_id"])
    for user, at in zip(requests["user_id"], requests["at"]):
        if holder is None or user == holder or at > since + LEASE_SEC * 1_000_000:
            holder, since, granted = user, int(at), granted + 1
        else:
            refused += 1
    state.update((holder, since, granted, refused))
    yield pd.DataFrame({"chunk_id": [key[0]], "holder": [holder], "granted": [granted], "refused": [refused]})


def flag_leases(requests: DataFrame, folder: str) -> DataFrame:
    """Holder of every flag after requests ``(chunk_id, user_id, event_id, ts)`` in order of time.

    The holder renews, others are refused until the lease has run out. A batch is bounded by
    the source's limit per trigger, and with it the requests of one flag held at once.
    """
    slim = requests.select("chunk_id", "user_id", "event_id", F.unix_micros("ts").alias("at"))
    leases = slim.groupBy("chunk_id").applyInPandasWithState(
        _lease_state, _LEASE, "holder STRING, since BIGINT, granted BIGINT, refused BIGINT", "update",
        GroupStateTimeout.NoTimeout)
    return drain_update(leases, folder, ["chunk_id"])


# -- windows -------------------------------------------------------------------------------

def queue_depth(tasks: DataFrame, folder: str, delay: str = "1 hour") -> DataFrame:
    """Tasks per day, status and stage."""
    counts = tasks.withWatermark("created_at", delay).groupBy(
        F.window("created_at", "1 day").alias("w"), "status", "task_type").agg(F.count("*").alias("n"))
    flat = counts.select(F.unix_seconds("w.start").alias("day"), "status", "task_type", "n")
    return drain_update(flat, folder, ["day", "status", "task_type"])


def sliding_failures(tasks: DataFrame, folder: str, delay: str = "10 minutes") -> DataFrame:
    """Failures and their permanent share over ten minutes, every minute."""
    failed = tasks.filter("status = 'failed'").withColumn("permanent", identity.permanent_error(F.col("error_message")))
    counts = failed.withWatermark("created_at", delay).groupBy(
        F.window("created_at", "10 minutes", "1 minute").alias("w")).agg(
        F.count("*").alias("failures"), F.sum(F.col("permanent").cast("bigint")).alias("permanent"))
    flat = counts.select(F.unix_seconds("w.start").alias("minute"), "failures", "permanent")
    return drain_update(flat, folder, ["minute"])


def pause_sessions(speech: DataFrame, folder: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Stretches of events of a key without a pause of ``gap``; open stretches are not given yet."""
    sessions = speech.withWatermark("ts", delay).groupBy(
        F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    flat = sessions.select("user_id", F.unix_micros("w.start").alias("start"), "n")
    return drain_append(flat, folder)


def windows_without_late(events: DataFrame, folder: str, window: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Events per window; what arrives after the watermark has passed its window is dropped."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return drain_update(counts.select(F.unix_seconds("w.start").alias("start"), "n"), folder, ["start"])


# -- stream and table ----------------------------------------------------------------------

def ingest_decisions(files: DataFrame, videos: DataFrame, folder: str, delay: str) -> DataFrame:
    """First sight of every file id ``(file_id, ts)``: known already, or to be queued.

    A file that is reported again later than ``delay`` after the newest report is decided again.
    """
    known = videos.select(F.col("source_file_id").alias("file_id"), F.col("id").alias("video_id"))
    first = files.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_id"]).select("file_id")
    decided = first.join(known, "file_id", "left").select("file_id", F.when(
        F.col("video_id").isNull(), "queued").otherwise("already_indexed").alias("decision"))
    return drain_append(decided, folder)


def running_with_titles(tasks: DataFrame, videos: DataFrame, folder: str) -> DataFrame:
    """Running tasks with the title of their video."""
    titles = videos.select(F.col("id").alias("video_id"), "title")
    running = tasks.filter("status = 'running'").join(titles, "video_id", "left")
    return drain_append(running.select("id", "task_type", "title"), folder)
