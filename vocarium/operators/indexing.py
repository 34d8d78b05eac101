"""The search index as a table: reconcile, upsert, delete, cascades, change feed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vocarium.functions import identity, text as tx
from vocarium.operators.filters import active_tasks, task_references, videos_with_work
from vocarium.operators.ranking import latest

def reconcile(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Findings of a comparison of chunk table and index: ``(chunk_id, category)``.

    A chunk may have both a metadata and a text finding; texts are compared trimmed.
    """
    source = chunks.select("id", F.col("video_id").alias("v"), F.col("chunk_index").alias("i"),
                           tx.strip(F.coalesce("text", F.lit(""))).alias("t"), F.lit(True).alias("stored"))
    other = index.select("id", F.col("video_id").alias("v2"), F.col("chunk_index").alias("i2"),
                         tx.strip(F.coalesce("text", F.lit(""))).alias("t2"), F.lit(True).alias("indexed"))
    both = F.col("stored").isNotNull() & F.col("indexed").isNotNull()
    found = F.array_compact(F.array(
        F.when(F.col("indexed").isNull(), "missing_in_index"),
        F.when(F.col("stored").isNull(), "orphan_in_index"),
        F.when(both & ~(F.col("v").eqNullSafe(F.col("v2")) & F.col("i").eqNullSafe(F.col("i2"))),
               "index_metadata_mismatch"),
        F.when(both & (F.col("t") != F.col("t2")), "index_text_mismatch")))
    return source.join(other, "id", "full_outer").select(
        F.col("id").alias("chunk_id"), F.coalesce("v", "v2").alias("video_id"),
        F.coalesce("i", "i2").alias("chunk_index"), F.explode(found).alias("category"))


def upsert_points(points: DataFrame, changes: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """Table after replacing rows by key with the newest change of each."""
    newest = latest(changes, [key], [version])
    return points.join(newest.select(key), key, "left_anti").unionByName(newest.drop(version))


def delete_points(points: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return points.join(ids.select(key), key, "left_anti")


def unembedded(chunks: DataFrame, index: DataFrame) -> DataFrame:
    return chunks.join(index.select("id"), "id", "left_anti")


def backfill(chunks: DataFrame, videos: DataFrame, generation_id: int) -> DataFrame:
    """Fill identities that are null; ids and content stay as they are."""
    sources = videos.select(F.col("id").alias("video_id"), "source_file_id")
    return chunks.join(sources, "video_id").withColumns({
        "logical_id": F.coalesce("logical_id", identity.logical_id(F.col("source_file_id"), F.col("chunk_index"))),
        "content_hash": F.coalesce("content_hash", identity.content_hash(F.col("text"), F.col("start_sec"), F.col("end_sec"))),
        "generation_id": F.coalesce("generation_id", F.lit(generation_id).cast("bigint")),
    }).drop("source_file_id")


def chunk_set_hash(chunks: DataFrame) -> DataFrame:
    """SHA-256 of the ordered ``logical_id:content_hash`` lines of every video: ``(video_id, set_hash)``.

    A task holds one digest and feeds it line by line, so a video of any size takes bounded memory.
    """
    line = F.concat(F.col("logical_id"), F.lit(":"), F.col("content_hash"), F.lit("\n"))
    ordered = (
        chunks.select("video_id", "chunk_index", "id", line.alias("line")).repartition("video_id")
        .sortWithinPartitions("video_id", "chunk_index", "id").select("video_id", "line"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for video, lines in groupby(rows, key=itemgetter(0)):
            digest = hashlib.sha256()
            for _, text in lines:
                digest.update((text or "").encode())
            yield pa.RecordBatch.from_pydict({"video_id": pa.array([video], pa.int64()), "set_hash": [digest.hexdigest()]})

    return ordered.mapInArrow(digests, "video_id BIGINT, set_hash STRING")


def stale_snapshot_guard(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Videos whose chunk set is still the one that was read."""
    now = current.select("video_id", F.col("set_hash").alias("now_hash"))
    joined = snapshot.join(now, "video_id", "left")
    same = F.col("set_hash").eqNullSafe(F.col("now_hash"))
    return joined.select("video_id", F.when(same, "publish").otherwise("stale").alias("decision"))


def indexed_per_generation(outbox: DataFrame) -> DataFrame:
    """Distinct chunks of completed upserts per generation."""
    done = outbox.filter("event_type = 'upsert' AND status = 'completed'")
    # De-duplicated first: the distinct rows spread over all tasks, however few generations there are.
    return done.select("generation_id", "chunk_id").distinct().groupBy("generation_id").agg(
        F.count("*").alias("indexed_chunks"))


def apply_outbox(points: DataFrame, outbox: DataFrame, content: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Index after the feed: the last event of a chunk decides.

    Deletes act only after every replacement is in place, so a failure before that leaves the
    old rows searchable.
    """
    last = outbox.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_key")).alias("event_type"))
    fresh = content.join(last.filter("event_type = 'upsert'").select(key), key, "left_semi")
    replaced = points.join(fresh.select(key), key, "left_anti").unionByName(fresh)
    return replaced.join(last.filter("event_type = 'delete'").select(key), key, "left_anti")


def complete_events(outbox: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Outbox with exactly the snapshotted open events completed."""
    taken = snapshot.select("event_id", F.lit(True).alias("taken")).distinct()
    open_event = F.col("status").isin("pending", "processing")
    return outbox.join(taken, "event_id", "left").withColumn("status", F.when(
        F.coalesce("taken", F.lit(False)) & open_event, "completed").otherwise(F.col("status"))).drop("taken")


def mark_silent(videos: DataFrame, chunks: DataFrame, tasks: DataFrame, issues: DataFrame,
                silent: DataFrame) -> dict[str, DataFrame]:
    """Tables after marking videos silent: their chunks, tasks and findings go."""
    ids = silent.select("id").distinct()
    hit = videos.join(ids.withColumn("hit", F.lit(True)), "id", "left")
    named = videos.join(ids, "id", "left_semi")
    return {
        "videos": hit.withColumns({
            "is_silent": F.coalesce("hit", "is_silent"),
            "status": F.when(F.col("hit"), "indexed_chunks_ready").otherwise(F.col("status"))}).drop("hit"),
        "chunks": chunks.join(ids.withColumnRenamed("id", "video_id"), "video_id", "left_anti"),
        "tasks": tasks.join(_tasks_about(named, tasks), "id", "left_anti"),
        "issues": drop_issues(issues, ids),
    }


def _tasks_about(videos: DataFrame, tasks: DataFrame) -> DataFrame:
    refs = task_references(tasks)
    by_number = refs.join(videos.select(F.col("id").alias("ref_video_id")), "ref_video_id", "left_semi")
    by_file = refs.join(videos.select(F.col("source_file_id").alias("ref_file_id")), "ref_file_id", "left_semi")
    return by_number.select(F.col("task_id").alias("id")).unionByName(by_file.select(F.col("task_id").alias("id"))).distinct()


def drop_issues(issues: DataFrame, video_ids: DataFrame) -> DataFrame:
    """Findings that do not name one of the videos."""
    named = issues.withColumn("_video", tx.issue_video_id(F.col("message")))
    return named.join(video_ids.select(F.col("id").alias("_video")), "_video", "left_anti").drop("_video")


def delete_videos(videos: DataFrame, chunks: DataFrame, tasks: DataFrame, issues: DataFrame,
                  wanted: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting videos; those with open work are refused and stay."""
    ids = wanted.select("id").distinct().join(videos.select("id"), "id", "left_semi")
    gone = ids.join(videos_with_work(videos, active_tasks(tasks)), "id", "left_anti")
    orphaned = gone.select(F.col("id").alias("original_id"), F.lit(True).alias("lost"))
    rest = videos.join(gone, "id", "left_anti").join(orphaned, "original_id", "left")
    return {
        "refused": ids.join(gone, "id", "left_anti"),
        "videos": rest.withColumn("original_id", F.when(F.col("lost").isNull(), F.col("original_id"))).drop("lost"),
        "chunks": chunks.join(gone.withColumnRenamed("id", "video_id"), "video_id", "left_anti"),
        "issues": drop_issues(issues, gone),
    }


def export_transcripts(chunks: DataFrame, folder: str, buckets: int = 64) -> None:
    """Write the chunk texts as JSON lines, the lines of a video one after the other in one file.

    Files are dealt by a hash of the video. Sorting spills, so a transcript may have any length.
    """
    (chunks.select("video_id", "chunk_index", "id", "text").repartition(buckets, "video_id")
     .sortWithinPartitions("video_id", "chunk_index", "id").write.mode("overwrite").json(folder))


def orderless_digest(df: DataFrame) -> DataFrame:
    """Row count and a digest that does not depend on row order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("hash_xor"),
                  F.coalesce(F.sum(F.pmod(row, F.lit(1_000_003))), F.lit(0)).alias("hash_sum"))


def coverage(chunks: DataFrame, index: DataFrame) -> DataFrame:
    stored = chunks.agg(F.count("*").alias("n")).scalar()
    return index.agg(F.count("*").alias("indexed")).withColumn("stored", stored).withColumn(
        "ok", F.col("stored") == F.col("indexed"))

