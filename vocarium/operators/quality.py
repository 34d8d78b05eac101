"""Integrity audit: every check gives rows of one issues table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vocarium.functions import identity, text as tx
from vocarium.operators import dedupe, indexing, ranking, vectors
from vocarium.operators.filters import active_tasks
from vocarium.operators.folders import folder_cycles

DONE = ("completed", "indexed_chunks_ready")

#: Report categories by the wording of a message, first match wins.
REPORT_CATEGORIES = (
    ("zero_chunks", "0 chunks in DB!"),
    ("low_wpm", "Low WPM density"),
    ("chunk_mismatch", "chunk count mismatch"),
    ("missing_raw", "Missing RAW at"),
    ("missing_norm", "Missing NORMALIZED at"),
    ("corrupted_raw", "Corrupted RAW JSON"),
    ("corrupted_norm", "Corrupted NORM JSON"),
    ("text_mismatch", "Text mismatch between DB and JSON"),
    ("manticore_missing", "Chunks in SQLite missing in Manticore"),
    ("manticore_orphan", "Orphan points in Manticore"),
    ("manticore_text_mismatch", "Manticore text mismatch for chunk ID"),
    ("manticore_meta_mismatch", "Manticore metadata mismatch for chunk ID"),
    ("db_sequence_errors", "Chunk sequence errors in DB"),
    ("db_time_errors", "Chunk time logic errors"),
    ("orphan_raw_delete_failed", "Failed to delete orphan RAW file"),
    ("orphan_norm_delete_failed", "Failed to delete orphan NORMALIZED file"),
    ("manticore_query_failed", "Manticore query failed"),
)


def issues(df: DataFrame, severity: str, category: str | Column, message: Column, *context: str) -> DataFrame:
    """Shape rows of a check as issues; context values become text."""
    pairs = [part for c in context for part in (F.lit(c), F.col(c).cast("string"))]
    kind = F.lit(category) if isinstance(category, str) else category
    return df.select(F.lit(severity).alias("severity"), kind.alias("category"), message.alias("message"),
                     F.create_map(*pairs).alias("context"))


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows that refer to a missing parent; a null reference is no reference."""
    return child.filter(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti")


def foreign_keys(checks: Sequence[tuple[str, DataFrame, str, DataFrame]]) -> DataFrame:
    """Dangling references of every (table, child, column, parent) as issues."""
    out = None
    for table, child, column, parent in checks:
        bad = dangling(child, column, parent).select(F.col("id").cast("string").alias("rowid"),
                                                    F.lit(table).alias("table"), F.lit(column).alias("column"))
        rows = issues(bad, "error", "foreign_key",
                      F.concat(F.lit(f"Foreign-key violation in table {table} at rowid "), "rowid"),
                      "table", "rowid", "column")
        out = rows if out is None else out.unionByName(rows)
    return out


def active_work(tasks: DataFrame) -> DataFrame:
    count = active_tasks(tasks).agg(F.count("*").alias("n")).filter("n > 0")
    return issues(count, "warning", "worker_active",
                  F.concat(F.lit("There are "), F.col("n").cast("string"), F.lit(" pending or running tasks")), "n")


def missing_source_id(videos: DataFrame) -> DataFrame:
    bad = originals(videos).filter(F.coalesce("source_file_id", F.lit("")) == "")
    return issues(bad, "error", "missing_source_file_id",
                  F.concat(F.lit("Video "), F.col("id").cast("string"), F.lit(" has no source_file_id")), "id", "title")


def originals(videos: DataFrame) -> DataFrame:
    return videos.filter("original_id IS NULL AND NOT is_silent")


def missing_files(videos: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Transcripts of a kind that are not on disk or cannot be read; ``files`` has path and corrupt."""
    wanted = originals(videos).filter(F.coalesce("source_file_id", F.lit("")) != "").withColumn(
        "path", identity.path_layout(F.col("source_file_id"), kind))
    joined = wanted.join(files.select("path", "corrupt"), "path", "left")
    bad = joined.filter(F.col("corrupt").isNull() | F.col("corrupt"))
    category = F.when(F.col("corrupt"), f"corrupt_{kind}").otherwise(f"missing_{kind}")
    message = F.concat(F.when(F.col("corrupt"), "Invalid ").otherwise("Missing "), F.lit(f"{kind} transcript: "), "path")
    return issues(bad, "error", category, message, "id", "source_file_id")


def orphan_files(videos: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    wanted = originals(videos).select(identity.path_layout(F.col("source_file_id"), kind).alias("path"))
    stray = files.select("path").join(wanted, "path", "left_anti")
    return issues(stray, "warning", f"orphan_{kind}",
                  F.concat(F.lit(f"{kind} transcript is not referenced: "), "path"), "path")


def chunk_count(videos: DataFrame, stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Originals whose stored chunk count is not what their transcript gives."""
    have = stored.groupBy("video_id").agg(F.count("*").alias("stored_count"))
    want = derived.groupBy("video_id").agg(F.count("*").alias("derived_count"))
    joined = (
        originals(videos).select(F.col("id").alias("video_id"), "title")
        .join(have, "video_id", "left").join(want, "video_id", "left").fillna(0, ["stored_count", "derived_count"]))
    return issues(joined.filter("stored_count <> derived_count"), "error", "chunk_count_mismatch",
                  F.concat(F.lit("Video "), F.col("video_id").cast("string"), F.lit(" chunk count differs")),
                  "video_id", "stored_count", "derived_count")


def first_text(videos: DataFrame, stored: DataFrame, utterances: DataFrame) -> DataFrame:
    """Originals whose first chunk does not start with their first utterance."""
    chunk = stored.groupBy("video_id").agg(F.min_by("text", "chunk_index").alias("chunk_text"))
    spoken = utterances.filter("pos = 0").select("video_id", F.col("text").alias("spoken"))
    joined = originals(videos).select(F.col("id").alias("video_id")).join(chunk, "video_id").join(spoken, "video_id")
    bad = joined.filter((tx.strip(F.col("spoken")) != "")
                        & ~tx.strip(F.col("chunk_text")).startswith(tx.strip(F.col("spoken"))))
    shown = bad.withColumns({"stored_preview": F.substring("chunk_text", 1, 160), "preview": F.substring("spoken", 1, 160)})
    return issues(shown, "warning", "first_chunk_text_mismatch",
                  F.concat(F.lit("Video "), F.col("video_id").cast("string"), F.lit(" first chunk text differs")),
                  "video_id", "stored_preview", "preview")


def index_findings(chunks: DataFrame, index: DataFrame) -> DataFrame:
    found = indexing.reconcile(chunks, index)
    return issues(found, "error", F.col("category"),
                  F.concat(F.lit("Chunk "), F.col("chunk_id").cast("string"), F.lit(": "), "category"),
                  "chunk_id", "video_id", "chunk_index")


def vector_findings(points: DataFrame, expected_ids: DataFrame, sample: int, dimension: int) -> DataFrame:
    """Sampled vectors of a wrong length, of no length, or not there at all."""
    ids = ranking.vector_sample(expected_ids, "chunk_id", sample)
    found = vectors.vector_issues(points.join(ids, "chunk_id", "left_semi"), dimension)
    lost = ids.join(points.select("chunk_id"), "chunk_id", "left_anti")
    number = F.col("chunk_id").cast("string")
    return issues(found, "error", F.col("category"), F.concat(F.lit("Chunk "), number, F.lit(": "), "category"),
                  "chunk_id", "actual_dimension").unionByName(issues(
                      lost, "error", "missing_sample_vector",
                      F.concat(F.lit("Sampled chunk "), number, F.lit(" has no vector")), "chunk_id"))


def videos_without_chunks(videos: DataFrame, chunks: DataFrame) -> DataFrame:
    done = videos.filter(F.col("status").isin(*DONE) & ~F.col("is_silent"))
    empty = done.join(chunks.select(F.col("video_id").alias("id")), "id", "left_anti")
    return issues(empty, "error", "video_without_chunks",
                  F.concat(F.lit("Completed video "), F.col("id").cast("string"), F.lit(" has no chunks")), "id", "title")


def duplicate_keys(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Keys that occur more than once; counted with map-side combining."""
    present = df.filter(" AND ".join(f"{k} IS NOT NULL AND CAST({k} AS STRING) <> ''" for k in keys))
    many = present.groupBy(*keys).agg(F.count("*").alias("count")).filter("count > 1")
    what = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return issues(many, "error", category, F.concat(what, F.lit(" occurs "), F.col("count").cast("string"), F.lit(" times")),
                  *keys, "count")


def duplicates_with_chunks(videos: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    bad = videos.filter("original_id IS NOT NULL").join(counts, "id")
    return issues(bad, "error", "duplicate_video_has_chunks",
                  F.concat(F.lit("Duplicate video "), F.col("id").cast("string"), F.lit(" owns "),
                           F.col("chunk_count").cast("string"), F.lit(" chunks")), "id", "original_id", "chunk_count")


def orphan_duplicates(videos: DataFrame) -> DataFrame:
    good = videos.filter("original_id IS NULL").select(F.col("id").alias("original_id"))
    bad = videos.filter("original_id IS NOT NULL").join(good, "original_id", "left_anti")
    return issues(bad, "error", "orphan_duplicate",
                  F.concat(F.lit("Duplicate video "), F.col("id").cast("string"),
                           F.lit(" points to missing or non-original video "), F.col("original_id").cast("string")),
                  "id", "original_id")


def duplicate_chains(videos: DataFrame) -> DataFrame:
    """Duplicates of videos that are duplicates themselves."""
    middle = videos.filter("original_id IS NOT NULL").select(F.col("id").alias("original_id"))
    bad = videos.join(middle, "original_id", "left_semi")
    return issues(bad, "error", "duplicate_chain",
                  F.concat(F.lit("Video "), F.col("id").cast("string"), F.lit(" duplicates a duplicate")), "id", "original_id")


def orphan_chunks(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    return issues(dangling(chunks, "video_id", videos), "error", "orphan_chunk",
                  F.concat(F.lit("Chunk "), F.col("id").cast("string"), F.lit(" points to missing video "),
                           F.col("video_id").cast("string")), "id", "video_id", "chunk_index")


def words_per_minute(videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words per minute of finished videos longer than 30 s; a chunk has one word more than spaces."""
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    counts = chunks.groupBy("video_id").agg(F.sum(words).alias("words"))
    done = videos.filter(F.col("status").isin(*DONE) & ~F.col("is_silent") & (F.col("duration_sec") > 30))
    return done.join(counts, done["id"] == counts["video_id"]).select(
        "id", "title", "words", (F.col("words") / (F.col("duration_sec") / 60)).alias("wpm"))


def low_wpm(videos: DataFrame, chunks: DataFrame, below: float = 10) -> DataFrame:
    slow = words_per_minute(videos, chunks).filter(F.col("wpm") < below).withColumn("wpm", F.round("wpm", 2))
    return issues(slow, "warning", "low_wpm",
                  F.concat(F.lit("Video "), F.col("id").cast("string"), F.lit(" has low transcript density: "),
                           F.format_string("%.1f", "wpm"), F.lit(" WPM")), "id", "wpm")


def chunk_sequence(chunks: DataFrame) -> DataFrame:
    numbered = ranking.position_in_group(chunks, "video_id", "chunk_index", "id", "expected_index")
    bad = numbered.filter("chunk_index <> expected_index")
    return issues(bad, "error", "chunk_sequence",
                  F.concat(F.lit("Chunk "), F.col("id").cast("string"), F.lit(" index is "),
                           F.col("chunk_index").cast("string"), F.lit(", expected "),
                           F.col("expected_index").cast("string")), "id", "video_id", "chunk_index", "expected_index")


def chunk_time(chunks: DataFrame) -> DataFrame:
    bad = chunks.filter("start_sec IS NULL OR end_sec IS NULL OR start_sec >= end_sec OR start_sec < 0")
    return issues(bad, "error", "chunk_time",
                  F.concat(F.lit("Chunk "), F.col("id").cast("string"), F.lit(" has invalid timestamps")),
                  "id", "video_id", "chunk_index", "start_sec", "end_sec")


def task_payload(tasks: DataFrame) -> DataFrame:
    bad = tasks.filter(~identity.is_json_object(F.col("payload")))
    return issues(bad, "error", "invalid_task_payload",
                  F.concat(F.lit("Task "), F.col("id").cast("string"), F.lit(" has invalid payload")),
                  "id", "task_type", "status")


def folder_cycle(folders: DataFrame) -> DataFrame:
    return issues(folder_cycles(folders), "error", "folder_cycle",
                  F.concat(F.lit("Folder "), "id", F.lit(" is its own ancestor")), "id")


def table_constraints(folders: DataFrame, videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rules a stored table must hold: no self-parent, no negative size, ordered times, text present."""
    rules = (
        (folders, "folders", "parent_id = id", "folder_is_own_parent"),
        (videos, "videos", "size_bytes < 0", "negative_size"),
        (videos, "videos", "duration_sec < 0", "negative_duration"),
        (chunks, "chunks", "chunk_index < 0", "negative_index"),
        (chunks, "chunks", "start_sec < 0", "negative_start"),
        (chunks, "chunks", "end_sec < start_sec", "end_before_start"),
        (chunks, "chunks", "trim(text) = ''", "blank_text"),
    )
    out = None
    for df, table, condition, rule in rules:
        bad = df.filter(condition).select(F.col("id").cast("string").alias("rowid"), F.lit(table).alias("table"))
        rows = issues(bad, "error", "table_constraint", F.concat(F.lit(f"{table} row "), "rowid", F.lit(f" breaks {rule}")),
                      "table", "rowid")
        out = rows if out is None else out.unionByName(rows)
    return out


def generation_match(generations: DataFrame, config_hash: str) -> DataFrame:
    """Newest active generation against the running configuration."""
    active = generations.filter("status = 'active'").agg(F.max_by(F.struct("id", "config_hash"), "id").alias("g"))
    bad = active.filter(~F.col("g.config_hash").eqNullSafe(F.lit(config_hash))).select(F.col("g.id").alias("id"))
    return issues(bad, "error", "generation_mismatch", F.lit("Active generation differs from the configuration"), "id")


def audit(folders: DataFrame, videos: DataFrame, chunks: DataFrame, index: DataFrame, tasks: DataFrame) -> DataFrame:
    """All relational checks as one issues table."""
    live = videos.filter("original_id IS NULL")
    parts = [
        foreign_keys([("videos", videos, "parent_folder_id", folders), ("chunks", chunks, "video_id", videos),
                      ("folders", folders, "parent_id", folders), ("tasks", tasks, "video_id", videos)]),
        active_work(tasks), missing_source_id(videos), index_findings(chunks, index),
        videos_without_chunks(videos, chunks), duplicate_keys(videos, ["source_file_id"], "duplicate_source_file_id"),
        duplicate_keys(live, ["md5_checksum"], "duplicate_original_md5"),
        duplicate_keys(chunks, ["video_id", "chunk_index"], "duplicate_chunk_index"),
        duplicates_with_chunks(videos, chunks), orphan_duplicates(videos), orphan_chunks(chunks, videos),
        low_wpm(videos, chunks), chunk_sequence(chunks), chunk_time(chunks), task_payload(tasks),
        table_constraints(folders, videos, chunks),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def severity_category_counts(found: DataFrame) -> DataFrame:
    """Counts by severity and by category in one pass; the other column is null."""
    return found.groupingSets([["severity"], ["category"]], "severity", "category").agg(F.count("*").alias("n"))


def report(found: DataFrame, details: int = 3) -> DataFrame:
    """Totals and at most ``details`` messages per category; the rest is counted as hidden."""
    shown = ranking.top_k(found.select("category", "message"), ["category"], [F.asc("message")], details)
    listed = shown.groupBy("category").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]), " | ").alias("examples"))
    totals = found.groupBy("category").agg(F.count("*").alias("total"))
    return totals.join(listed, "category").withColumn("hidden", F.greatest(F.col("total") - details, F.lit(0)))


def message_groups(messages: DataFrame, examples: int = 3) -> DataFrame:
    """Findings by wording: counts per report category, with examples of unlisted wordings."""
    kind = F.lit("other")
    for name, pattern in reversed(REPORT_CATEGORIES):
        kind = F.when(tx.regexp_match(F.col("message"), pattern.replace("!", "[!]")), name).otherwise(kind)
    tagged = messages.select("id", "message", kind.alias("category"))
    totals = tagged.groupBy("category").agg(F.count("*").alias("n"))
    first = ranking.top_k(tagged.filter("category = 'other'"), ["category"], [F.asc("id")], examples)
    listed = first.groupBy("category").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]), " | ").alias("examples"))
    return totals.join(listed, "category", "left")


def repair_plan(videos: DataFrame, chunks: DataFrame, index: DataFrame, derived: DataFrame, tasks: DataFrame) -> DataFrame:
    """What a repair would do, as ``(action, entity, id, reason)``; nothing is changed."""
    found = indexing.reconcile(chunks, index)
    busy = active_tasks(tasks).filter("task_type = 'stage_3_index'").select("video_id").distinct()
    lost = found.filter("category = 'missing_in_index'").select("video_id").distinct().join(
        videos.select(F.col("id").alias("video_id")), "video_id", "left_semi").join(busy, "video_id", "left_anti")
    counts = chunk_count(videos, chunks, derived).select(F.col("context")["video_id"].cast("bigint").alias("id"))
    linked = dedupe.link_md5_duplicates(videos).join(
        videos.filter("original_id IS NULL").select("id"), "id", "left_semi").filter("original_id IS NOT NULL")

    def plan(df: DataFrame, action: str, entity: str, column: str, reason: str) -> DataFrame:
        return df.select(F.lit(action).alias("action"), F.lit(entity).alias("entity"),
                         F.col(column).cast("bigint").alias("id"), F.lit(reason).alias("reason"))

    relinked = dedupe.relink_orphans(videos)
    parts = (
        plan(counts, "rechunk", "video", "id", "chunk count differs"),
        plan(lost, "reindex", "video", "video_id", "chunks missing in index"),
        plan(found.filter("category = 'orphan_in_index'"), "delete_point", "chunk", "chunk_id", "not in chunk table"),
        plan(chunks.join(videos.filter("original_id IS NOT NULL").select(F.col("id").alias("video_id")), "video_id",
                         "left_semi"), "delete_chunk", "chunk", "id", "video is a duplicate"),
        plan(linked, "link_duplicate", "video", "id", "same checksum as an older original"),
        plan(relinked.filter("action = 'relink'"), "relink", "video", "id", "original is gone, checksum known"),
        plan(relinked.filter("action <> 'relink'"), "make_original", "video", "id", "original is gone"),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

