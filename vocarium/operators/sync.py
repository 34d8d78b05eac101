"""Inventory listing against stored videos and folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vocarium.functions import text as tx
from vocarium.operators.filters import active_tasks, media_files, split_by_keywords, task_references
from vocarium.operators.ranking import top_k

REINDEXED = ("indexed_chunks_ready", "transcribed", "indexing")
NOT_MISSING = ("failed", "skipped_silent")


def inventory_sync(listing: DataFrame, videos: DataFrame, tasks: DataFrame, keywords: Sequence[str] = ()) -> DataFrame:
    """One row per listed or stored file with what the sync does to it.

    ``action`` is ``insert`` / ``update`` / ``unchanged`` / ``excluded`` / ``missing`` /
    ``absent`` (gone, but not reported); ``requeue`` asks for re-indexing after an update.
    """
    media = split_by_keywords(media_files(listing), keywords).select(
        "id", F.col("name").alias("new_title"), F.col("parent_id").alias("new_parent"), "is_excluded",
        F.lit(True).alias("listed"))
    stored = videos.select(F.col("source_file_id").alias("id"), F.col("id").alias("video_id"), "title",
                           "parent_folder_id", "recorded_date", "is_4k", "status", F.lit(True).alias("stored"))
    fetching = tasks.filter(F.col("task_type").isin("stage_1_download", "stage_2_transcribe"))
    queued = task_references(fetching).filter("ref_file_id IS NOT NULL").select(
        F.col("ref_file_id").alias("id"), F.lit(True).alias("queued")).distinct()
    indexing = active_tasks(tasks).filter("task_type = 'stage_3_index' AND video_id IS NOT NULL").select(
        "video_id", F.lit(True).alias("indexing")).distinct()
    both = media.join(stored, "id", "full_outer").join(queued, "id", "left").join(indexing, "video_id", "left")
    title = F.col("new_title")
    changed = ~(F.col("title").eqNullSafe(title) & F.col("parent_folder_id").eqNullSafe(F.col("new_parent"))
                & F.col("recorded_date").eqNullSafe(tx.title_date(title))
                & F.coalesce("is_4k", F.lit(False)).eqNullSafe(tx.is_4k(title)))
    action = (
        F.when(F.coalesce("is_excluded", F.lit(False)), "excluded")
        .when(F.col("listed") & F.col("stored"), F.when(changed, "update").otherwise("unchanged"))
        .when(F.col("listed"), F.when(F.col("queued"), "already_queued").otherwise("insert"))
        .when(F.col("status").isin(*NOT_MISSING), "absent").otherwise("missing"))
    requeue = (F.col("action") == "update") & F.col("status").isin(*REINDEXED) & F.col("indexing").isNull()
    return both.withColumn("action", action).select(
        "id", "video_id", "action", F.coalesce(requeue, F.lit(False)).alias("requeue"), "new_title", "new_parent",
        tx.title_date(title).alias("new_date"), tx.is_4k(title).alias("new_4k"))


def folder_sync(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Folders to insert, update or delete so that the store equals the listing."""
    new = listed.select("id", F.col("name").alias("new_name"), F.col("parent_id").alias("new_parent"),
                        F.lit(True).alias("listed"))
    old = stored.select("id", "name", "parent_id", F.lit(True).alias("stored"))
    same = F.col("name").eqNullSafe(F.col("new_name")) & F.col("parent_id").eqNullSafe(F.col("new_parent"))
    action = F.when(F.col("stored").isNull(), "insert").when(F.col("listed").isNull(), "delete").when(
        same, "unchanged").otherwise("update")
    return new.join(old, "id", "full_outer").select("id", action.alias("action"))


def title_collisions(listing: DataFrame, videos: DataFrame) -> DataFrame:
    """Listed files whose title an original already has under another file id.

    One original stands for a title, the last by id; duplicates by content are not reported.
    """
    by_title = videos.filter("original_id IS NULL AND coalesce(title, '') <> ''").groupBy("title").agg(
        F.max_by("source_file_id", "id").alias("existing_file_id"))
    duplicates = videos.filter("original_id IS NOT NULL").select(F.col("source_file_id").alias("id"))
    return (
        media_files(listing).join(duplicates, "id", "left_anti").withColumnRenamed("name", "title")
        .join(by_title, "title").filter("existing_file_id <> id")
        .select("title", F.col("id").alias("new_file_id"), "existing_file_id"))


def inventory_status(listing: DataFrame, videos: DataFrame, folders: DataFrame, tasks: DataFrame) -> DataFrame:
    """Flags ``is_indexed`` (id or checksum known) and ``is_queued`` for every listed item."""
    ids = videos.select(F.col("source_file_id").alias("id"), F.lit(True).alias("known_id")).distinct()
    md5s = videos.filter("coalesce(md5_checksum, '') <> ''").select(
        "md5_checksum", F.lit(True).alias("known_md5")).distinct()
    known_folders = folders.select("id", F.lit(True).alias("known_folder")).distinct()
    refs = task_references(active_tasks(tasks).withColumn("video_id", F.lit(None).cast("bigint")))
    by_number = refs.select(F.col("ref_video_id").alias("vid")).filter("vid IS NOT NULL").distinct()
    queued = refs.select(F.col("ref_file_id").alias("id")).filter("id IS NOT NULL").unionByName(
        videos.select(F.col("id").alias("vid"), "source_file_id").join(by_number, "vid").select(
            F.col("source_file_id").alias("id"))).distinct().withColumn("queued", F.lit(True))
    indexed = F.when(F.col("is_folder"), F.col("known_folder").isNotNull()).otherwise(
        F.col("known_id").isNotNull() | F.col("known_md5").isNotNull())
    return (
        listing.join(ids, "id", "left").join(md5s, "md5_checksum", "left").join(known_folders, "id", "left")
        .join(queued, "id", "left")
        .select("id", "is_folder", indexed.alias("is_indexed"), F.col("queued").isNotNull().alias("is_queued")))


def import_split(status: DataFrame) -> DataFrame:
    """Files to ingest and files to skip."""
    skip = F.col("is_indexed") | F.col("is_queued")
    return status.filter("NOT is_folder").select("id", F.when(skip, "skip").otherwise("ingest").alias("decision"))


def sync_metadata(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """Videos with title and parent refreshed from the listing, and whether they changed."""
    fresh = listing.filter("NOT is_folder").select(F.col("id").alias("source_file_id"), F.col("name").alias("new_title"),
                                                   F.col("parent_id").alias("new_parent"), F.lit(True).alias("listed"))
    joined = videos.join(fresh, "source_file_id", "left")
    changed = F.coalesce(F.col("listed"), F.lit(False)) & (
        (F.coalesce("new_title", F.lit("")) != "") & ~F.col("new_title").eqNullSafe(F.col("title"))
        | ~F.col("new_parent").eqNullSafe(F.col("parent_folder_id")))
    return joined.withColumn("changed", changed).withColumns({
        "title": F.when(F.col("changed"), F.col("new_title")).otherwise(F.col("title")),
        "parent_folder_id": F.when(F.col("changed"), F.col("new_parent")).otherwise(F.col("parent_folder_id")),
    }).drop("new_title", "new_parent", "listed")


def unique_ordered(items: DataFrame, key: str, position: str) -> DataFrame:
    """First place of every non-empty key, in order."""
    return items.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.min(position).alias(position)).orderBy(position)


def listing_union(sources: Sequence[DataFrame]) -> DataFrame:
    """Several listings as one, each id as its first source has it."""
    merged = None
    for number, source in enumerate(sources):
        tagged = source.withColumn("source_no", F.lit(number))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return top_k(merged, ["id"], [F.asc("source_no"), F.asc("pos")], 1).drop("rank")


def inventory_order(listing: DataFrame) -> DataFrame:
    return listing.orderBy(F.desc("is_folder"), F.lower("name"), "id")
