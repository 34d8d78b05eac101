"""Folder trees as adjacency lists.

Walks use pointer doubling: after round n every folder knows the stretch of its next 2^n
ancestors, so depth costs a logarithmic number of equi-joins. Each round reads the last one
twice and is therefore cut at the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vocarium.session import materialise


def folder_paths(folders: DataFrame, separator: str = "/") -> DataFrame:
    """``(id, root_id, depth, path)`` with names from the root down; cyclic folders are left out.

    A parent that is not in the table ends the walk, as a missing row does when breadcrumbs
    are followed one by one.
    """
    known = folders.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    step = (
        folders.select("id", "name", "parent_id").join(known, "parent_id", "left")
        .select("id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.col("name").alias("path"),
                F.col("id").alias("top"), F.lit(1).cast("bigint").alias("depth")))
    step = materialise(step)
    limit, reach = folders.count(), 1
    while reach <= limit and step.filter("up IS NOT NULL").limit(1).count():
        above = step.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"),
                            F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        joined = step.join(above, "up", "left")
        step = materialise(joined.select(
            "id", F.col("up2").alias("up"),
            F.when(F.col("path2").isNull(), F.col("path")).otherwise(
                F.concat_ws(separator, "path2", "path")).alias("path"),
            F.coalesce("top2", "top").alias("top"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")))
        reach *= 2
    return step.filter("up IS NULL").select("id", F.col("top").alias("root_id"), "depth", "path")


def folder_cycles(folders: DataFrame) -> DataFrame:
    """Ids of folders that are their own ancestor.

    After at least as many steps as there are folders a walk that has not ended is inside a
    cycle, and every member of a cycle is where some walk then stands.
    """
    hop = materialise(folders.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up")))
    limit, reach = folders.count(), 1
    while reach < limit and hop.limit(1).count():
        ahead = hop.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        hop = materialise(hop.join(ahead, "up").select("id", F.col("up2").alias("up")))
        reach *= 2
    return hop.select(F.col("up").alias("id")).distinct()


def tree_scan(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything below the root folders, with the root it belongs to and its depth."""
    paths = folder_paths(listing.filter("is_folder").select("id", "name", "parent_id"))
    inside = paths.join(roots.select(F.col("id").alias("root_id")), "root_id", "left_semi")
    placed = inside.select(F.col("id").alias("at"), "root_id", "depth", "path")
    own = listing.filter("is_folder").join(placed, F.col("id") == F.col("at"))
    media = listing.filter("NOT is_folder").join(placed, F.col("parent_id") == F.col("at")).withColumn(
        "depth", F.col("depth") + 1)
    return own.unionByName(media).drop("at")


def at_root(df: DataFrame, parent: str, folders: DataFrame) -> DataFrame:
    """Rows whose parent is null or not a known folder."""
    return df.join(folders.select(F.col("id").alias(parent)), parent, "left_anti")


def folder_listing(folders: DataFrame, videos: DataFrame, chunks: DataFrame, folder_id: str | None) -> DataFrame:
    """Sub-folders and videos of one folder, folders first; ``None`` is the root."""
    if folder_id is None:
        subs, here = at_root(folders, "parent_id", folders), at_root(videos, "parent_folder_id", folders)
    else:
        subs = folders.filter(F.col("parent_id") == folder_id)
        here = videos.filter(F.col("parent_folder_id") == folder_id)
    counts = (
        chunks.join(here.select(F.col("id").alias("video_id")), "video_id", "left_semi")
        .groupBy("video_id").agg(F.count("*").alias("chunk_count")))
    rows = here.join(counts, here["id"] == counts["video_id"], "left").select(
        here["id"].cast("string").alias("id"), F.col("title").alias("name"), F.lit(False).alias("is_folder"),
        "mime_type", "is_short", "is_4k", F.col("original_id").isNotNull().alias("is_md5_duplicate"), "is_silent",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    heads = subs.select("id", "name", F.lit(True).alias("is_folder"), F.lit("folder").alias("mime_type"))
    return heads.unionByName(rows, allowMissingColumns=True).orderBy(F.desc("is_folder"), "name", "id")
