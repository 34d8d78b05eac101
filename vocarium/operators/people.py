"""Search history and moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vocarium.functions.text import is_blank, strip
from vocarium.operators.ranking import top_k

HISTORY_KEPT, HISTORY_SHOWN, LEASE_SEC = 20, 10, 10_800


def history_table(log: DataFrame, settings: DataFrame | None = None, keep: int = HISTORY_KEPT) -> DataFrame:
    """Stored history: one row per user and query with its newest time, newest ``keep`` per user.

    The id is that of the first time the query was made. With ``settings`` only users who
    switched history on are recorded.
    """
    if settings is not None:
        log = log.join(settings.filter("search_history_enabled").select("user_id"), "user_id", "left_semi")
    cleaned = log.filter(~is_blank(F.col("query"))).withColumn("query", strip(F.col("query")))
    once = cleaned.groupBy("user_id", "query").agg(F.max("created_at").alias("created_at"), F.min("id").alias("id"))
    return newest_queries(once, keep).drop("rank")


def newest_queries(history: DataFrame, limit: int = HISTORY_SHOWN) -> DataFrame:
    return top_k(history, ["user_id"], [F.desc("created_at"), F.desc("id")], limit)


def suggest(history: DataFrame, typed: DataFrame) -> DataFrame:
    """Queries of the user that contain what was typed, ignoring case."""
    joined = history.join(typed, "user_id")
    return joined.filter(F.lower("query").contains(F.lower("typed")))


def forget(history: DataFrame, deletions: DataFrame) -> DataFrame:
    """Drop single queries; a deletion without query clears the user."""
    single = deletions.filter("query IS NOT NULL").select("user_id", strip(F.col("query")).alias("query"))
    cleared = deletions.filter("query IS NULL").select("user_id").distinct()
    return history.join(single, ["user_id", "query"], "left_anti").join(cleared, "user_id", "left_anti")


def moderation_list(flags: DataFrame, chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """Open flags with chunk and video, newest first."""
    return (
        flags.select(F.col("id").alias("flag_id"), "chunk_id", "created_at")
        .join(chunks.select(F.col("id").alias("chunk_id"), "video_id", "chunk_index", "start_sec", "end_sec",
                            F.col("text").alias("original_text")), "chunk_id")
        .join(videos.select(F.col("id").alias("video_id"), F.col("title").alias("video_title")), "video_id")
        .orderBy(F.desc("created_at"), F.asc("flag_id")))


def lease_expired(now: str, lease_sec: int) -> Column:
    return F.col("locked_at") + F.make_dt_interval(secs=F.lit(lease_sec)) < F.lit(now).cast("timestamp")


def next_flag(flags: DataFrame, users: DataFrame, now: str, lease_sec: int = LEASE_SEC) -> DataFrame:
    """Flag each user would get on asking alone: the own lease first, else the oldest free one."""
    order = [F.asc("created_at"), F.asc("chunk_id")]
    own = top_k(flags.join(users.select(F.col("user_id").alias("locked_by")), "locked_by", "left_semi"),
                ["locked_by"], order, 1).select(F.col("locked_by").alias("user_id"), F.col("chunk_id").alias("own_id"))
    free = flags.filter(F.col("locked_by").isNull() | lease_expired(now, lease_sec))
    oldest = free.agg(F.min_by("chunk_id", F.struct("created_at", "chunk_id")).alias("c")).scalar()
    return users.join(own, "user_id", "left").select(
        "user_id", F.coalesce("own_id", oldest).alias("chunk_id")).filter("chunk_id IS NOT NULL")


def assign_leases(flags: DataFrame, users: DataFrame, now: str, lease_sec: int = LEASE_SEC) -> DataFrame:
    """One flag for every user at once: own lease first, then free flags oldest first, each once.

    Only as many free flags as there are users are ranked.
    """
    order = [F.asc("created_at"), F.asc("chunk_id")]
    own = top_k(flags.join(users.select(F.col("user_id").alias("locked_by")), "locked_by", "left_semi"),
                ["locked_by"], order, 1).select(F.col("locked_by").alias("user_id"), "chunk_id")
    waiting = users.join(own, "user_id", "left_anti")
    seats = waiting.count()
    free = flags.filter(F.col("locked_by").isNull() | lease_expired(now, lease_sec)).join(
        own.select("chunk_id"), "chunk_id", "left_anti")
    offered = free.orderBy(*order).limit(seats).withColumn(
        "seat", F.row_number().over(Window.orderBy(*order))).select("seat", "chunk_id")
    seated = waiting.withColumn("seat", F.row_number().over(Window.orderBy("user_id")))
    return own.unionByName(seated.join(offered, "seat").select("user_id", "chunk_id"))


def upsert_flags(flags: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """New flags: one per chunk, ignored where one exists, and only if the chunk is the video's."""
    valid = requests.join(chunks.select(F.col("id").alias("chunk_id"), "video_id"), ["chunk_id", "video_id"], "left_semi")
    return valid.select("chunk_id").distinct().join(flags.select("chunk_id"), "chunk_id", "left_anti")


def dismiss_flags(flags: DataFrame, dismissed: DataFrame) -> DataFrame:
    return flags.join(dismissed.select("chunk_id"), "chunk_id", "left_anti")
