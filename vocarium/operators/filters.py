"""Filters of search queries and of the archive's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vocarium.functions import identity, text as tx

NO_DATE_LO, NO_DATE_HI = -(2**31), 2**31 - 1


def with_parsed_query(queries: DataFrame) -> DataFrame:
    """Split query text and filters.

    Adds ``clean`` (text without the video filter), ``v_id``, ``q_short`` / ``q_4k`` (null when
    not asked for), ``date_lo`` / ``date_hi`` (ignored for short videos; an undated point is 0)
    and ``has_filter``.
    """
    kind = F.coalesce("video_type", F.lit("all"))
    dated = kind != "short"
    lo, hi = F.nullif("date_from", F.lit("")), F.nullif("date_to", F.lit(""))
    out = queries.withColumns({
        "text": F.coalesce("text", F.lit("")),
    }).withColumns({
        "clean": tx.clean_query(F.col("text")),
        "v_id": tx.query_video_id(F.col("text")),
        "q_short": F.when(kind == "short", True).when(kind == "long", False),
        "q_4k": F.when(kind == "4k", True),
        "date_lo": F.when(dated & lo.isNotNull(), identity.date_to_int(lo)).otherwise(NO_DATE_LO),
        "date_hi": F.when(dated & hi.isNotNull(), identity.date_to_int(hi)).otherwise(NO_DATE_HI),
    })
    return out.withColumn("has_filter", F.col("q_short").isNotNull() | F.col("q_4k").isNotNull()
                          | (F.col("date_lo") > NO_DATE_LO) | (F.col("date_hi") < NO_DATE_HI)
                          | F.col("v_id").isNotNull())


def passes() -> Column:
    """Does the point in a joined row satisfy the filters of the query in it."""
    return (
        (F.col("q_short").isNull() | (F.col("is_short") == F.col("q_short")))
        & (F.col("q_4k").isNull() | (F.col("is_4k") == F.col("q_4k")))
        & F.col("recorded_date").between(F.col("date_lo"), F.col("date_hi"))
        & (F.col("v_id").isNull() | (F.col("video_id") == F.col("v_id"))))


def filter_video_type(points: DataFrame, video_type: str) -> DataFrame:
    condition = {"short": F.col("is_short"), "long": ~F.col("is_short"), "4k": F.col("is_4k")}.get(video_type)
    return points if condition is None else points.filter(condition)


def filter_date_range(points: DataFrame, date_from: str | None, date_to: str | None,
                      video_type: str = "all") -> DataFrame:
    """Bounds on the yyyymmdd date; short videos ignore them, undated points are 0."""
    if video_type == "short":
        return points
    if date_from:
        points = points.filter(F.col("recorded_date") >= _date_number(date_from))
    if date_to:
        points = points.filter(F.col("recorded_date") <= _date_number(date_to))
    return points


def _date_number(date: str) -> int:
    digits = date.strip()[:10].replace("-", "")
    return int(digits) if digits.isdigit() else 0


def filter_only_matches(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(query, point) rows for queries made of filters alone.

    Joined on equal keys: the video number where one is given, else the video type, which a
    point carries one to three times; the date range stays as a residual.
    """
    asked = queries.filter(F.col("has_filter") & (F.col("clean") == ""))
    narrow = asked.select("query_id", "q_short", "q_4k", "date_lo", "date_hi", "v_id")
    by_video = points.join(
        narrow.filter("v_id IS NOT NULL"), F.col("video_id") == F.col("v_id")).filter(passes())
    kinds = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("is_short"), "short").otherwise("long"), F.when(F.col("is_4k"), "4k")))
    kind = F.when(F.col("q_4k"), "4k").when(F.col("q_short"), "short").when(~F.col("q_short"), "long").otherwise("all")
    open_queries = narrow.filter("v_id IS NULL").withColumn("kind", kind)
    by_kind = points.withColumn("kind", F.explode(kinds)).join(
        open_queries, "kind").filter(passes()).drop("kind")
    return by_video.unionByName(by_kind)


def scroll(df: DataFrame, condition: Column, order: Sequence[str], limit: int) -> DataFrame:
    """First rows that satisfy a condition, in a fixed order."""
    return df.filter(condition).orderBy(*order).limit(limit)


def lookup_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id table."""
    return df.join(ids.select(key), key, "left_semi")


def media_files(listing: DataFrame) -> DataFrame:
    return listing.filter(~F.col("is_folder") & tx.is_media(F.col("name"), F.col("mime_type")))


def split_by_keywords(listing: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Every file with ``is_excluded`` set by keyword."""
    return listing.withColumn("is_excluded", tx.matches_keyword(F.col("name"), keywords))


def active_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isin("pending", "running"))


def task_references(tasks: DataFrame) -> DataFrame:
    """Videos a task is about: ``(task_id, ref_video_id, ref_file_id)``, one row per reference.

    Three alternatives become rows, so that tests on them are equi-joins.
    """
    payload_video = F.get_json_object("payload", "$.video_id").try_cast("bigint")
    payload_file = F.get_json_object("payload", "$.file_id")
    refs = F.array(
        F.struct(F.col("video_id").alias("v"), F.lit(None).cast("string").alias("f")),
        F.struct(payload_video.alias("v"), F.lit(None).cast("string").alias("f")),
        F.struct(F.lit(None).cast("bigint").alias("v"), payload_file.alias("f")))
    return (
        tasks.select(F.col("id").alias("task_id"), F.explode(refs).alias("r"))
        .filter("r.v IS NOT NULL OR r.f IS NOT NULL")
        .select("task_id", F.col("r.v").alias("ref_video_id"), F.col("r.f").alias("ref_file_id")))


def videos_with_work(videos: DataFrame, tasks: DataFrame) -> DataFrame:
    """Ids of videos some given task refers to by number or by file."""
    refs = task_references(tasks)
    by_number = refs.select(F.col("ref_video_id").alias("id")).filter("id IS NOT NULL")
    by_file = refs.filter("ref_file_id IS NOT NULL").select(F.col("ref_file_id").alias("source_file_id")).distinct()
    named = videos.select("id", "source_file_id").join(by_file, "source_file_id").select("id")
    return by_number.join(videos.select("id"), "id", "left_semi").unionByName(named).distinct()


def eligible_tasks(tasks: DataFrame, types: Sequence[str], now: str) -> DataFrame:
    """Pending tasks of the given types whose waiting time is over."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(now).cast("timestamp"))
    return tasks.filter((F.col("status") == "pending") & F.col("task_type").isin(*types) & due)


def nonblank_chunks(chunks: DataFrame, more_than: int = 1) -> DataFrame:
    return chunks.filter(F.length(tx.strip(F.col("text"))) > more_than)


def time_window_context(chunks: DataFrame, targets: DataFrame, window_sec: float = 30.0) -> DataFrame:
    """Text around a moment: chunks of the video that start within the window, in order.

    Starts are binned by the window; a target meets its own bin and both neighbours, which
    makes the range join an equi-join. Targets carry ``video_id`` and ``target_sec``.
    """
    binned = chunks.select("video_id", "start_sec", "id", "text",
                           F.floor(F.col("start_sec") / window_sec).alias("bin"))
    bin_of = F.floor(F.col("target_sec") / window_sec)
    wanted = targets.select("target_id", "video_id", "target_sec",
                            F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    near = binned.join(wanted, ["video_id", "bin"]).filter(
        F.abs(F.col("start_sec") - F.col("target_sec")) <= window_sec)
    ordered = F.array_sort(F.collect_list(F.struct("start_sec", "id", "text")))
    return near.groupBy("target_id", "video_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("context"))
