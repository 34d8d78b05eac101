"""Rows of the search index, and hits read back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vocarium.functions import identity, text

#: Fixed value: viewer address of a file, used when a hit carries no address of its own.
FILE_URL_PREFIX, FILE_URL_SUFFIX = "https://drive.google.com/file/d/", "/view"


def point_payload(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """Index rows: chunk joined with its video, date as yyyymmdd, plain flags."""
    meta = videos.select(F.col("id").alias("video_id"), "title", "source_file_id", "source_url", "recorded_date",
                         "is_short", "is_4k")
    return chunks.join(meta, "video_id").select(
        F.col("id").alias("chunk_id"), "video_id", "chunk_index", "start_sec", "end_sec", "text", "title",
        "source_file_id", "source_url", identity.date_to_int(F.col("recorded_date")).alias("recorded_date"),
        F.coalesce("is_short", F.lit(False)).alias("is_short"), F.coalesce("is_4k", F.lit(False)).alias("is_4k"))


def result_projection(hits: DataFrame) -> DataFrame:
    """Hit fields with their fallbacks; expects ``video_title`` and ``video_file_id`` from the video."""
    file_id = F.coalesce(F.nullif("video_file_id", F.lit("")), "source_file_id")
    url = F.coalesce(F.nullif("source_url", F.lit("")),
                     F.concat(F.lit(FILE_URL_PREFIX), file_id, F.lit(FILE_URL_SUFFIX)))
    title = F.coalesce(F.nullif("video_title", F.lit("")), F.nullif("title", F.lit("")), F.lit("Unknown Video"))
    return hits.withColumns({
        "title": title, "source_file_id": file_id, "source_url": url,
        "start_sec": F.coalesce("start_sec", F.lit(0.0)), "end_sec": F.coalesce("end_sec", F.lit(0.0)),
        "chunk_index": F.coalesce("chunk_index", F.lit(0)),
        "recorded_date": identity.int_to_date(F.col("recorded_date")),
    }).withColumns({
        "start_ts": text.timestamp_label(F.col("start_sec")),
        "end_ts": text.timestamp_label(F.col("end_sec")),
    }).drop("video_title", "video_file_id")
