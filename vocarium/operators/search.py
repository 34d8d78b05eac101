"""Search: candidates by mode, then one common tail for every query at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vocarium.functions import identity
from vocarium.operators import fusion, lexical, points as point_ops, postings, vectors
from vocarium.operators.filters import filter_only_matches, with_parsed_query
from vocarium.operators.ranking import top_k, top_k_spread
from vocarium.session import written

PREFETCH = 100
PER_VIDEO = 3


def route(queries: DataFrame) -> DataFrame:
    """Parsed queries with the branch that answers them: ``quote``, ``filter`` or ``ranked``."""
    parsed = with_parsed_query(queries)
    has_text = F.col("clean") != ""
    branch = F.when((F.col("mode") == "quote") & has_text, "quote").when(
        F.col("has_filter") & ~has_text, "filter").otherwise("ranked")
    return parsed.withColumn("branch", branch)


def ranked_candidates(routed: DataFrame, index: postings.SearchIndex, dimension: int, match: str = "all") -> DataFrame:
    """Fused dense and lexical candidates of hybrid, semantic and lexical queries.

    A query without text still has its vector (that of a fixed default word) but no words, so
    the lexical branch finds nothing for it.
    """
    ranked = routed.filter("branch = 'ranked'")
    dense = vectors.knn_search(ranked.filter("mode IN ('semantic', 'hybrid')"), index.docs, PREFETCH, dimension)
    words = lexical.bm25_search(ranked.filter("mode IN ('lexical', 'hybrid') AND clean <> ''"), index, PREFETCH, match)
    return fusion.rrf_merge(dense, words)


def candidates(routed: DataFrame, index: postings.SearchIndex, dimension: int, limit: int, match: str = "all") -> DataFrame:
    """Candidates of all branches with score, kind of match and position in their list."""
    fused = ranked_candidates(routed, index, dimension, match)
    empty = {"semantic": F.lit(0.0), "lexical": F.lit(0.0), "dense_rank": F.lit(None).cast("int")}
    quoted = lexical.quote_search(routed.filter("branch = 'quote'"), index, 3 * limit).select(
        "query_id", "chunk_id", F.col("score").alias("combined"), F.lit("quote").alias("match_type"),
        F.col("rank").alias("lexical_rank")).withColumns(empty)
    filtered = top_k_spread(filter_only_matches(routed.filter("branch = 'filter'"), index.docs), ["query_id"],
                     [F.asc("video_id"), F.asc("chunk_index")], limit).select(
        "query_id", "chunk_id", F.lit(1.0).alias("combined"), F.lit("filter").alias("match_type"),
        F.col("rank").alias("lexical_rank")).withColumns(empty)
    return fused.unionByName(quoted).unionByName(filtered)


def hydrate(hits: DataFrame, index: DataFrame, videos: DataFrame, flags: DataFrame) -> DataFrame:
    """Payload, current video metadata and flag of every hit.

    A caller whose hits are bounded hints at their broadcast, so that they travel to the index and
    not the index to them.
    """
    payload = index.select("chunk_id", "video_id", "chunk_index", "start_sec", "end_sec", "text", "title",
                           "source_file_id", "source_url", "recorded_date", "is_short", "is_4k")
    meta = videos.select(F.col("id").alias("video_id"), F.col("title").alias("video_title"),
                         F.col("source_file_id").alias("video_file_id"))
    flagged = flags.select("chunk_id").distinct().withColumn("flagged", F.lit(True))
    joined = payload.join(hits, "chunk_id").join(meta, "video_id", "left").join(
        flagged, "chunk_id", "left").withColumn("is_flagged", F.col("flagged").isNotNull()).drop("flagged")
    return point_ops.result_projection(joined)


def dedupe_time_bucket(hits: DataFrame, order: list) -> DataFrame:
    """First hit per query, video and half second."""
    bucketed = hits.withColumn("bucket", identity.half_second(F.col("start_sec")))
    return top_k(bucketed, ["query_id", "video_id", "bucket"], order, 1, "in_bucket").drop("bucket", "in_bucket")


def diversify(hits: DataFrame, order: list, per_video: int = PER_VIDEO) -> DataFrame:
    """At most three hits per video, unless the query names a video."""
    place = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(*order))
    return hits.withColumn("in_video", place).filter(
        (F.col("in_video") <= per_video) | F.col("v_id").isNotNull()).drop("in_video")


def present(hits: DataFrame, routed: DataFrame, limit: int) -> DataFrame:
    """De-duplicate by time, diversify, limit, and number the results.

    A query that is only a video filter lists its results by chunk index.
    """
    order = fusion.fusion_order()
    asked = hits.join(F.broadcast(routed.select("query_id", "v_id", "clean")), "query_id")
    kept = top_k(diversify(dedupe_time_bucket(asked, order), order), ["query_id"], order, limit, "place")
    by_index = (F.coalesce("v_id", F.lit(0)) != 0) & (F.col("clean") == "")
    shown = [F.when(by_index, F.col("chunk_index")).asc_nulls_first(), F.asc("place")]
    return top_k(kept, ["query_id"], shown, limit, "result_rank").drop("place", "v_id", "clean", "dense_rank",
                                                                      "lexical_rank")


def hybrid_search(queries: DataFrame, index: postings.SearchIndex, videos: DataFrame, flags: DataFrame, *, dimension: int,
                  limit: int = 20, match: str = "all") -> DataFrame:
    """Answer every query in its own mode: ``hybrid``, ``semantic``, ``lexical`` or ``quote``.

    Queries without text that carry a filter list what passes it. ``index`` comes from ``postings.write_index``.
    """
    parts = None
    # Every branch reads the parsed queries, so they are parsed once; so are the candidates, at most a
    # few hundred for each query, which meet documents, videos and flags.
    for batch in lexical.query_batches(written(route(queries), "queries")):
        found = written(candidates(batch, index, dimension, limit, match), "candidates")
        shown = present(hydrate(found, index.docs, videos, flags), batch, limit)
        parts = shown if parts is None else parts.unionByName(shown)
    return parts
