"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RRF_K = 60


def rrf_merge(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse two ranked lists ``(query_id, chunk_id, score, rank)``.

    Both lists become one and are added up per (query, chunk), so the fusion is a single
    combining aggregate. ``match_type`` tells which branch found the chunk.
    """
    both = dense.select("query_id", "chunk_id", F.col("score").alias("semantic"), F.col("rank").alias("dense_rank"),
                        F.lit(None).cast("double").alias("lexical"), F.lit(None).cast("int").alias("lexical_rank")
                        ).unionByName(lexical.select(
                            "query_id", "chunk_id", F.lit(None).cast("double").alias("semantic"),
                            F.lit(None).cast("int").alias("dense_rank"), F.col("score").alias("lexical"),
                            F.col("rank").alias("lexical_rank")))
    share = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    kind = F.when(F.col("lexical_rank").isNull(), "semantic").when(
        F.col("dense_rank").isNull(), "keyword").otherwise("hybrid")
    return (
        both.groupBy("query_id", "chunk_id").agg(
            *[F.max(c).alias(c) for c in ("semantic", "dense_rank", "lexical", "lexical_rank")])
        .withColumn("combined", share("dense_rank") + share("lexical_rank")).withColumn("match_type", kind)
        .withColumns({"semantic": F.coalesce("semantic", F.lit(0.0)), "lexical": F.coalesce("lexical", F.lit(0.0))}))


def fusion_order() -> list:
    """Best first; equal scores keep the dense list before the lexical one."""
    return [F.desc("combined"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.asc("chunk_id")]
