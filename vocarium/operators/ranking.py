"""Top-k, first-per-key and position helpers that stay safe on hot keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vocarium.session import materialise


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank.

    Filtering the row number lets Spark cut every input partition to ``k`` rows per key
    before the shuffle, so a hot key sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


#: Tasks that share the merging of one key's best rows.
SPREAD = 64


def top_k_spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """``top_k`` for few keys over many input partitions, as in search results.

    Each partition sends up to ``k`` rows per key. These are first merged in groups of
    partitions, so no task receives the rows of all partitions for a key.
    """
    grouped = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    merged = top_k(grouped, [*keys, "_part"], order, k, rank).drop("_part", rank)
    return top_k(merged, keys, order, k, rank)


def latest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Row with the highest version per key, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, "row.*")


def global_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position in total order without a single-task window.

    The range-sorted table is written to the checkpoint folder, so both reads see the same
    partitions; only one row count per partition is broadcast.
    """
    sorted_rows = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within).drop("_at", "_part", "_offset"))


def position_in_group(df: DataFrame, key: str, order: str, tie: str, name: str = "position",
                      block: int = 4096) -> DataFrame:
    """0-based position within ``key`` by an integer column.

    Rows are numbered inside blocks of neighbouring values and shifted by the rows of earlier
    blocks, so a key of any size is spread over many tasks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocked.groupBy(key, "_block").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(
        Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "_block", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order, tie)) - 1
    return (
        blocked.withColumn("_inside", inside).join(offsets, [key, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_block", "_inside", "_offset"))


def vector_sample(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """Deterministic sample: every n-th id in order, the first ``size`` of them."""
    numbered = global_position(df.select(id_col), [id_col])
    total = numbered.count()
    wanted = min(size, total)
    if wanted == 0:
        return numbered.limit(0).select(id_col)
    step = max(1, total // wanted)
    return numbered.filter((F.col("position") % step == 0) & (F.col("position") < step * wanted)).select(id_col)


#: Hits of many queries, as tasks send them.
HITS = "query_id BIGINT, chunk_id BIGINT, score DOUBLE"
_ARROW = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


class Best:
    """Running best ``k`` of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.ids = [np.empty(0, np.int64)] * queries
        self.scores = [np.empty(0)] * queries

    def least(self, query: int) -> float:
        """Score that a new result must reach."""
        held = self.scores[query]
        return held[-1] if len(held) == self.k else -np.inf

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        held = self.scores[query]
        if len(held) == self.k:
            enough = scores >= held[-1]
            ids, scores = ids[enough], scores[enough]
        if not len(ids):
            return
        ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([held, scores])
        if len(ids) > 4 * self.k:
            floor = np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[scores >= floor], scores[scores >= floor]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[query], self.scores[query] = ids[order], scores[order]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        sizes = [len(i) for i in self.ids]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate(self.ids)),
            pa.array(np.concatenate(self.scores))], schema=_ARROW)
