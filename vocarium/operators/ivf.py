"""Approximate neighbours from an inverted-file index.

Coarse centroids are trained on a bounded sample of the vectors. Every vector is stored in the list of its
nearest centroid; a list is a folder, and a large one lies in several files. A query probes the lists of its
nearest centroids and opens no others. The number of lists grows with the square root of the vectors; how many
are probed is measured on the sample, so that a wanted share of true neighbours is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vocarium.operators.lexical import query_batches
from vocarium.operators.ranking import HITS, Best, top_k_spread
from vocarium.operators.vectors import META, QUERY_BLOCK, QueryBlock, cosine_scores, query_block, usable_vectors
from vocarium.session import work_path

#: Vectors of the training sample at most, rounds of training, and sample vectors that ask for their neighbours.
SAMPLE, ROUNDS, TRIALS = 32_768, 8, 256

#: Lists at most: the centroids are sent to every task.
MOST_LISTS = 16_384

#: Share of the true neighbours that the probes find among the sample.
RECALL = 0.95


class Lists(NamedTuple):
    """The stored vectors with their ``list``, the centroids as unit vectors, and how many lists a query probes."""

    vectors: DataFrame
    centroids: np.ndarray
    probes: int


def number_of_lists(total: int) -> int:
    return max(1, min(MOST_LISTS, round(2 * math.sqrt(total))))


def train(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on the driver over the bounded sample of unit vectors, whose first rows are the seeds."""
    centroids = sample[:lists].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centroids)
        np.add.at(sums, ranked_lists(sample, centroids, 1)[:, 0], sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def ranked_lists(unit: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest centroids of each vector, the nearest first; of equally near ones the smaller first."""
    out = [np.zeros((0, probes), np.int64)]
    for at in range(0, len(unit), 2048):
        scores = np.round(unit[at:at + 2048] @ centroids.T, 9)
        out.append(scores.argmax(1)[:, None] if probes == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :probes])
    return np.concatenate(out)


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, neighbours: int = 10, trials: int = TRIALS) -> int:
    """Fewest probes by which vectors of the sample find this share of their neighbours in the sample.

    The last vectors ask: the first are the seeds of the centroids and lie nearer to them than others do.
    """
    own = np.arange(max(min(len(centroids), len(sample) - 1), len(sample) - trials), len(sample))
    asked = sample[own]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), own] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :min(neighbours, len(sample) - 1)]
    if not near.size:
        return len(centroids)
    place = np.argsort(ranked_lists(asked, centroids, len(centroids)), axis=1)  # rank of each list for each vector
    of = ranked_lists(sample, centroids, 1)[:, 0]
    needed = np.take_along_axis(place, of[near], axis=1) + 1
    return int(np.quantile(needed, recall, method="higher"))


def build_lists(points: DataFrame, dimension: int, lists: int | None = None, recall: float = RECALL) -> Lists:
    """Train on a sample of the usable vectors, then store every one of them in its list.

    Vectors of a wrong length and zero vectors are not stored, as exact search does not find them either.
    """
    spark = points.sparkSession
    vectors = usable_vectors(points, dimension).select("chunk_id", "embedding", *META)
    # The ids with the smallest hashes: a bounded sample that reruns agree on.
    drawn = vectors.select(F.xxhash64("chunk_id").alias("h"), "chunk_id", "embedding").orderBy("h", "chunk_id").limit(SAMPLE).collect()
    sample = np.array([r["embedding"] for r in drawn], np.float64).reshape(-1, dimension)
    if len(sample):
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        lists = lists or number_of_lists(vectors.count())
        # Those that ask for their neighbours have no part in the training.
        centroids = train(sample[:max(lists, len(sample) - TRIALS)], lists)
        probes = probes_for(sample, centroids, recall)
    else:
        centroids, probes = np.ones((1, dimension)) / math.sqrt(dimension), 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", list int"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension).astype(np.float64)
            nearest = ranked_lists(values / np.linalg.norm(values, axis=1, keepdims=True), centroids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], schema=arrow)

    path = work_path(spark, "lists")
    placed = vectors.mapInArrow(place, schema).withColumn("_lane", F.pmod(F.xxhash64("chunk_id"), F.lit(4)))
    placed.repartition("list", "_lane").drop("_lane").write.partitionBy("list").parquet(path)
    return Lists(spark.read.schema(schema).parquet(path), centroids, probes)


def knn_ivf(queries: DataFrame, index: Lists, k: int, dimension: int, probes: int | None = None) -> DataFrame:
    """Best ``k`` of the probed lists for each query: ``(query_id, chunk_id, score, rank)``, filters applied first."""
    probes = min(len(index.centroids), probes or index.probes)
    parts = None
    for batch in query_batches(usable_vectors(queries, dimension), QUERY_BLOCK):
        block = query_block(batch)
        probed = ranked_lists(block.unit.reshape(-1, dimension), index.centroids, probes)
        asked = np.zeros((len(index.centroids), len(block.ids)), bool)
        for place, own in enumerate(probed):
            asked[own, place] = True
        wanted = np.flatnonzero(asked.any(1)).tolist()
        near = index.vectors.filter(F.col("list").isin(wanted)).select("list", "chunk_id", "embedding", *META)
        hits = near.mapInArrow(_probe(block, asked, k, dimension), HITS)
        best = top_k_spread(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
        parts = best if parts is None else parts.unionByName(best)
    return parts


def _probe(block: QueryBlock, asked: np.ndarray, k: int, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(block.ids):
            return
        best = Best(len(block.ids), k)
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            order = np.argsort(numbers, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
                queries = np.flatnonzero(asked[numbers[rows[0]]]) if len(rows) else []
                if not len(queries):
                    continue
                part = batch.take(pa.array(rows))
                vectors = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dimension).astype(np.float64)
                scores, ids = cosine_scores(block.some(queries), vectors), part.column(1).to_numpy()
                meta = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in META]
                for place, query in enumerate(queries.tolist()):
                    allowed = block.allowed(query, *meta)
                    best.add(query, ids[allowed], scores[place][allowed])
        yield best.batch(block.ids)

    return run
