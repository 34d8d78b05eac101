"""Vector search and embedding.

Exact search scans the vectors where they lie: each task multiplies its Arrow batches with a
bounded block of query vectors and keeps its best ``k`` per query, so no pair of a query and a
vector ever becomes a row. Query sets above the block size are answered block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.functions import text as tx
from vocarium.functions.identity import squared_norm
from vocarium.operators.filters import passes
from vocarium.operators.lexical import bind, query_batches
from vocarium.operators.ranking import HITS, Best, top_k, top_k_spread
from vocarium.session import materialise

#: Query vectors held by a task, and vectors multiplied at once.
QUERY_BLOCK, VECTOR_BLOCK = 512, 2048

#: Share of the vectors that is scanned first, for a lower bound of every query's scores.
PRESCAN = 1 / 64

_FILTERS = ("q_short", "q_4k", "date_lo", "date_hi", "v_id")
META = ("video_id", "recorded_date", "is_short", "is_4k")


class QueryBlock(NamedTuple):
    """Queries as arrays; -1 stands for a filter that is not set."""

    ids: np.ndarray
    unit: np.ndarray
    short: np.ndarray
    four_k: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    video: np.ndarray
    floor: np.ndarray

    def some(self, queries: np.ndarray) -> QueryBlock:
        return QueryBlock(*(column[queries] for column in self))

    def allowed(self, query: int, video: np.ndarray, date: np.ndarray, short: np.ndarray, four_k: np.ndarray) -> np.ndarray:
        """Which vectors pass the filters of a query; their columns in the order of ``META``."""
        passing = (date >= self.lo[query]) & (date <= self.hi[query])
        for wanted, column in ((self.short, short), (self.four_k, four_k), (self.video, video)):
            if wanted[query] >= 0:
                passing &= column == wanted[query]
        return passing


def query_block(queries: DataFrame) -> QueryBlock:
    """Collect one block; its rows are bounded by ``query_batches``."""
    optional = [F.coalesce(F.col(c).cast("bigint"), F.lit(-1)).alias(c) for c in ("q_short", "q_4k", "v_id")]
    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), "date_lo",
                          "date_hi", *optional).collect()
    unit = np.array([r["embedding"] for r in rows], dtype=np.float64)
    if len(rows):
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    column = lambda name: np.array([r[name] for r in rows], dtype=np.int64)
    return QueryBlock(column("query_id"), unit, column("q_short"), column("q_4k"), column("date_lo"),
                  column("date_hi"), column("v_id"), np.full(len(rows), -np.inf))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


#: Scores of every query of a block against every vector of a batch.
Scorer = Callable[[QueryBlock, np.ndarray], np.ndarray]


def cosine_scores(block: QueryBlock, vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    # Compared at nine decimals: the last bits of a matrix product depend on its shape.
    return np.round(block.unit @ unit.T, 9)


def sign_scores(block: QueryBlock, vectors: np.ndarray) -> np.ndarray:
    """Minus the Hamming distance of one-bit codes."""
    left, right = np.packbits(block.unit > 0, axis=1), np.packbits(vectors > 0, axis=1)
    distance = np.zeros((len(left), len(right)), dtype=np.float64)
    for byte in range(left.shape[1]):
        distance += np.bitwise_count(left[:, byte, None] ^ right[None, :, byte])
    return -distance


def _scan(block: QueryBlock, k: int, scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(block.ids):
            return
        best = Best(len(block.ids), k)
        for whole in batches:
            for start in range(0, whole.num_rows, VECTOR_BLOCK):
                batch = whole.slice(start, VECTOR_BLOCK)
                scores = scorer(block, _matrix(batch, "embedding").astype(np.float64))
                ids = batch.column("chunk_id").to_numpy()
                meta = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in META]
                for q in range(len(block.ids)):
                    allowed = block.allowed(q, *meta) & (scores[q] >= block.floor[q])
                    best.add(q, ids[allowed], scores[q][allowed])
        yield best.batch(block.ids)

    return run


def usable_vectors(points: DataFrame, dimension: int) -> DataFrame:
    """Vectors of the right length that are not zero."""
    return points.filter((F.size("embedding") == dimension) & (squared_norm(F.col("embedding")) > 0))


def _scan_all(queries: DataFrame, points: DataFrame, k: int, dimension: int, scorer: Scorer) -> DataFrame:
    vectors = usable_vectors(points, dimension).select("chunk_id", "embedding", *META)
    order = [F.desc("score"), F.asc("chunk_id")]
    parts = None
    for batch in query_batches(usable_vectors(queries, dimension), QUERY_BLOCK):
        block = query_block(batch)
        block = block._replace(floor=_floors(block, vectors.sample(PRESCAN, seed=1), k, scorer))
        best = top_k_spread(vectors.mapInArrow(_scan(block, k, scorer), HITS), ["query_id"], order, k)
        parts = best if parts is None else parts.unionByName(best)
    return parts


def _floors(block: QueryBlock, sample: DataFrame, k: int, scorer: Scorer) -> np.ndarray:
    """Score a vector must reach: that of the k-th best of a sample, per query.

    The k-th best of a part is never above the k-th best of the whole, so nothing that belongs
    in the result falls below it, while tasks far from the query send nothing.
    """
    kth = top_k_spread(sample.mapInArrow(_scan(block, k, scorer), HITS), ["query_id"],
                       [F.desc("score"), F.asc("chunk_id")], k).filter(F.col("rank") == k).select("query_id", "score")
    found = {r["query_id"]: r["score"] for r in kth.collect()}
    return np.array([found.get(int(i), -np.inf) for i in block.ids])


def knn_search(queries: DataFrame, points: DataFrame, k: int, dimension: int) -> DataFrame:
    """Exact cosine neighbours: ``(query_id, chunk_id, score, rank)``, filters applied first."""
    return _scan_all(queries, points, k, dimension, cosine_scores)


def knn_sign_bits(queries: DataFrame, points: DataFrame, k: int, dimension: int, oversample: int = 10) -> DataFrame:
    """Approximate neighbours: best one-bit codes, then exact scores for ``oversample * k`` of them."""
    parts = None
    for batch in query_batches(usable_vectors(queries, dimension), QUERY_BLOCK):
        coarse = _scan_all(batch, points, oversample * k, dimension, sign_scores).select("query_id", "chunk_id")
        best = _rerank(coarse, batch, points, k)
        parts = best if parts is None else parts.unionByName(best)
    return parts


def _rerank(candidates: DataFrame, queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    # A block's candidates are pairs of ids, bounded by queries times oversample; the vectors stay where they are.
    asked = queries.select("query_id", F.col("embedding").alias("q_embedding"))
    near = points.select("chunk_id", "embedding").join(F.broadcast(candidates), "chunk_id")
    scored = near.join(F.broadcast(asked), "query_id").select(
        "query_id", "chunk_id", cosine(F.col("q_embedding"), F.col("embedding")).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column) -> Column:
    return F.round(dot(left, right) / (F.sqrt(squared_norm(left)) * F.sqrt(squared_norm(right))), 9)


def sign_bands(embedding: Column, band_bits: int) -> Column:
    """Bucket of every band of ``band_bits`` signs: ``band:bits``."""
    bits = F.transform(embedding, lambda x: F.when(x > 0, "1").otherwise("0"))
    bands = F.sequence(F.lit(0), F.floor((F.size(embedding) - 1) / band_bits).cast("int"))
    return F.transform(bands, lambda b: F.concat(
        b.cast("string"), F.lit(":"), F.array_join(F.slice(bits, b * band_bits + 1, F.lit(band_bits)), "")))


def knn_lsh(queries: DataFrame, points: DataFrame, k: int, dimension: int, band_bits: int = 8) -> DataFrame:
    """Approximate neighbours among vectors that share a bucket with the query.

    Signs of the coordinates are cut into bands; points meet queries on equal buckets. A pair
    that shares several buckets counts in the first only, so nothing is de-duplicated later.
    """
    vectors = usable_vectors(points, dimension).withColumn("bands", sign_bands(F.col("embedding"), band_bits))
    parts = None
    for batch in query_batches(usable_vectors(queries, dimension), QUERY_BLOCK):
        asked = batch.select("query_id", *_FILTERS, F.col("embedding").alias("q_embedding"),
                             sign_bands(F.col("embedding"), band_bits).alias("q_bands"))
        asked = asked.withColumn("bucket", F.explode("q_bands"))
        shared = F.get(F.array_intersect("q_bands", "bands"), F.lit(0))
        near = vectors.withColumn("bucket", F.explode("bands")).join(F.broadcast(asked), "bucket").filter(
            passes() & (shared == F.col("bucket")))
        scored = near.select("query_id", "chunk_id", cosine(F.col("q_embedding"), F.col("embedding")).alias("score"))
        best = top_k_spread(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
        parts = best if parts is None else parts.unionByName(best)
    return parts


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours found, per query."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


# -- embedding -----------------------------------------------------------------------------

#: Takes a batch of texts, gives their vectors in the same order.
Embedder = Callable[[list[str]], list[list[float]]]


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """Offline default embedding: word counts hashed into ``dimension`` slots, unit length."""
    def count(found: Column) -> Column:
        # Removing a slot and comparing sizes counts it in a plain loop, without a lambda per word.
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)),
                           lambda slot: (F.size(found) - F.size(F.array_remove(found, slot))).cast("double"))

    def unit(counts: Column) -> Column:
        return bind(F.sqrt(squared_norm(counts)), lambda norm: F.transform(
            counts, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float")))

    return bind(word_slots(text, dimension), lambda found: bind(count(found), unit))


def word_slots(text: Column, dimension: int) -> Column:
    """Slot of every word of a text."""
    return F.transform(tx.tokens(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint"), F.lit(dimension)).cast("int"))


def _counted(dimension: int):
    """Unit vectors from ``(chunk_id, slots)``: all words of a batch are counted in one pass."""
    schema = pa.schema([("chunk_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            counts = np.bincount(row * dimension + lists.flatten().to_numpy(), minlength=n * dimension).reshape(n, dimension).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(1, keepdims=True))
            unit = (counts / np.where(norm > 0, norm, 1)).astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimension, pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], schema=schema)

    return run


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, dimension: int = 64,
                 batch_size: int = 50) -> DataFrame:
    """``(chunk_id, embedding)`` of every chunk with text.

    An ``embedder`` is called with batches of at most ``batch_size`` texts; a wrong number or
    length of vectors is an error. Without one the vectors are those of ``hashed_embedding``.
    """
    spoken = chunks.filter(~tx.is_blank(F.col("text")))
    if embedder is None:
        slots = F.coalesce(word_slots(F.col("text"), dimension), F.array().cast("array<int>")).alias("slots")
        read = spoken.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), slots)
        return read.mapInArrow(_counted(dimension), "chunk_id BIGINT, embedding ARRAY<FLOAT>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                vectors = embedder(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                    raise ValueError("embedder returned vectors of another number or length")
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": list(vectors)})

    return spoken.select("chunk_id", "text").mapInPandas(run, "chunk_id BIGINT, embedding ARRAY<FLOAT>")


def embedding_memo(texts: DataFrame, memo: DataFrame, task: str, model: str = "", dimension: int = 64,
                   embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Look up vectors by task and text, compute only the misses, each distinct text once.

    Gives the texts with their vectors and the rows to append to the memo.
    """
    keyed = texts.withColumn("key", F.sha2(F.concat_ws(":", F.lit(task), "text"), 256))
    missing = (
        keyed.join(memo.select("key"), "key", "left_anti")
        .groupBy("key").agg(F.first("text").alias("raw")))
    # Keys stand in for chunk ids while the misses are embedded.
    prompts = missing.select(F.col("key").alias("chunk_id"), tx.embedding_prompt(F.col("raw"), model, task).alias("text"))
    if embedder is None:
        fresh = prompts.select(F.col("chunk_id").alias("key"),
                               hashed_embedding(F.col("text"), dimension).alias("embedding"))
    else:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                yield pd.DataFrame({"key": frame["chunk_id"], "embedding": embedder(frame["text"].tolist())})

        fresh = prompts.mapInPandas(run, "key STRING, embedding ARRAY<FLOAT>")
    fresh = materialise(fresh)
    known = memo.select("key", "embedding").unionByName(fresh)
    return keyed.join(known, "key").drop("key"), fresh


def vector_issues(points: DataFrame, dimension: int) -> DataFrame:
    """Vectors of a wrong length or of no length."""
    size = F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0))
    kind = F.when(size != dimension, "vector_dimension").when(
        squared_norm(F.col("embedding")) < 1e-6, "zero_vector")
    return points.select("chunk_id", size.alias("actual_dimension"), kind.alias("category")).filter(
        F.col("category").isNotNull())
