"""Nearest sparse vectors by their largest contributions.

Sparse vectors are stored as postings in blocks: for each slot and block the vectors that have the slot,
their values, and ``top``, the largest value without its sign. A search opens the slots of its queries and
brings those of a block together in one task. The sum of a query's weights times the tops bounds every score
in the block; a block that cannot reach the query's k-th best score so far is skipped. No pair of a query and
a vector becomes a row, and the commonest slot lies in as many rows as there are blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vocarium.operators.lexical import collected_batches
from vocarium.operators.postings import BLOCK, TOGETHER, blocks, by_block
from vocarium.operators.ranking import HITS, Best, top_k_spread
from vocarium.session import written

_POSTINGS = "key string, block bigint, top double, slot array<int>, chunk_id array<bigint>, value array<double>"
_ENTRY = ("slot", "chunk_id", "value")


def sparse_index(stored: DataFrame, block: int = BLOCK) -> DataFrame:
    """Written postings of ``stored(id, indices, values)``; values of equal indices of a vector are added.

    Null and empty vectors have none.
    """
    arrow = to_arrow_schema(stored.sparkSession.createDataFrame([], _POSTINGS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER * block):
                part = batch.slice(at, TOGETHER * block)
                lists = part.column(1)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                index, values = lists.flatten().to_numpy(), part.column(2).flatten().to_numpy()
                if len(index):
                    yield _rows(part.column(0).to_numpy(), doc, index, values, first, block, arrow)
                first += -(-part.num_rows // block)

    whole = F.coalesce(F.size("indices") == F.size("values"), F.lit(False))
    read = stored.filter(whole).select(F.col("id").cast("bigint"), F.col("indices").cast("array<bigint>"), F.col("values").cast("array<double>"))
    return written(read.mapInArrow(run, _POSTINGS), "sparse-postings")


def _rows(ids: np.ndarray, doc: np.ndarray, index: np.ndarray, values: np.ndarray, first: int, size: int, arrow: pa.Schema) -> pa.RecordBatch:
    order = np.lexsort((doc, index, doc // size))
    doc, index, values = doc[order], index[order], values[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(index, prepend=index[0] - 1) != 0))
    doc, index, values = doc[new], index[new], np.add.reduceat(values, new)
    block = doc // size
    starts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(index, prepend=index[0] - 1) != 0))
    offsets = pa.array(np.append(starts, len(doc)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((doc % size, pa.int32()), (ids[doc], pa.int64()), (values, pa.float64()))]
    return pa.RecordBatch.from_arrays([
        pa.array(index[starts]).cast(pa.string()), pa.array(block[starts] + first), pa.array(np.maximum.reduceat(np.abs(values), starts)), *lists], schema=arrow)


def sparse_search(queries: DataFrame, index: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Best ``k`` stored vectors by dot product: ``(query_id, chunk_id, score, rank)``; ties by id.

    ``queries(query_id, indices, values)`` against ``sparse_index``; a vector without a common index is no hit.
    """
    parts = None
    for ids, wanted in _asked(queries):
        hits = by_block(index, list(wanted), 1).mapInArrow(_nearest(ids, wanted, k, block), HITS)
        best = top_k_spread(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
        parts = best if parts is None else parts.unionByName(best)
    return parts


def sparse_dot(queries: DataFrame, index: DataFrame, block: int = BLOCK) -> DataFrame:
    """Dot products of every query with every stored vector that shares an index with it: ``(query_id, chunk_id, score)``.

    The queries travel to the blocks; hits are sent as they are found and are not shuffled.
    """
    parts = None
    for ids, wanted in _asked(queries):
        hits = by_block(index, list(wanted), 1).mapInArrow(_products(ids, wanted, block), HITS)
        parts = hits if parts is None else parts.unionByName(hits)
    return parts


Wanted = dict[str, tuple[np.ndarray, np.ndarray]]


def _asked(queries: DataFrame) -> Iterator[tuple[np.ndarray, Wanted]]:
    """Ids of the queries of a batch, and by slot the places and weights of those that have it."""
    for rows in collected_batches(queries, "query_id", F.col("indices").cast("array<string>").alias("indices"), F.col("values").cast("array<double>").alias("values")):
        weights: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for place, row in enumerate(rows):
            for slot, value in zip(row["indices"] or [], row["values"] or []):
                weights[slot][place] += value
        wanted = {slot: (np.array(list(own)), np.array(list(own.values()))) for slot, own in weights.items()}
        yield np.array([row["query_id"] for row in rows], dtype=np.int64), wanted


def _met(batches: Iterator[pa.RecordBatch], wanted: Wanted):
    """Of each block its entries and its matches: query, weight and place of the entry, by query."""
    for keys, tops, entries in blocks(batches, _ENTRY):
        holders = [wanted[key] for key in keys]
        of = np.repeat(np.arange(len(keys)), [len(h[0]) for h in holders])
        query, weight = (np.concatenate([h[i] for h in holders]) for i in (0, 1))
        order = np.argsort(query, kind="stable")
        yield entries, np.array(tops), query[order], weight[order], of[order]


def _named(entries: list[dict[str, np.ndarray]], size: int) -> np.ndarray:
    """Ids of the vectors of a block by slot."""
    named = np.zeros(size, np.int64)
    for entry in entries:
        named[entry["slot"]] = entry["chunk_id"]
    return named


def _scores(entries: list[dict[str, np.ndarray]], weight: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of every slot for one query, and which slots it meets."""
    score, met = np.zeros(size), np.zeros(size, bool)
    for w, at in zip(weight.tolist(), of.tolist(), strict=True):
        slots = entries[at]["slot"]
        score[slots] += w * entries[at]["value"]
        met[slots] = True
    return np.round(score, 9), met


def _products(ids: np.ndarray, wanted: Wanted, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries, _, query, weight, of in _met(batches, wanted):
            named, cuts = _named(entries, size), np.flatnonzero(np.diff(query)) + 1
            for q, w, at in zip(np.split(query, cuts), np.split(weight, cuts), np.split(of, cuts), strict=True):
                score, met = _scores(entries, w, at, size)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(met.sum(), ids[q[0]])), pa.array(named[met]), pa.array(score[met])], names=["query_id", "chunk_id", "score"])

    return run


def _nearest(ids: np.ndarray, wanted: Wanted, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        best = Best(len(ids), k)
        for entries, tops, query, weight, of in _met(batches, wanted):
            bound = np.bincount(query, np.abs(weight) * tops[of], len(ids))
            present = np.unique(query)
            first, beyond = np.searchsorted(query, present, "left"), np.searchsorted(query, present, "right")
            named = _named(entries, size)
            for q, start, end in zip(present.tolist(), first.tolist(), beyond.tolist(), strict=True):
                if bound[q] * (1 + 1e-12) + 1e-9 < best.least(q):
                    continue
                score, met = _scores(entries, weight[start:end], of[start:end], size)
                best.add(q, named[met], score[met])
        yield best.batch(ids)

    return run
