"""Full-text and quote search for many queries at once, answered from the written index.

A search opens the postings of its own keys only and brings those of a block of documents together in one
task. There a query skips the blocks whose largest score parts cannot reach the k-th best score so far;
quotes follow stored word positions. Documents themselves are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.functions import text as tx
from vocarium.operators.postings import (
    ROOT_ENTRY, WORD_ENTRY, Asked, SearchIndex, asked, blocks_with_meta, by_block, quote_tokens, rarity, term_part, word_key)
from vocarium.operators.ranking import HITS, Best, global_position, top_k_spread

#: Queries answered by one scan; larger sets take several scans.
QUERY_BATCH = 5_000

_FILTERS = ("q_short", "q_4k", "date_lo", "date_hi", "v_id")


def query_batches(queries: DataFrame, size: int = QUERY_BATCH) -> Iterator[DataFrame]:
    """Split a query set into parts of at most ``size`` rows, small enough to broadcast."""
    total = queries.count()
    if total <= size:
        yield queries
        return
    numbered = global_position(queries, ["query_id"], "_number")
    for first in range(0, total, size):
        yield numbered.filter(F.col("_number").between(first, first + size - 1)).drop("_number")


def collected_batches(queries: DataFrame, *columns: Column | str) -> Iterator[list]:
    """Rows of the query set, at most ``QUERY_BATCH`` at a time."""
    rows = queries.select(*columns).limit(QUERY_BATCH + 1).collect()
    if len(rows) <= QUERY_BATCH:
        yield rows
        return
    for batch in query_batches(queries, QUERY_BATCH):
        yield batch.select(*columns).collect()


def build_postings(points: DataFrame) -> DataFrame:
    """Postings ``(root, chunk_id, tf, length)``; counted per document, so no term gathers in one task.

    Texts are moved to the task of their document before they are cut, as they are smaller than their postings.
    """
    moved = points.select("chunk_id", F.concat_ws(" ", "title", "text").alias("text")).repartition("chunk_id")
    index = moved.select("chunk_id", tx.roots(F.col("text")).alias("roots"))
    return (index.select("chunk_id", F.size("roots").cast("bigint").alias("length"), F.explode("roots").alias("root"))
            .groupBy("chunk_id", "root").agg(F.count("*").alias("tf"), F.first("length").alias("length")))


def bm25_search(queries: DataFrame, index: SearchIndex, k: int = 100, match: str = "all") -> DataFrame:
    """Best ``k`` documents per query: ``(query_id, chunk_id, score, rank)``; ties by id.

    ``queries`` comes from ``with_parsed_query``. ``match`` is ``all`` (every root must occur) or ``any``.
    """
    every = match == "all"
    roots = F.array_distinct(tx.roots(tx.sanitize_query(F.col("clean"))))
    parts = None
    # The queries of a batch and the frequencies of their roots are bounded by its size.
    for rows in collected_batches(queries, "query_id", *_FILTERS, roots.alias("roots")):
        frequencies = _frequencies(index, sorted({root for row in rows for root in row["roots"]}))
        if every:
            rows = [row for row in rows if row["roots"] and all(root in frequencies for root in row["roots"])]
        terms: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for place, row in enumerate(rows):
            for root in row["roots"]:
                if root in frequencies:
                    terms[root].append((place, frequencies[root]))
        wanted = {root: (np.array([p for p, _ in own]), np.array([w for _, w in own])) for root, own in terms.items()}
        count = np.array([len(row["roots"]) if every else 1 for row in rows], dtype=np.int64)
        work = _ranked(asked(rows), wanted, count, k, index.average)
        found = by_block(index.roots, list(wanted), index.folders, index.root_meta).mapInArrow(work, HITS)
        best = top_k_spread(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
        parts = best if parts is None else parts.unionByName(best)
    return parts


def _frequencies(index: SearchIndex, roots: list[str]) -> dict[str, float]:
    """How much each root weighs that some document has."""
    wanted = index.terms.sparkSession.createDataFrame([(r,) for r in roots], "key string")
    found = index.terms.join(F.broadcast(wanted), "key").select("key", rarity(index.total, F.col("df")).alias("weight"))
    return {r["key"]: r["weight"] for r in found.collect()}


def _ranked(queries: Asked, wanted: dict[str, tuple[np.ndarray, np.ndarray]], count: np.ndarray, k: int, average: float):
    """Best ``k`` of a task's blocks for each query; ``wanted`` has queries and weights by root, ``count`` the roots a hit needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(queries.ids):
            return
        best = Best(len(queries.ids), k)
        for keys, tops, entries, meta in blocks_with_meta(batches, ROOT_ENTRY):
            holders = [wanted[key] for key in keys]
            of = np.repeat(np.arange(len(keys)), [len(h[0]) for h in holders])
            query, weight = (np.concatenate([h[i] for h in holders]) for i in (0, 1))
            met = np.bincount(query, minlength=len(queries.ids))
            bound = np.bincount(query, weight * np.array(tops)[of], len(queries.ids))
            alive = [q for q in np.flatnonzero(met >= count).tolist() if met[q] and bound[q] + 1e-8 >= best.least(q)]
            if not alive:
                continue
            parts = [term_part(e["tf"], e["length"], average) for e in entries]
            size = len(meta["chunk_id"])
            order = np.argsort(query, kind="stable")
            first, beyond = np.searchsorted(query[order], alive, "left"), np.searchsorted(query[order], alive, "right")
            for q, start, end in zip(alive, first.tolist(), beyond.tolist(), strict=True):
                score, hits = np.zeros(size), np.zeros(size, np.int64)
                for at in order[start:end].tolist():
                    slots = entries[of[at]]["slot"]
                    score[slots] += weight[at] * parts[of[at]]
                    hits[slots] += 1
                held = np.flatnonzero((hits >= count[q]) & (hits > 0) & queries.passes(q, meta))
                # Compared at nine decimals, so the order of summation cannot break a tie.
                best.add(q, meta["chunk_id"][held], np.round(score[held], 9))
        yield best.batch(queries.ids)

    return run


# -- quotes --------------------------------------------------------------------------------

#: Words allowed between two words of a quote.
GAP = 10


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quote_words(quote: Column) -> Column:
    """Quoted words with their roots."""
    return F.transform(quote, lambda w: F.struct(w.alias("word"), tx.word_root(w).alias("root")))


def word_matches(token: Column, word: Column) -> Column:
    """Does a token carry the root of a quoted word.

    Words of up to three letters match themselves and a tail of the two letters е, ё.
    """
    rest = F.substring(token, F.length(word["word"]) + 1, F.length(token))
    short = (F.length(word["word"]) > 3) | (F.btrim(rest, F.lit("её")) == "")
    return token.startswith(word["root"]) & short & ~token.endswith("_")


def quote_positions(words: Column, quote: Column) -> Column:
    """Positions of the last quoted word over all in-order matches with bounded gaps; empty when none.

    Positions, not starting points, are carried from word to word, so the work per row is
    bounded by words times quote length.
    """
    empty = F.array().cast("array<int>")

    def search(placed: Column, asked: Column) -> Column:
        def matching(word: Column) -> Column:
            return F.transform(F.filter(placed, lambda p: word_matches(p["t"], word)), lambda p: p["i"])

        def follow(reached: Column, word: Column) -> Column:
            after = F.filter(matching(word), lambda p: F.exists(reached, lambda r: (p > r) & (p - r <= GAP + 1)))
            return F.when(F.size(reached) == 0, reached).otherwise(after)

        rest = F.slice(asked, F.lit(2), F.greatest(F.size(asked) - 1, F.lit(0)))
        return F.aggregate(rest, matching(F.get(asked, F.lit(0))), follow)

    placed = F.transform(words, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    found = bind(placed, lambda ps: bind(quote_words(quote), lambda asked: search(ps, asked)))
    return F.when((F.size(words) == 0) | (F.size(quote) == 0), empty).otherwise(found)


def quote_match(text: Column, quote: Column) -> Column:
    """True when the text holds the quoted words in order with at most ten words between two."""
    return bind(quote_tokens(text), lambda words: F.size(quote_positions(words, quote)) > 0)


def quote_search(queries: DataFrame, index: SearchIndex, limits: int) -> DataFrame:
    """Chunks holding the quote: ``(query_id, chunk_id, score, rank)``, first ``limits`` per query by id.

    A block that lacks a key of a quote is skipped; in the others the positions of the words that match are
    followed from the first quoted word to the last.
    """
    words = F.transform(tx.tokens(F.col("clean")), lambda w: F.struct(w.alias("word"), tx.word_root(w).alias("root"), word_key(w).alias("key")))
    parts = None
    for rows in collected_batches(queries, "query_id", *_FILTERS, words.alias("words")):
        rows = [row for row in rows if row["words"]]
        quotes = [[(w["key"], w["word"], w["root"]) for w in row["words"]] for row in rows]
        keys = sorted({key for quote in quotes for key, _, _ in quote})
        found = by_block(index.words, keys, index.folders, index.word_meta).mapInArrow(_quoted(asked(rows), quotes, limits), HITS)
        best = top_k_spread(found, ["query_id"], [F.asc("chunk_id")], limits)
        parts = best if parts is None else parts.unionByName(best)
    return parts


def _quoted(queries: Asked, quotes: list[list[tuple[str, str, str]]], limits: int):
    needs: dict[str, list[int]] = defaultdict(list)
    for place, quote in enumerate(quotes):
        for key in {key for key, _, _ in quote}:
            needs[key].append(place)
    kinds = np.array([len({key for key, _, _ in quote}) for quote in quotes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not quotes:
            return
        best = Best(len(quotes), limits)
        for keys, _, entries, meta in blocks_with_meta(batches, WORD_ENTRY):
            met = np.bincount(np.concatenate([needs[key] for key in keys]), minlength=len(quotes))
            rows = dict(zip(keys, entries, strict=True))
            for q in np.flatnonzero(met == kinds).tolist():
                best.add(q, *_followed(quotes[q], rows, meta, queries, q))
        yield best.batch(queries.ids)

    return run


def _followed(quote: list[tuple[str, str, str]], rows: dict, meta: dict, queries: Asked, query: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the documents of a block that hold the quote, each with the score of a quote.

    Positions reached, not paths, are carried from word to word: a token counts when one of the ``GAP + 1``
    positions before it in its document was reached.
    """
    reached = None
    for key, word, root in quote:
        entry = rows[key]
        fits = np.array([_fits(token, word, root) for token in entry["known"].tolist()], bool)[entry["code"]]
        place = np.sort(entry["slot"][fits].astype(np.int64) << 32 | entry["pos"][fits])
        if reached is not None:
            before = np.searchsorted(reached, place) - 1  # the last reached position that is smaller
            place = place[(before >= 0) & (place - reached[before] <= GAP + 1)]
        reached = place
        if not len(reached):
            break
    slots = np.unique(reached >> 32)
    ids = meta["chunk_id"][slots[queries.passes(query, meta)[slots]]]
    return ids, np.full(len(ids), 100.0)


def _fits(token: str, word: str, root: str) -> bool:
    """As ``word_matches``, of a token without underscores."""
    return token.startswith(root) and (len(word) > 3 or not token[len(word):].strip("её"))
