"""Benchmark decontamination: CGK walks, bit sampling and exact edit distances.

Texts are word sequences: lower-cased runs of letters and digits. A document is contaminated by an
item when some window of it is within ``1 - similarity`` of the item's length in word edits.

For every window of an item's size the CGK random walk embeds its words: at each step it emits the
current word, and a random bit of (step, word) says whether it moves on. Sequences a few edits apart
get embeddings a small Hamming distance apart. Tables of sampled embedding positions are compared by
equality; walks and samples are repeated until simulated edits at the bound are found with the wanted
recall. Every window that meets an item in a table is verified by the exact edit distance, so no
false match is ever reported.

Only windows that can match are embedded: ``k`` edits change at most ``k * q`` of the ``n - q + 1`` runs
of ``q`` words, so a window with fewer than the others of the items' runs is out of reach. That test
loses nothing, and it is what keeps the cost near that of reading the text.

Items are sent to the tasks in blocks of a bounded number of words, one pass over the documents a
block; documents are never gathered or paired with each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from vocarium.llm.rows import map_rows, texts

SIMILARITY = 0.8
RECALL = 0.98
#: Sampled positions that must agree in a table, independent walks at most, tables of each walk.
SAMPLED = 3
WALKS = 48
TABLES = 8
#: Words of all items in one block, which is sent to every task.
BLOCK_WORDS = 200_000
#: Text that is searched at a time.
BATCH_BYTES = 1_000_000
SEED = 29

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def bound(n: int, similarity: float = SIMILARITY) -> int:
    """Word edits allowed for an item of ``n`` words."""
    return int((1 - similarity) * n + 1e-9)


def run_length(n: int, similarity: float = SIMILARITY) -> int:
    """Length of a run of words that survives every allowed set of edits."""
    k = bound(n, similarity)
    return max(1, -(-(n - k) // (k + 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads equal words over all bits, differently for every salt added before."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Walk:
    """One CGK walk: bits of (step, word) for the block's words, and its tables of sampled steps."""

    bits: np.ndarray  # steps x alphabet
    samples: np.ndarray  # tables x sampled, ascending steps

    def embed(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys (tables x windows). ``ids`` is padded with zeros, the word outside all items."""
        at = starts.copy()
        last = int(self.samples.max())
        keys = np.zeros((len(self.samples), len(starts)), np.uint64)
        for step in range(last + 1):
            word = ids[at]
            for table in np.flatnonzero((self.samples == step).any(axis=1)):
                keys[table] = _mix(keys[table] * np.uint64(31) + word.astype(np.uint64) + np.uint64(step + 1))
            at += self.bits[step][word]
        return keys


@dataclass
class Group:
    """Items of like length: their walks and, for every table, sorted keys with the item of each."""

    longest: int
    runs: int  # runs of the items' words that a window in reach has at least
    walks: list[Walk] = field(default_factory=list)
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)


class Matcher:
    """Finds the windows of a document that are near an item of the block."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY, recall: float = RECALL,
                 seed: int = SEED):
        self.similarity = similarity
        split = [(key, words_of(text)) for key, text in items]
        split = [(key, words) for key, words in split if words]
        self.keys = [key for key, _ in split]
        self.vocabulary: dict[str, int] = {}
        for _, words in split:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.items = [np.array([self.vocabulary[w] for w in words], np.int32) for _, words in split]
        self.bounds = np.array([bound(len(i), similarity) for i in self.items], np.int32)
        self.run = min((run_length(len(i), similarity) for i in self.items), default=1)
        self.run = min(self.run, 3)
        self.runs = np.unique(np.concatenate([self._runs(i) for i in self.items])) if self.items else np.zeros(0, np.uint64)
        self.longest = max((len(i) for i in self.items), default=0)
        rng = np.random.default_rng(seed)
        self.groups = [self._group(members, rng, recall) for members in self._by_length()]

    def _by_length(self) -> Iterator[list[int]]:
        """Items by length, a new group wherever the length has grown by half."""
        order = sorted(range(len(self.items)), key=lambda i: len(self.items[i]))
        members: list[int] = []
        for i in order:
            if members and len(self.items[i]) > 1.5 * len(self.items[members[0]]):
                yield members
                members = []
            members.append(i)
        if members:
            yield members

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of the runs of ``run`` words at every position that has one."""
        n = len(ids) - self.run + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(self.run):
            key = _mix(key * np.uint64(31) + ids[k:n + k].astype(np.uint64))
        return key

    def _group(self, members: list[int], rng: np.random.Generator, recall: float) -> Group:
        """Walks and tables until edits at the bound are found with the wanted recall."""
        shortest = min(len(self.items[i]) for i in members)
        runs = min(len(self.items[i]) - self.run + 1 - int(self.bounds[i]) * self.run for i in members)
        group = Group(max(len(self.items[i]) for i in members), max(1, runs))
        # Simulated near copies: each item with as many random edits as it allows.
        trials = [members[int(t)] for t in rng.integers(0, len(members), 200)]
        edited = [self._edited(self.items[i], int(self.bounds[i]), rng) for i in trials]
        copies, copy_at = self._lay(edited)
        originals, original_at = self._lay([self.items[i] for i in trials])
        found = np.zeros(len(trials), bool)
        steps = max(1, 2 * shortest - 2)
        while len(group.walks) < WALKS and found.mean() < recall or not group.walks:
            # Sampled steps lie early, where the two walks have had the least occasion to part.
            span = max(1, steps // (1 + len(group.walks) % 3))
            sampled = min(SAMPLED, span)
            samples = np.sort(np.array([rng.choice(span, sampled, replace=False) for _ in range(TABLES)]), axis=1)
            bits = rng.integers(0, 2, (int(samples.max()) + 1, len(self.vocabulary) + 1), dtype=np.int8)
            walk = Walk(bits, samples)
            found |= (walk.embed(copies, copy_at) == walk.embed(originals, original_at)).any(axis=0)
            group.walks.append(walk)
        ids, starts = self._lay([self.items[i] for i in members])
        numbers = np.array(members)
        for walk in group.walks:
            tables = []
            for keys in walk.embed(ids, starts):
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], numbers[order]))
            group.tables.append(tables)
        return group

    def _edited(self, ids: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
        """A copy with ``edits`` words changed, left out or put in; the window begins on its first word."""
        out = ids.tolist()
        for kind in rng.integers(0, 3, edits).tolist():
            at = int(rng.integers(1, max(2, len(out))))
            if kind < 2:
                out[at:at + 1] = [0] * (kind == 0)
            else:
                out.insert(at, 0)
        return np.array(out, np.int32)

    def _lay(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sequences one after the other, padded so that walks never leave theirs unnoticed."""
        room = 2 * self.longest + 2
        ids = np.zeros(room * max(1, len(sequences)), np.int32)
        starts = np.arange(len(sequences), dtype=np.int64) * room
        for start, sequence in zip(starts, sequences):
            ids[start:start + len(sequence)] = sequence
        return ids, starts

    def match(self, texts: list[str]) -> Iterator[tuple[int, int | None, int, int, int, int]]:
        """``(text, item, first word, words, edits, item words)``: the nearest window of every item in reach."""
        if not self.items:
            return
        get = self.vocabulary.get
        split = [words_of(text) for text in texts]
        # Texts side by side, parted by so many outside words that no window or walk reaches the next.
        room = 2 * self.longest + 2
        lengths = np.array([len(words) for words in split], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths + room)])
        ids = np.zeros(int(begins[-1]), np.int32)
        for begin, words in zip(begins.tolist(), split):
            ids[begin:begin + len(words)] = [get(w, 0) for w in words]
        if len(ids) < room + self.run:
            return
        seeded = self._seeded(ids)
        if not seeded.any():
            return
        for (text, item), near in self._candidates(ids, begins, seeded):
            best = self._best(ids, int(begins[text]), int(begins[text] + lengths[text]), item, near)
            if best is not None:
                yield (text, self.keys[item], *best, len(self.items[item]))

    def _seeded(self, ids: np.ndarray) -> np.ndarray:
        """Positions where a run of the items' words begins."""
        known = ids > 0
        whole = known[:len(ids) - self.run + 1].copy()
        for k in range(1, self.run):
            whole &= known[k:len(ids) - self.run + 1 + k]
        at = np.flatnonzero(whole)
        if len(at):
            key = np.zeros(len(at), np.uint64)
            for k in range(self.run):
                key = _mix(key * np.uint64(31) + ids[at + k].astype(np.uint64))
            place = np.minimum(np.searchsorted(self.runs, key), len(self.runs) - 1)
            whole[at] = self.runs[place] == key
        return whole

    def _candidates(self, ids: np.ndarray, begins: np.ndarray, seeded: np.ndarray):
        """``((text, item), window starts)`` of the windows that agree with the item in a table."""
        mine: dict[tuple[int, int], list[int]] = {}
        for group in self.groups:
            starts = self._starts(seeded, group)
            for at in range(0, len(starts), 1 << 16):
                block = starts[at:at + (1 << 16)]
                for walk, tables in zip(group.walks, group.tables):
                    for keys, (sorted_keys, numbers) in zip(walk.embed(ids, block), tables):
                        low = np.searchsorted(sorted_keys, keys, "left")
                        high = np.searchsorted(sorted_keys, keys, "right")
                        for w in np.flatnonzero(high > low):
                            text = int(np.searchsorted(begins, block[w], "right")) - 1
                            for item in numbers[low[w]:high[w]].tolist():
                                mine.setdefault((text, item), []).append(int(block[w]))
        for pair, found in sorted(mine.items()):
            yield pair, np.unique(found)

    def _starts(self, seeded: np.ndarray, group: Group) -> np.ndarray:
        """Starts of the windows with enough of the items' runs to be in reach of the group."""
        size = group.longest + bound(group.longest, self.similarity) - self.run + 1
        runs = np.concatenate([[0], np.cumsum(seeded)])
        ends = np.minimum(np.arange(len(seeded)) + size, len(seeded))
        return np.flatnonzero(runs[ends] - runs[:-1] >= group.runs)

    def _best(self, ids: np.ndarray, first: int, last: int, item: int, near: np.ndarray) -> tuple[int, int, int] | None:
        """Nearest window over the regions around ``near``: first word, words, edits; None out of reach."""
        pattern, most = self.items[item], int(self.bounds[item])
        best = None
        reach = len(pattern) + most
        cuts = np.flatnonzero(np.diff(near) > reach) + 1
        members = np.zeros(len(self.vocabulary) + 1, bool)
        members[pattern] = True
        for part in np.split(near, cuts):
            begin, end = max(first, int(part[0]) - most), min(last, int(part[-1]) + reach)
            region = ids[begin:end]
            if np.count_nonzero(members[region]) < len(pattern) - most:
                continue
            found = nearest_window(pattern, region)
            if found[2] <= most and (best is None or (found[2], begin - first + found[0]) < (best[2], best[0])):
                best = (begin - first + found[0], found[1], found[2])
        return best


def nearest_window(pattern: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """``(start, words, edits)`` of the stretch of ``region`` with the fewest word edits to ``pattern``.

    Ties go to the earliest end, and there to the latest start.
    """
    steps = np.arange(len(region) + 1)
    # Edits and negated start in one number, so that the minimum settles both.
    scale = len(region) + 1
    row = -steps.astype(np.int64)
    for word in pattern:
        changed = np.append(True, region != word)
        up = row + scale
        diagonal = np.append(row[0] + scale, row[:-1] + scale * changed[1:])
        held = np.minimum(up, diagonal)
        row = np.minimum.accumulate(held - scale * steps) + scale * steps
    end = int(np.argmin(-(-row // scale)))
    edits = int(-(-row[end] // scale))
    start = int(edits * scale - row[end])
    return start, end - start, edits


# --- Spark --------------------------------------------------------------------------------------


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of a bounded number of bytes, read by the driver one block at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    block: list[tuple[int | None, str]] = []
    size = 0
    for row in items.filter("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        words = len(row["text"]) // 4 + 1
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += words
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                 recall: float = RECALL) -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, edits, similarity)`` for each document and item in reach.

    ``docs(doc_id, text)`` against ``benchmark(item_id, text)``; the nearest window stands for the
    pair. Null and empty texts match nothing, items without a word are no items, repeated documents
    give repeated rows, equal items are one item per id. Ids may be null. Other columns are ignored,
    empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word long, n_words long, edits long, item_words long"
    out: DataFrame | None = None
    for block in item_blocks(benchmark):
        found = _search(spark, docs, block, similarity, recall, schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select("doc_id", "item_id", "first_word", "n_words", "edits",
                      (1 - F.col("edits") / F.col("item_words")).alias("similarity"))


def _search(spark: SparkSession, docs: DataFrame, block: list, similarity: float, recall: float,
            schema: str) -> DataFrame:
    shared = spark.sparkContext.broadcast((block, similarity, recall))

    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        matcher = Matcher(*shared.value)
        keys: list = []
        held: list[str] = []
        size = 0
        for key, text in rows:
            keys.append(key)
            held.append(text.decode())
            size += len(text)
            if size >= BATCH_BYTES:
                yield from ((keys[found[0]], *found[1:]) for found in matcher.match(held))
                keys, held, size = [], [], 0
        yield from ((keys[found[0]], *found[1:]) for found in matcher.match(held))

    return map_rows(texts(docs), work, schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that no item contaminates, with their columns.

    A row is judged by its text alone and found again by the text's hash; ids may repeat or be null.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = [name.lower() for name in docs.columns].index("text")
    rows = docs.toDF(*names).withColumn("_text", F.xxhash64(F.col(names[place]).cast("string")))
    judged = contaminated(rows.select(F.col("_text").alias("doc_id"), F.col(names[place]).alias("text")), benchmark, similarity)
    found = judged.select(F.col("doc_id").alias("_text")).distinct()
    return rows.join(found, "_text", "left_anti").select(*names).toDF(*docs.columns)
