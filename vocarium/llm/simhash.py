"""SimHash near-duplicates found with BK-trees.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Two fingerprints
link when few bits differ. Only distinct fingerprints are searched, so copies cost nothing more
than their hash.

Search: the 64 bits are cut into ``radius + 1`` bands, and the remaining bits of each band into
``radius + 1`` bands again. Fingerprints within the radius agree in a whole outer band and in a whole
inner band of the rest, so every link lies within at least one shard named by the two band values.
Each shard holds a BK-tree: children are keyed by their Hamming distance to the parent, and a query
at distance ``d`` follows only edges from ``d - radius`` to ``d + radius``. The trees are sent by
shuffle to the tasks that hold their queries and not broadcast to all executors, because together
they grow with the corpus. A shard gives the edges of a spanning forest, not its pairs.

Components are found by contraction, without gathering the neighbours of a node anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.llm.rows import map_rows, utf8
from vocarium.session import written

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
#: Bands of minima and minima in each: sets of Jaccard similarity 0.8 share none with probability 3e-6.
MIN_BANDS = 24
MIN_ROWS = 4
#: Bits of the marks of a set.
MARK_BITS = 512


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``shingle`` lower-cased words; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += block.sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def hex_digits(fingerprint: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, row_hash, fp)``: the fingerprint of every whole text as a signed 64-bit integer.

    Null and blank texts have fingerprint zero. Every input row gives a row; ``row_hash`` is a hash
    of all its columns.
    """
    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        for key, row, text in rows:
            yield key, row, signed(majority(shingle_hashes(text, shingle)))

    read = docs.select(F.col("doc_id").cast("bigint"), row_hash(docs), utf8("text"))
    return map_rows(read, work, "doc_id long, row_hash long, fp long")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def bands(bits: int, parts: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of ``parts`` bands of nearly equal width."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(values: np.ndarray, radius: int = RADIUS) -> Iterator[np.ndarray]:
    """For each of the ``(radius + 1) ** 2`` shard families the shard of each fingerprint."""
    parts = radius + 1
    family = 0
    for at, width in bands(BITS, parts):
        low = values & np.uint64((1 << at) - 1)
        rest = low | (values >> np.uint64(at + width) << np.uint64(at) if at + width < BITS else np.uint64(0))
        outer = values >> np.uint64(at) & np.uint64((1 << width) - 1)
        for inner_at, inner_width in bands(BITS - width, parts):
            inner = rest >> np.uint64(inner_at) & np.uint64((1 << inner_width) - 1)
            yield (outer << np.uint64(inner_width) | inner) * np.uint64(parts * parts) + np.uint64(family)
            family += 1


class BKTree:
    """A BK-tree over distinct 64-bit values: per node its value and its children by distance."""

    def __init__(self, values: Iterable[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            self.insert(value)

    def insert(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            distance = (self.values[at] ^ value).bit_count()
            if distance == 0:
                self.values.pop()
                self.children.pop()
                return
            at = self.children[at].setdefault(distance, new)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(node, positions of the queries within the radius)``; all queries walk down together."""
        stack = [(0, np.arange(len(queries)))] if self.values else []
        while stack:
            node, asked = stack.pop()
            distance = np.bitwise_count(queries[asked] ^ np.uint64(self.values[node])).astype(np.int16)
            near = asked[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = asked[np.abs(distance - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


def forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning edges ``(value, root)`` of the links among the distinct values of one shard."""
    if len(values) == 2:
        a, b = int(values[0]), int(values[1])
        if (a ^ b).bit_count() <= radius:
            yield b, a
        return
    tree = BKTree(values.tolist())
    label = np.arange(len(values))
    for _, near in tree.within(values, radius):
        labels = np.unique(label[near])
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
    for i in np.flatnonzero(label != np.arange(len(values))):
        yield int(values[i]), int(values[label[i]])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` exactly as all links do."""
    families = (radius + 1) ** 2

    def route(rows: Iterator[tuple]) -> Iterable[tuple]:
        for block in _blocks(rows, 4096):
            values = np.array([fp for (fp,) in block], np.int64)
            for keys in shard_keys(values.view(np.uint64), radius):
                yield from zip(keys.view(np.int64).tolist(), values.tolist())

    def search(rows: Iterator[tuple]) -> Iterable[tuple]:
        key, held = None, []
        for shard, fp in rows:
            if shard != key:
                if len(held) > 1:
                    yield from _signed_edges(held, radius)
                key, held = shard, []
            held.append(fp)
        if len(held) > 1:
            yield from _signed_edges(held, radius)

    routed = map_rows(distinct.select("fp"), route, "shard long, fp long", rows=4096 * families)
    # A task gets whole shards, one after the other; those of one fingerprint have nothing to link.
    sharded = routed.repartition("shard").sortWithinPartitions("shard", "fp")
    return map_rows(sharded, search, "a long, b long").distinct()


def _signed_edges(held: list[int], radius: int) -> Iterator[tuple[int, int]]:
    for a, b in forest(np.array(held, np.int64).view(np.uint64), radius):
        yield signed(a), signed(b)


def _blocks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``; equal roots, one component.

    Each round every node points at the neighbour with the least hash of that round, pointers are
    followed a few steps, and the graph is contracted to what they point at, so the number of rounds
    grows with the logarithm of the number of nodes. Neighbours are only ever reduced to a minimum.
    Each round's tables are written, so that the next one plans with their true sizes.
    """
    settled = lambda df: written(df, "components")
    edges = settled(edges.filter("a <> b").select("a", "b"))
    roots = settled(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                        .withColumn("root", F.col("node")))
    turn = 0
    while edges.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
        both = edges.union(edges.select("b", "a"))
        point = (
            both.groupBy("a").agg(F.min(rank("b")).alias("best"))
            .select(F.col("a").alias("node"), F.least("best", rank("a"))["v"].alias("up")))
        point = settled(point)
        for _ in range(2):
            above = point.select(F.col("node").alias("up"), F.col("up").alias("top"))
            point = point.join(above, "up").select("node", F.col("top").alias("up"))
        point = settled(point)
        start = point.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        end = point.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = settled(
            edges.join(start, "a").join(end, "b").filter("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        moved = point.select(F.col("node").alias("root"), F.col("up").alias("new_root"))
        roots = settled(roots.join(moved, "root", "left")
                            .select("node", F.coalesce("new_root", "root").alias("root")))
        turn += 1
    return roots


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, row_hash, fp, root, component_id)`` for every row of ``docs``; see ``near_duplicates``."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(links(distinct, radius))
    rooted = (
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = written(rooted.join(least, "root").select("fp", "root", "component_id"), "component_of_print")
    return marked.join(of_print, "fp").select("doc_id", "row_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, null where all ids of the
    component are null. Equal texts share a fingerprint and so a component; null and blank texts
    share fingerprint zero. Repeated rows are kept, other columns ignored, an empty table gives none.
    """
    return grouped(docs, shingle, radius).select("doc_id", "fp", "component_id")


def node_of(found: np.ndarray) -> int:
    """Number of a shingle set."""
    return signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def shingle_sets(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(node, hashes)``: the distinct shingle hashes of the rows of ``docs`` that ``rows(row_hash)`` names."""
    def work(texts: Iterator[tuple]) -> Iterable[tuple]:
        for (text,) in texts:
            found = np.unique(shingle_hashes(text, shingle))
            yield node_of(found), found.view(np.int64)

    read = docs.select(row_hash(docs).alias("row_hash"), utf8("text").alias("text")).join(rows, "row_hash", "left_semi").dropDuplicates(["row_hash"]).select("text")
    return map_rows(read, work, "node long, hashes array<long>", rows=256)


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, MIN_BANDS * MIN_ROWS), dtype=np.uint64)
_MASKS, _FACTORS = _DRAWN[0][:, None], _DRAWN[1][:, None] | np.uint64(1)


def min_bands(found: np.ndarray) -> list[int]:
    """A signed shard key for each band of ``MIN_ROWS`` minima of the set under fixed reorderings."""
    least = np.full(len(_MASKS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 1 << 12):
        mixed = (found[None, at:at + (1 << 12)] ^ _MASKS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * _FACTORS).min(axis=1), out=least)
    rows = least.reshape(MIN_BANDS, MIN_ROWS)
    return [signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(rows)]


def set_marks(found: np.ndarray) -> list[int]:
    """``MARK_BITS`` bits, each the parity of the hashes that fall on it; each hash in one of two sets only flips one bit."""
    place = (found * _FACTORS[0, 0]) >> np.uint64(BITS - MARK_BITS.bit_length() + 1)
    odd = np.bincount(place.astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()


def may_be_alike(similarity: float) -> Column:
    """Whether sizes and marks of two sets leave room for this Jaccard similarity; true for all that have it.

    At similarity ``s`` two sets differ in at most ``(1 - s) / (1 + s)`` of the sum of their sizes.
    """
    differ = sum((F.bit_count(F.get("marks", F.lit(i)).bitwiseXOR(F.get("a_marks", F.lit(i)))) for i in range(MARK_BITS // BITS)), F.lit(0))
    sizes = F.least("size", "a_size") >= F.lit(similarity) * F.greatest("size", "a_size") - 1e-6
    return sizes & (differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("size") + F.col("a_size")) + 1e-6)


def alike(docs: DataFrame, shingle: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, row_hash, root)`` for every row: components over pairs of at least this Jaccard similarity.

    Candidates are the links of the fingerprints, and pairs that share a band of minima, since at
    similarity 0.8 fingerprints differ in about 10 bits, where no band of them is whole any more. Each
    candidate is confirmed on the two whole shingle sets. A band's members meet a sample of themselves,
    which grows from round to round until all pairs have met or all members are in one component. They
    meet within neighbouring classes of size, and only pairs that sizes and marks do not rule out are
    candidates, so texts that share a passage but are not alike give none.
    """
    def mark(rows: Iterator[tuple]) -> Iterable[tuple]:
        for key, row, text in rows:
            hashes = shingle_hashes(text, shingle)
            found = np.unique(hashes)
            yield key, row, signed(majority(hashes)), node_of(found), len(found), min_bands(found) if len(found) else [], set_marks(found)

    read = docs.select(F.col("doc_id").cast("bigint"), row_hash(docs), utf8("text"))
    marked = written(map_rows(read, mark, "doc_id long, row_hash long, fp long, node long, size long, bands array<long>, marks array<long>", rows=256), "shingle_sets")
    nodes = written(marked.groupBy("node").agg(
        F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("row_hash").alias("row_hash"), F.min("bands").alias("bands"), F.min("marks").alias("marks")), "distinct_sets")
    marked = marked.select("doc_id", "row_hash", "node")
    # One set of each fingerprint stands for it in the fingerprints' links; the bands hold all sets.
    of_print = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = links(of_print, radius)
    ends = lambda name: of_print.select(F.col("fp").alias(name), F.col("node").alias(f"{name}_node"))
    candidates = near.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    members = nodes.select("node", F.explode("bands").alias("shard"))
    crowded = members.groupBy("shard").agg(F.count("node").alias("many")).filter("many > 1")
    members = written(members.join(crowded, "shard"), "band_members")
    near = members.select("node").union(candidates.select("a")).union(candidates.select("b")).distinct()
    sets = written(shingle_sets(docs, nodes.join(near, "node").select("row_hash"), shingle), "sets")
    edges = written(confirmed(candidates, sets, similarity), "alike")
    roots = components(edges)
    step = -math.log(similarity) + 1e-6
    marks = nodes.select("node", "size", "marks", F.floor(F.log("size") / step).alias("class"))
    met = 8
    while True:
        rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = written(rooted.join(
            rooted.groupBy("shard").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("shard"),
            "shard"), "band_members")
        marked_members = rooted.join(marks, "node")
        # The sample of a round holds those of the rounds before; with ``many`` members it is all of them.
        # A node is early or late in all its bands, so that the same few pairs are asked for in each.
        place = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)
        asked = marked_members.filter(place * F.col("many") < met).select(
            "shard", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("class"), F.col("node").alias("a"),
            F.col("size").alias("a_size"), F.col("marks").alias("a_marks"), F.col("root").alias("a_root"))
        pairs = marked_members.join(asked, ["shard", "class"]).filter((F.col("root") != F.col("a_root")) & may_be_alike(similarity)).select(
            F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        edges = written(edges.union(confirmed(pairs, sets, similarity)), "alike")
        roots = components(edges)
        most = rooted.agg(F.max("many")).first()[0] or 0
        if most <= met:
            break
        members, met = rooted.filter(F.col("many") > met).drop("root"), met * 64
    return marked.join(roots, "node", "left").select(
        "doc_id", "row_hash", F.coalesce("root", "node").alias("root"))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of nodes whose whole shingle sets have at least this Jaccard similarity.

    The two sets of a pair meet in one row of a join that can spill; common hashes are counted there.
    """
    pairs = written(pairs.filter("a <> b").distinct(), "candidates")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = sets.join(asked, "node", "left_semi")
    of = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"{name}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    alike = common >= F.lit(similarity - 1e-12) * (F.size("a_set") + F.size("b_set") - common)
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(alike).select("a", "b")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest ``doc_id``.

    Components are those of the fingerprints' links, or with ``similarity`` those of ``alike``. Among
    rows with this id in one component the least ``row_hash`` decides; of rows equal in all columns
    one is kept. Rows without an id come last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first")
    found = grouped(docs, shingle, radius) if similarity is None else alike(docs, shingle, similarity, radius)
    heads = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("_id"), F.col("first.row_hash").alias("_row"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (row_hash(docs) == F.col("_row"))
    return docs.join(heads.distinct(), same, "left_semi").dropDuplicates()
