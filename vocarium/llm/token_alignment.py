"""Tokens of two tokenizers side by side: groups of tokens that cover the same bytes.

A text is cut into units, each a space and what follows it, at places where neither tokenizer has a
token that reaches across. A unit is tokenised once by both: A by the ``tokenizers`` library, B by
``sentencepiece``. The character offsets of A and the spans of B say where most tokens end; where a
character is shared by several tokens, or written as single bytes, the tokens' decoded bytes say it.
Places where a token of A and one of B end cut the unit into groups.

How often two ids are linked is counted in documents. Each block of documents sends every id pair once,
however many of its documents hold it, and gets back one count for it; so the commonest pair has a row
for each block and not for each document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vocarium.llm.rows import KEPT, byte_alphabet, make_room, plain
from vocarium.session import written

#: Bytes of text that are cut and tokenised together, and whose id pairs are sent together; a longer document is alone.
BLOCK_BYTES = 8 << 20

#: Units that the tokenizers read as one text.
UNITS = 1 << 14

#: Id pairs in one row of a block.
PAIRS = 4096

#: Ids of B are below this, so a pair is one number.
SHIFT = 24

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Units(NamedTuple):
    """What the tokens of some units come to: numbers by unit, groups as text, and distinct id pairs by unit."""

    ok: np.ndarray
    numbers: list[np.ndarray]  # tokens of A, tokens of B, groups, links
    groups: pa.Array
    size: np.ndarray  # id pairs of each unit
    pairs: np.ndarray
    links: np.ndarray


class Pair:
    """Both tokenizers in one worker."""

    def __init__(self, tokenizer: str, model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.files = tokenizer, model
        self.a = Tokenizer.from_file(tokenizer)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        entries = {i: bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
                   for entry, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.is_byte = np.array([bool(_BYTE.fullmatch(p)) for p in pieces])
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.digits = pa.array([str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))], pa.large_binary())
        self.cuts = _cuts_before_spaces(tokenizer) and not any(re.search("[^▁]▁", p) for p in pieces)

    def units(self, words: list[str]) -> Units:
        """Units given without their leading space, in their order.

        Units are read many at a time as one text, which gives the tokens of each, since none reaches across a
        cut. Those that end in white space or hold the sign that B writes for a space are read alone.
        """
        alone = np.fromiter((not self.cuts or not w or w[-1].isspace() or "▁" in w for w in words), bool, len(words))
        joint = np.flatnonzero(~alone)
        order = [joint[at:at + UNITS] for at in range(0, len(joint), UNITS)] + [np.array([i]) for i in np.flatnonzero(alone)]
        parts = [part for chosen in order for part in self._read([words[i] for i in chosen.tolist()])]
        if not parts:
            return _units_of_nothing(0)
        back = np.argsort(np.concatenate(order), kind="stable")
        size = np.concatenate([p.size for p in parts])
        begin = np.cumsum(size) - size
        place = _ranges(begin[back], size[back])
        return Units(np.concatenate([p.ok for p in parts])[back], [np.concatenate([p.numbers[i] for p in parts])[back] for i in range(4)],
                     pa.concat_arrays([p.groups for p in parts]).take(pa.array(back)), size[back],
                     np.concatenate([p.pairs for p in parts])[place], np.concatenate([p.links for p in parts])[place])

    def _read(self, words: list[str]) -> list[Units]:
        """Entries of units that are read as one text, in halves where their tokens do not spell it or reach across."""
        text = " " + " ".join(words)
        raw = text.encode()
        units = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        found = self._ends(text, raw)
        if found is not None:
            ids_a, ends_a, ids_b, ends_b = found
            cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
            if np.isin(units, cuts, assume_unique=True).all():
                return [self._grouped(units, cuts, ids_a, ends_a, ids_b, ends_b)]
        if len(words) == 1:
            return [_units_of_nothing(1)]
        half = len(words) // 2
        return self._read(words[:half]) + self._read(words[half:])

    def _ends(self, text: str, raw: bytes) -> tuple[np.ndarray, ...] | None:
        """Ids and last bytes of the tokens of A and B, or None where they do not spell the text."""
        left, right = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        ids_a, ids_b = np.array(left.ids, np.int64), np.fromiter((p.id for p in right), np.int64, len(right))
        if (b"".join([self.bytes_a[i] for i in ids_a.tolist()]) != raw or b"".join([self.bytes_b[i] for i in ids_b.tolist()]) != raw):
            return None
        spelled_a, spelled_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        # Offsets count characters. Where the next token begins in this one's last character, its bytes say where it ends.
        offsets = np.array(left.offsets, np.int64)
        coarse = offsets[:, 1]
        if len(raw) != len(text):
            first_byte = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
            coarse = np.append(first_byte, len(raw))[coarse]
        shared = np.append(offsets[1:, 0] < offsets[:-1, 1], False)
        # Spans count bytes after the leading space. Single bytes of a character have one span, or none.
        spans = np.fromiter((p.end for p in right), np.int64, len(right)) + 1
        return ids_a, np.where(shared, spelled_a, coarse), ids_b, np.where(self.is_byte[ids_b], spelled_b, spans)

    def _grouped(self, units: np.ndarray, cuts: np.ndarray, ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> Units:
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        unit, n = np.searchsorted(units, cuts), len(units)
        per_a, per_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        total = lambda values: np.bincount(unit, values, n).astype(np.int64)
        numbers = [total(per_a), total(per_b), np.bincount(unit, minlength=n), total(per_a * per_b)]
        texts = pc.binary_join_element_wise(self._digits(ids_a, per_a), self._digits(ids_b, per_b), pa.scalar(b"|", pa.large_binary()))
        groups = pc.binary_join(_lists(texts, numbers[2]), pa.scalar(b";", pa.large_binary()))
        # Distinct ids of each side of a group, then every A with every B of it.
        side_a, many_a = np.unique(of_a << SHIFT | ids_a, return_counts=True)
        side_b, many_b = np.unique(of_b << SHIFT | ids_b, return_counts=True)
        mask = (1 << SHIFT) - 1
        kinds_b = np.bincount(side_b >> SHIFT, minlength=len(cuts))
        group = side_a >> SHIFT
        left = np.repeat(np.arange(len(side_a)), kinds_b[group])
        right = _ranges((np.cumsum(kinds_b) - kinds_b)[group], kinds_b[group])
        pair, times = (side_a[left] & mask) << SHIFT | side_b[right] & mask, many_a[left] * many_b[right]
        of = unit[group[left]]
        order = np.lexsort((pair, of))
        first, times = _sums((of[order], pair[order]), times[order])
        return Units(np.ones(n, bool), numbers, groups, np.bincount(of[order][first], minlength=n), pair[order][first], times)

    def _digits(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pc.binary_join(_lists(self.digits.take(pa.array(ids)), sizes), pa.scalar(b",", pa.large_binary()))


def _units_of_nothing(n: int) -> Units:
    none = np.zeros(0, np.int64)
    return Units(np.zeros(n, bool), [np.zeros(n, np.int64)] * 4, pa.array([b""] * n, pa.large_binary()), np.zeros(n, np.int64), none, none)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), values)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin``, ``size`` of them, one range after the other."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def _sums(keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the sum of its values."""
    if not len(values):
        return np.zeros(0, np.int64), values
    new = np.zeros(len(values), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.add.reduceat(values, first)


def _cuts_before_spaces(tokenizer: str) -> bool:
    """Does A's pre-tokenizer part every character that is no white space from a space after it."""
    with open(tokenizer, encoding="utf-8") as file:
        parts = json.load(file)
    before = parts.get("pre_tokenizer") or {}
    return parts.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(
        before.get("use_regex", True)) and not before.get("add_prefix_space")


def _pair(tokenizer: str, model: str) -> Pair:
    make_room(__name__)
    kept = KEPT.get(__name__)
    if not isinstance(kept, Pair) or kept.files != (tokenizer, model):
        kept = KEPT[__name__] = Pair(tokenizer, model)
    return kept


def _split(texts: pa.Array, pair: Pair) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First unit of each text and beyond the last one, the number of each unit, and the units by number."""
    if not pair.cuts:
        return np.arange(len(texts) + 1), np.arange(len(texts)), texts.to_pylist()
    lists = pc.split_pattern(texts, " ")
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    coded = lists.flatten().dictionary_encode()
    number, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    # A space after white space is no cut: such a part goes on in the next one.
    open_ = np.fromiter((not w or w[-1].isspace() for w in words), bool, len(words))
    last = starts[1:] - 1
    on = open_[number]
    on[last] = False
    empty = np.fromiter((not w for w in words), bool, len(words))
    tail = last[empty[number[last]] & (last > starts[:-1])]  # a space at the end belongs to what is before it
    on[tail - 1] = True
    if not on.any():
        return starts, number, words
    begins = np.flatnonzero(~np.concatenate([[False], on[:-1]]))
    lengths = np.diff(np.append(begins, len(number)))
    units = number[begins].copy()
    known = {}
    for k in np.flatnonzero(lengths > 1).tolist():
        joined = " ".join([words[n] for n in number[begins[k]:begins[k] + lengths[k]].tolist()])
        if joined not in known:
            known[joined] = len(words)
            words.append(joined)
        units[k] = known[joined]
    used, units = np.unique(units, return_inverse=True)
    return np.searchsorted(begins, starts), units, [words[n] for n in used.tolist()]


def _runs(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class _Part:
    """Counts, groups and id pairs of some documents."""

    def __init__(self, texts: pa.Array, pair: Pair):
        texts = pc.fill_null(texts, "")
        starts, number, words = _split(texts, pair)
        units = pair.units(words)
        first = starts[:-1]
        self.ok = np.minimum.reduceat(units.ok[number], first) & (pc.binary_length(texts).to_numpy() > 0)
        self.numbers = [np.add.reduceat(values[number], first) * self.ok for values in units.numbers]
        shown = self.ok[np.repeat(np.arange(len(first)), np.diff(starts))]
        self.groups = pc.binary_join(_lists(units.groups.take(pa.array(number[shown])), np.diff(starts) * self.ok), pa.scalar(b";", pa.large_binary()))
        self._pairs(starts, number, units)

    def _pairs(self, starts: np.ndarray, number: np.ndarray, units: Units) -> None:
        """``doc``, ``pair`` and ``links`` of every id pair of every document."""
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        held = self.ok[doc]
        key, times = np.unique(doc[held] * len(units.ok) + number[held], return_counts=True)
        doc, unit = np.divmod(key, len(units.ok))
        n = units.size[unit]
        place = _ranges((np.cumsum(units.size) - units.size)[unit], n)
        distinct, code = np.unique(units.pairs, return_inverse=True)
        key = np.repeat(doc, n) * max(len(distinct), 1) + code[place]
        order = np.argsort(key)
        key = key[order]
        first, self.links = _sums((key,), (units.links[place] * np.repeat(times, n))[order])
        self.doc, at = np.divmod(key[first], max(len(distinct), 1))
        self.pair = distinct[at]


def token_groups(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """``(doc_id, groups)`` with the whole alignment of every row of ``docs(doc_id, text)``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: decimal ids of A and B, one group after the other; see ``spans``.
    Texts that are null, empty or not spelled by the tokens have the empty string.
    """
    schema = "doc_id long, groups string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(tokenizer, model)
        for batch in batches:
            for block in _runs(batch, BLOCK_BYTES):
                part = _Part(block.column(1), pair)
                yield pa.RecordBatch.from_arrays([block.column(0), part.groups.cast(pa.large_string()).cast(pa.string())], schema=arrow)

    return _texts(docs).mapInArrow(run, schema)


def spans(groups: DataFrame) -> DataFrame:
    """One row a group of ``token_groups``: ``(doc_id, place, a_ids, b_ids)``."""
    parts = groups.filter("groups <> ''").select("doc_id", F.posexplode(F.split("groups", ";")).alias("place", "g"))
    ids = lambda i: F.split(F.split("g", r"\|")[i], ",").cast("array<int>")
    return parts.select("doc_id", "place", ids(0).alias("a_ids"), ids(1).alias("b_ids"))


def _texts(docs: DataFrame) -> DataFrame:
    return plain(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))


_ALIGNED = ("kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "first long, pairs array<long>, docs array<long>, places array<int>, links array<long>")


def _aligned(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """Rows of blocks (``kind`` 0: id pairs in order, ``docs`` holding each) and of
    documents (``kind`` 1: places of their pairs in the block, and the links of each)."""
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], _ALIGNED).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(tokenizer, model)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in _runs(batch, BLOCK_BYTES):
                yield from _block(number, block.column(0), _Part(block.column(1), pair), arrow)
                number += 1

    return _texts(docs).mapInArrow(run, _ALIGNED)


def _block(number: int, ids: pa.Array, part: _Part, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    pairs, place, counts = np.unique(part.pair, return_inverse=True, return_counts=True)
    for at in range(0, len(pairs), PAIRS):
        yield _rows(arrow, 1, kind=[0], block=[number], first=[at], pairs=[pairs[at:at + PAIRS]], docs=[counts[at:at + PAIRS]])
    bounds = np.searchsorted(part.doc, np.arange(len(ids) + 1))
    for start in range(0, len(ids), 1024):
        to = min(start + 1024, len(ids))
        cut, own = bounds[start:to + 1], slice(start, to)
        lists = [pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(x[cut[0]:cut[-1]], kind))
                 for x, kind in ((place, pa.int32()), (part.links, pa.int64()))]
        shas = [hashlib.sha256(g.as_buffer()).hexdigest() if g.as_buffer().size else "" for g in part.groups[start:to]]
        yield _rows(arrow, to - start, kind=np.ones(to - start, np.int32), block=np.full(to - start, number), doc_id=ids[own],
                    groups_sha256=shas, places=lists[0], links=lists[1],
                    **{name: x[own] for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), part.numbers, strict=True)})


def _rows(arrow: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    made = [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns
            else pa.nulls(n, f.type) for f in arrow]
    return pa.RecordBatch.from_arrays(made, schema=arrow)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, count, best)``: documents that hold two ids linked, and whether no other partner of the A id has more."""
    counts = aligned.filter("kind = 0").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    return counts.withColumn("best", F.col("count") == highest)


def alignment(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs(doc_id, text)``.

    A link is a token of A and one of B in one group; its count is the number of documents in which the
    two ids are linked; ``n_best`` are the links whose count is the highest of their A id, ``count_sum``
    adds the counts of all links. Whole texts are read. A text that is null, empty or not spelled by the
    tokens of both has zeros and an empty digest. Repeated rows are documents of their own, also those
    without an id; other columns play no part; an empty table gives an empty one.
    """
    aligned = written(_aligned(docs, tokenizer, model), "aligned")
    counts = written(pair_counts(aligned), "pair-counts")
    held = aligned.filter("kind = 0").select("block", "first", F.posexplode("pairs").alias("i", "pair"))
    told = held.join(counts, "pair").select("block", F.lit(0).alias("kind"), (F.col("first") + F.col("i")).alias("place"), "count", "best")
    own = [c for c in aligned.columns if c not in ("kind", "block", "first", "pairs", "docs")]
    rows = told.unionByName(aligned.filter("kind = 1").select("block", "kind", *own), allowMissingColumns=True).select(
        "block", "kind", "place", "count", "best", *own).repartition("block").sortWithinPartitions("block", "kind")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, table = None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for start, to in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if start == to:
                    continue
                part = batch.slice(start, to - start)
                if blocks[start] != block:
                    block, waiting, table = blocks[start], [], None
                if kinds[start] == 0:
                    waiting.append((part.column("place").to_numpy(), part.column("count").to_numpy(),
                                    part.column("best").to_numpy(zero_copy_only=False)))
                    continue
                if table is None:
                    table, waiting = _lookup(waiting), []
                yield _summed(part, table, arrow)

    return rows.mapInArrow(run, schema)


def _lookup(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and whether they are the best, by place in the block."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    place, count, best = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(place)
    return count[order], best[order].astype(bool)


def _summed(part: pa.RecordBatch, table: tuple[np.ndarray, np.ndarray], arrow: pa.Schema) -> pa.RecordBatch:
    lists = part.column("places")
    at, links = lists.flatten().to_numpy(), part.column("links").flatten().to_numpy()
    doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(part.num_rows, np.int64)
        np.add.at(sums, doc, values)
        return sums

    own = {"n_best": total(links * table[1][at]), "count_sum": total(links * table[0][at])}
    return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else part.column(f.name) for f in arrow], schema=arrow)
