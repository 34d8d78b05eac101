"""The search index: postings in blocks of documents, with the largest score part of each block.

Documents are cut into blocks of ``BLOCK``, in the order in which they lie; ``slot`` is a document's place
in its block. Four tables are written once and searched often:

* ``docs``: a row a document with its roots;
* ``roots``: a row for each root and block, with arrays of the slots that hold the root, its counts there and
  lengths, and ``top``, the largest score part of the root in the block, by which a search skips blocks;
* ``words``: a row for each quote key and block, with slot, position and word of every token under it, the
  word as its place among the row's different words ``known``;
* ``terms``: how many documents hold each root.

Beside each lie rows of its blocks with the ids and filter columns of their documents by slot, in a folder of
their own, so that no posting repeats them.

``roots`` and ``words`` lie in folders by a hash of their key and files by the task that cut the blocks, sorted
by key; they are written where they are made and not shuffled.
A search opens only the folders of its keys, a common key lies in many files, and no row grows beyond what a
block's documents hold. What a search has read under its keys meets in tasks by block, where all its queries
are answered; a task sends its best results of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vocarium.functions import text as tx
from vocarium.session import work_path, written

K1, B = 1.2, 0.75

#: Documents of a block.
BLOCK = 128

#: Blocks whose postings are sorted together.
TOGETHER = 8

#: Tokens of a folder, about. Each task writes a file in each folder, so there are few.
FOLDER_TOKENS = 100_000_000


class SearchIndex(NamedTuple):
    """The written tables; ``total`` and ``average`` are the number of documents and their mean length."""

    docs: DataFrame
    roots: DataFrame
    words: DataFrame
    terms: DataFrame
    total: int
    average: float
    folders: int
    block: int
    root_meta: DataFrame
    word_meta: DataFrame


#: Columns of a document that filters look at, key and folder of the rows that hold them, and arrays of the rows of ``roots`` and ``words``.
META = {"chunk_id": "bigint", "video_id": "bigint", "recorded_date": "int", "is_short": "boolean", "is_4k": "boolean"}
META_KEY, META_FOLDER = "", -1
ROOT_ENTRY = {"slot": "int", "tf": "int", "length": "int"}
WORD_ENTRY = {"slot": "int", "pos": "int", "code": "int", "known": "string"}


def term_part(tf, length, average: float):
    """Part of a BM25 score that a root's count in a document gives, before its rarity; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def rarity(total: int, df: Column) -> Column:
    return F.ln(1 + (F.lit(total) - df + 0.5) / (df + 0.5))


def quote_tokens(text: Column) -> Column:
    """Words in order; an underscore next to a word stays on it and keeps it from matching."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "_", "_ _"), F.lit(r"_?[\p{L}\p{N}]+_?"), F.lit(0))


def word_key(word: Column) -> Column:
    """Key shared by a quoted word and every token that can match it: words of up to three letters meet
    themselves but for a tail of the letters е, ё, others all words with their first three letters."""
    return F.when(F.length(word) <= 3, F.concat(F.lit("="), F.rtrim(word, F.lit("её")))).otherwise(
        F.concat(F.lit("~"), F.substring(word, 1, 3)))


def token_keys(token: str) -> list[str]:
    """Keys under which a token of a text is stored: one for short quoted words, one for long ones; none with an underscore."""
    if "_" in token:
        return []
    bare = token.rstrip("её")
    return (["=" + bare] if len(bare) <= 3 else []) + (["~" + token[:3]] if len(token) >= 3 else [])


def write_index(points: DataFrame, block: int = BLOCK, folder_tokens: int = FOLDER_TOKENS) -> SearchIndex:
    """Cut and write the documents ``points(chunk_id, video_id, title, text, recorded_date, is_short, is_4k, ...)``.

    An empty table gives an index that finds nothing. Repeated ids are documents of their own.
    """
    docs = points.withColumn("roots", tx.roots(F.concat_ws(" ", "title", "text"))).withColumn("length", F.size("roots"))
    docs = written(docs, "index-docs")
    stats = docs.agg(F.count("*").alias("n"), F.avg("length").alias("average"), F.sum("length").alias("tokens")).first()
    total, average = stats["n"], float(stats["average"] or 1.0)
    folders = max(1, -(-(stats["tokens"] or 0) // folder_tokens))
    meta = [F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c) for c, kind in META.items()]
    roots, root_meta = _posted(docs.select(*meta, F.col("roots").alias("tokens")), _root_rows(average), ROOT_ENTRY | {"top": "double"}, folders, block, "index-roots")
    terms = written(roots.groupBy("key").agg(F.sum(F.size("slot")).alias("df")), "index-terms")
    words, word_meta = _posted(docs.select(*meta, quote_tokens(F.col("text")).alias("tokens")), _word_rows, WORD_ENTRY, folders, block, "index-words")
    return SearchIndex(docs, roots, words, terms, total, average, folders, block, root_meta, word_meta)


Rows = tuple[np.ndarray, list[str], dict[str, np.ndarray]]


def _root_rows(average: float) -> Callable[[np.ndarray, pa.DictionaryArray], Rows]:
    """Entries of some documents: number of the key of each, the keys, and its columns with ``doc``, the document's place."""
    def rows(doc: np.ndarray, tokens: pa.DictionaryArray) -> Rows:
        keys = tokens.dictionary.to_pylist()
        pairs, tf = np.unique(doc * max(len(keys), 1) + tokens.indices.to_numpy(), return_counts=True)
        doc_of, key = np.divmod(pairs, max(len(keys), 1))
        length = np.bincount(doc)[doc_of]
        return key, keys, {"doc": doc_of, "tf": tf, "length": length, "top": term_part(tf, length, average)}

    return rows


def _word_rows(doc: np.ndarray, tokens: pa.DictionaryArray) -> Rows:
    words, code = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
    pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
    numbers: dict[str, int] = {}
    stored = [(word, numbers.setdefault(key, len(numbers))) for word, token in enumerate(words) for key in token_keys(token)]
    word, key = np.array(stored, np.int64).reshape(-1, 2).T
    n = np.bincount(word, minlength=len(words))
    times = n[code]
    at = np.repeat(np.arange(len(doc)), times)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    first = (np.cumsum(n) - n)[code[at]]
    return key[first + nth], list(numbers), {"doc": doc[at], "pos": pos[at], "code": code[at], "known": tokens.dictionary}


def _posted(docs: DataFrame, rows_of: Callable[[np.ndarray, pa.DictionaryArray], Rows], entry: dict[str, str], folders: int, block: int,
            name: str) -> tuple[DataFrame, DataFrame]:
    """Postings of ``docs(META..., tokens)``, written in their folders and read back, and the rows of their blocks."""
    single = {"top"} & set(entry)
    columns = {c: kind if c in single else f"array<{kind}>" for c, kind in (entry | META).items()}
    schema = ", ".join(f"{c} {kind}" for c, kind in ({"key": "string", "block": "bigint"} | columns).items())
    spark = docs.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER * block):
                part = batch.slice(at, TOGETHER * block)
                lists = pc.fill_null(part.column("tokens"), [])
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                key, keys, columns = rows_of(doc, lists.flatten().dictionary_encode())
                if len(key):
                    yield _arrays(key, keys, columns, first, block, arrow)
                yield _meta_rows(part, first, block, arrow)
                first += -(-part.num_rows // block)

    posted = docs.mapInArrow(run, schema).withColumn(
        "folder", F.when(F.col("key") == META_KEY, META_FOLDER).otherwise(F.pmod(F.xxhash64("key"), F.lit(folders)).cast("int")))
    path = work_path(spark, name)
    posted.sortWithinPartitions("folder", "key", "block").write.partitionBy("folder").parquet(path)
    table = spark.read.schema(f"{schema}, folder int").parquet(path)  # an index of no documents has its columns too
    meta = table.filter(F.col("folder") == META_FOLDER).select("key", "block", "slot", *META)
    return table.filter(F.col("folder") != META_FOLDER).drop(*META), meta


def _meta_rows(part: pa.RecordBatch, first: int, size: int, arrow: pa.Schema) -> pa.RecordBatch:
    """A row for each block under ``META_KEY`` with the slots and filter columns of all its documents."""
    starts = np.arange(0, part.num_rows, size)
    offsets = pa.array(np.append(starts, part.num_rows), pa.int32())
    made = {"key": pa.array([META_KEY] * len(starts)), "block": pa.array(first + np.arange(len(starts)))}
    made["slot"] = pa.ListArray.from_arrays(offsets, pa.array(np.arange(part.num_rows) % size, pa.int32()))
    for name in META:
        # Taken, since the values of a cut of a batch may start before the cut.
        values = part.column(name).take(pa.array(np.arange(part.num_rows)))
        made[name] = pa.ListArray.from_arrays(offsets, values.cast(arrow.field(name).type.value_type))
    if "top" in arrow.names:
        made["top"] = pa.array(np.zeros(len(starts)))
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(len(starts), f.type) for f in arrow], schema=arrow)


def _arrays(key: np.ndarray, keys: list[str], columns: dict, first: int, size: int, arrow: pa.Schema) -> pa.RecordBatch:
    """A row for each key and block with arrays in the order of slots."""
    doc = columns["doc"]
    block = doc // size
    order = np.lexsort((doc, key, block))
    key, block, doc = key[order], block[order], doc[order]
    starts = np.flatnonzero(np.diff(block * len(keys) + key, prepend=-1))
    offsets = pa.array(np.append(starts, len(key)), pa.int32())
    made = {"key": pa.array(keys).take(pa.array(key[starts])), "block": pa.array(block[starts] + first)}
    if "top" in columns:
        made["top"] = pa.array(np.maximum.reduceat(columns["top"][order], starts))
    values = {"slot": doc % size} | {name: columns[name][order] for name in ("tf", "length", "pos") if name in columns}
    if "known" in columns:
        row = np.repeat(np.arange(len(starts)), np.diff(offsets.to_numpy()))
        words = max(len(columns["known"]), 1)
        held, place = np.unique(row * words + columns["code"][order], return_inverse=True)
        begins = np.searchsorted(held // words, np.arange(len(starts) + 1))
        values["code"] = place - begins[row]
        made["known"] = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), columns["known"].take(pa.array(held % words)))
    for name, own in values.items():
        made[name] = pa.ListArray.from_arrays(offsets, pa.array(own, arrow.field(name).type.value_type))
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(len(starts), f.type) for f in arrow], schema=arrow)


def by_block(table: DataFrame, keys: list[str], folders: int, meta: DataFrame | None = None) -> DataFrame:
    """Rows of ``table`` under the keys, which a batch of queries bounds, and of ``meta``, all rows of a block in one task and in a row."""
    wanted = table.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    opened = table
    if folders > 1:  # at most one value for each folder
        folder = F.pmod(F.xxhash64("key"), F.lit(folders)).cast("int")
        opened = table.filter(F.col("folder").isin([r["f"] for r in wanted.select(folder.alias("f")).distinct().collect()]))
    found = opened.drop("folder").join(F.broadcast(wanted), "key")
    found = found if meta is None else found.unionByName(meta, allowMissingColumns=True)
    return found.repartition(_tasks(table), "block").sortWithinPartitions("block")


def _tasks(df: DataFrame) -> int:
    """Tasks of a shuffle whose work is more than its bytes say, so that they are not merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], entry: Iterable[str]) -> Iterator[tuple[list[str], list[float], list[dict[str, np.ndarray]]]]:
    """Keys, largest parts (if there are) and entries of the rows of each block."""
    current, keys, tops, entries = None, [], [], []
    for batch in batches:
        columns = {name: (batch.column(name).offsets.to_numpy(), batch.column(name).values.to_numpy(zero_copy_only=False)) for name in entry}
        names = batch.column("key").to_pylist()
        top = batch.column("top").to_pylist() if "top" in batch.schema.names else [0.0] * len(names)
        for row, block in enumerate(batch.column("block").to_pylist()):
            if block != current:
                if keys:
                    yield keys, tops, entries
                current, keys, tops, entries = block, [], [], []
            keys.append(names[row])
            tops.append(top[row])
            entries.append({name: column[ends[row]:ends[row + 1]] for name, (ends, column) in columns.items()})
    if keys:
        yield keys, tops, entries


def blocks_with_meta(batches: Iterator[pa.RecordBatch], entry: Iterable[str]):
    """As ``blocks``, with the filter columns of the block's documents by slot; blocks without a key that is searched are left out."""
    for keys, tops, entries in blocks(batches, (*entry, *META)):
        at = keys.index(META_KEY)
        meta = entries.pop(at)
        del keys[at], tops[at]
        if keys:
            yield keys, tops, entries, {name: meta[name] for name in META}


class Asked(NamedTuple):
    """Queries of a batch as arrays; -1 stands for a filter that is not set."""

    ids: np.ndarray
    short: np.ndarray
    four_k: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    video: np.ndarray

    def passes(self, query: int, entry: dict[str, np.ndarray]) -> np.ndarray:
        date = entry["recorded_date"]
        allowed = (date >= self.lo[query]) & (date <= self.hi[query])
        for wanted, column in ((self.short, "is_short"), (self.four_k, "is_4k"), (self.video, "video_id")):
            if wanted[query] >= 0:
                allowed &= entry[column].astype(np.int64) == wanted[query]
        return allowed


def asked(rows: list) -> Asked:
    """From collected rows of a batch of parsed queries."""
    column = lambda name: np.array([-1 if r[name] is None else int(r[name]) for r in rows], dtype=np.int64)
    return Asked(*(column(c) for c in ("query_id", "q_short", "q_4k", "date_lo", "date_hi", "v_id")))
