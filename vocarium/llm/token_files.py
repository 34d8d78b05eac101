"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, one per document, followed by a skippable frame
that names the documents and by the trailing seek table of the public seekable format: compressed
size, plain size and checksum (low 32 bits of XXH64) of every frame. A reader takes the table from
the end and decompresses only the frames it wants.

Files are written by Spark's own committer, so a lost executor or a second attempt leaves no half
file, and any store that Spark can write to will do. A task makes the bytes of one file at a time.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from vocarium.llm.rows import KEPT, byte_alphabet, map_rows, texts
from vocarium.session import work_path

# Fixed values of the zstandard seekable format.
TABLE_MAGIC = 0x184D2A5E
NAMES_MAGIC = 0x184D2A50
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Id appended to each document.
END_ID = 0
#: Ids after which a file is closed; a single document is never cut.
FILE_IDS = 2_000_000
#: Distinct pieces a worker remembers before it starts afresh.
REMEMBERED = 700_000

_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_NAME = np.dtype([("doc_id", "<i8"), ("null", "u1")])


# --- encoding -----------------------------------------------------------------------------------

#: Pieces with a letter or plain sign at both ends, after a space or not, and no line break.
_PLAIN = re.compile(rb" ?(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])(?:[^\n]*(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))?")

#: Pieces of letters alone, which the pre-tokenizer leaves whole.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in '.,;:!?|#$%&*()[]{}<>"/+=@~^_-']] = True


def cuts(a: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer cuts a text as well: one mark before each byte and one at the end.

    Cuts are made only before a space that a letter or plain sign follows, between a letter and a plain sign, and
    around a single line break between visible characters. Everything else stays in one piece, so
    encoding the pieces one by one gives the ids of the whole text.
    """
    cut = np.zeros(len(a) + 1, bool)
    cut[0] = cut[-1] = True
    if len(a) < 4:
        return cut
    latin = (a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] != 0x97) & (a[1:] != 0xB7)
    letter = _LETTER[a]
    begins = letter.copy()
    letter[1:] |= latin
    begins[:-1] |= latin
    sign = _SIGN[a]
    cut[:-2] |= (a[:-1] == 32) & (begins | sign)[1:]
    cut[1:-1] |= letter[:-1] & sign[1:]
    line = (a[1:-1] == 10) & (letter[:-2] | sign[:-2]) & begins[2:]
    cut[1:-2] |= line
    cut[2:-1] |= line
    return cut


def pieces(text: bytes) -> list[bytes]:
    """The pieces of a text between its ``cuts``."""
    if not text:
        return []
    at = np.flatnonzero(cuts(np.frombuffer(text, np.uint8))).tolist()
    return [text[i:j] for i, j in zip(at, at[1:])]


#: Bytes of a piece that is known by a number; and the masks that leave so many bytes of eight.
SHORT = 8
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], np.uint64)


def short_key(piece: bytes) -> int | bytes:
    """The piece as a number, if it is short and holds no zero byte, otherwise the piece itself."""
    return int.from_bytes(piece, "little") if len(piece) <= SHORT and 0 not in piece else piece


class Encoder:
    """Ids of texts through a tokenizer file, remembering the ids of pieces seen before."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.path, self.remembered = path, remembered
        self.line = self._ids("\n")
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.words = self._of_words()
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _of_words(self):
        """The tokenizer without its search for words, for words in its own alphabet; None where it does more than that."""
        from tokenizers import Tokenizer, pre_tokenizers

        parts = json.loads(self.tokenizer.to_str())
        before, model = parts["pre_tokenizer"] or {}, parts["model"]
        if (parts["normalizer"] is not None or before.get("type") != "ByteLevel" or not before.get("use_regex", True)
                or before.get("add_prefix_space") or model.get("type") != "BPE" or not all(t["special"] for t in parts["added_tokens"])):
            return None
        words = Tokenizer.from_file(self.path)
        words.encode_special_tokens = True
        words.pre_tokenizer = pre_tokenizers.Split(self.alphabet[10], "isolated")
        return words

    def forget(self) -> None:
        self.known: dict[int | bytes, int] = {}
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces in one call, parted by line breaks, which are a token of their own; words without the search for words."""
        words = list(filter(_WORD.fullmatch, new)) if self.words else []
        rest = list(set(new).difference(words)) if words else new
        simple = list(filter(_PLAIN.fullmatch, rest))
        odd = list(set(rest).difference(simple)) if len(simple) < len(rest) else []
        parts = []
        if words:
            parts.append((words, self._joined(self.words, b"\n".join(words).decode("latin-1").translate(self.alphabet), len(words))))
        if simple:
            parts.append((simple, self._joined(self.tokenizer, b"\n".join(simple).decode(), len(simple))))
        for group, found in parts:
            if found is None:  # a tokenizer with another line break: one by one
                odd = [*odd, *group]
            else:
                self._add(group, *found)
        if odd:
            alone = [np.array(self._ids(piece.decode()), np.uint32) for piece in odd]
            self._add(odd, np.concatenate(alone), np.cumsum(np.fromiter(map(len, alone), np.int64, len(alone))))

    def _joined(self, tokenizer, text: str, many: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces parted by line breaks, and where each ends; None where the breaks do not part them."""
        got = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        breaks = got == self.line[0]
        ends = np.append(np.flatnonzero(breaks) - np.arange(breaks.sum()), len(got) - breaks.sum())
        return (got[~breaks], ends) if len(ends) == many else None

    def _add(self, group: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        base = len(self.known)
        self.known.update(zip(map(short_key, group), range(base, base + len(group))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + ends])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, documents: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each document, as unsigned 32-bit integers.

        The documents are cut as one text, parted by zero bytes, which no cut depends on. Short pieces
        are numbers and looked up once for each distinct one.
        """
        if len(self.known) > self.remembered:
            self.forget()
        joined = b"\0".join(documents) + bytes(SHORT)
        whole = np.frombuffer(joined, np.uint8)[:-SHORT]
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        last = np.cumsum(sizes + 1) - 1
        cut = cuts(whole)
        cut[last] = cut[last - sizes] = True
        at = np.flatnonzero(cut)
        own = np.ones(len(at) - 1, bool)
        own[np.searchsorted(at, last[:-1])] = False  # the zero bytes between documents
        begin, length = at[:-1][own], np.diff(at)[own]
        short = length <= SHORT
        if np.count_nonzero(whole == 0) >= len(documents):  # zero bytes inside a text
            zeros = np.append(0, np.cumsum(whole == 0))
            short &= zeros[begin + length] == zeros[begin]
        eight = np.ndarray((len(joined) - SHORT + 1,), "<u8", buffer=joined, strides=(1,))
        keys, place = np.unique(eight[begin[short]] & _MASKS[length[short]], return_inverse=True)
        listed = keys.tolist()
        long = [joined[i:i + n] for i, n in zip(begin[~short].tolist(), length[~short].tolist())]
        new = [k.to_bytes(SHORT, "little").rstrip(b"\0") for k in listed if k not in self.known]
        new.extend(set(long).difference(self.known))
        if new:
            self._learn(new)
        get = self.known.__getitem__
        codes = np.empty(len(begin), np.int64)
        codes[short] = np.fromiter(map(get, listed), np.int64, len(listed))[place]
        codes[~short] = np.fromiter(map(get, long), np.int64, len(long))
        first = self.begin[codes]
        many = self.begin[codes + 1] - first
        ends = np.append(0, np.cumsum(many))
        ids = self.pool[np.arange(ends[-1]) + np.repeat(first - ends[:-1], many)]
        # Ids before the first piece of each document, and before the end of the last one.
        edges = ends[np.append(np.searchsorted(begin, last - sizes), len(begin))]
        return [ids[i:j] for i, j in zip(edges, edges[1:])]


def encoder(path: str) -> Encoder:
    """The worker's encoder; tasks that follow each other in a worker share what it remembers."""
    known = KEPT.get(__name__)
    if not isinstance(known, Encoder) or known.path != path:
        known = KEPT[__name__] = Encoder(path)
    return known


# --- file format --------------------------------------------------------------------------------


def pack(frames: Sequence[tuple[int | None, bytes, int, int]]) -> bytes:
    """Bytes of a file from ``(doc_id, compressed frame, plain size, checksum)``."""
    names = np.array([(0 if d is None else d, d is None) for d, *_ in frames], _NAME).tobytes()
    named = struct.pack("<II", NAMES_MAGIC, len(names)) + names
    entries = np.array([*((len(f), n, c) for _, f, n, c in frames), (len(named), 0, 0)], _ENTRY)
    table = struct.pack("<II", TABLE_MAGIC, entries.nbytes + 9) + entries.tobytes()
    footer = struct.pack("<IBI", len(entries), CHECKSUM_FLAG, FOOTER_MAGIC)
    return b"".join([*(f for _, f, _, _ in frames), named, table, footer])


def frame(ids: np.ndarray, packer: zstandard.ZstdCompressor) -> tuple[bytes, int, int]:
    plain = ids.astype("<u4").tobytes()
    return packer.compress(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class Reader:
    """Random access to one file through ``read(offset, length)`` and its size."""

    def __init__(self, read, size: int):
        self.read = read
        count, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        at = size - 9 - count * _ENTRY.itemsize
        if struct.unpack("<II", read(at - 8, 8)) != (TABLE_MAGIC, count * _ENTRY.itemsize + 9):
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(read(at, size - 9 - at), _ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        self.plain = self.entries["plain"][:-1].astype(np.int64)

    @classmethod
    def of_bytes(cls, content: bytes) -> Reader:
        view = memoryview(content)
        return cls(lambda at, n: bytes(view[at:at + n]), len(content))

    @classmethod
    def of_file(cls, file) -> Reader:
        """For any seekable file object, local or remote."""
        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        return cls(read, file.seek(0, os.SEEK_END))

    def documents(self) -> list[int | None]:
        at, end = int(self.offsets[-2]), int(self.offsets[-1])
        names = np.frombuffer(self.read(at + 8, end - at - 8), _NAME)
        return [None if n else int(d) for d, n in names.tolist()]

    def plain_bytes(self, k: int) -> bytes:
        """Bytes of frame ``k``; only this frame is read and decompressed, and its checksum tested."""
        entry = self.entries[k]
        data = zstandard.ZstdDecompressor().decompress(
            self.read(int(self.offsets[k]), int(entry["packed"])), max_output_size=int(entry["plain"]))
        if len(data) != entry["plain"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {k} fails its checksum")
        return data


# --- Spark --------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID,
                      file_ids: int = FILE_IDS, level: int = 3) -> None:
    """Encode ``docs(doc_id, text)`` and write the files below ``path`` in ascending ``doc_id`` order.

    Documents are dealt by ranges of ``doc_id`` (then of the text's hash, so that one id with many
    rows is split too) and sorted within. Null ids come first, rows with equal ids in the order of
    the text's hash and then of the text; a null text is empty and has only the end id. An empty
    table gives no frames. Columns besides the two are ignored.
    """
    order = ["doc_id", "_tie", "text"]
    dealt = (
        texts(docs).withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie").sortWithinPartitions(*order).select("doc_id", "text"))

    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        held: list[tuple] = []
        count = 0
        for key, ids, packer in _encoded(rows, tokenizer, end_id, level):
            held.append((key, *frame(ids, packer)))
            count += len(ids)
            if count >= file_ids:
                yield (pack(held)[:-4],)
                held, count = [], 0
        if held:
            yield (pack(held)[:-4],)

    # The text writer puts the bytes of a row as they are and ends it with the separator, which
    # here is the format's last four bytes; with one row a file, that is the file.
    files = map_rows(dealt, work, "content binary", rows=1)
    (files.select(F.col("content").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", struct.pack("<I", FOOTER_MAGIC).decode("latin-1")).text(path))


def _encoded(rows: Iterator[tuple], tokenizer: str, end_id: int, level: int) -> Iterator[tuple]:
    """``(key, ids with the end id, compressor)``, a megabyte of text at a time."""
    encode, packer = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=level)
    keys: list = []
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple]:
        for key, ids in zip(keys, encode(held)):
            yield key, np.append(ids, np.uint32(end_id)), packer

    for key, text in rows:
        keys.append(key)
        held.append(text)
        size += len(text)
        if size >= 1_000_000:
            yield from flush()
            keys, held, size = [], [], 0
    yield from flush()


def _files(docs_path: str, spark) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile").load(docs_path).filter("length > 9")
        .select(F.regexp_extract(name, r"^part-(\d+)-", 1).cast("bigint").alias("part"),
                F.coalesce(F.regexp_extract(name, r"-c(\d+)\.[^-]*$", 1).cast("bigint"), F.lit(0)).alias("piece"), "content"))


def read_token_files(spark, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of the files below ``path``.

    ``start`` counts the ids of all documents before. With ``doc_ids``, a table of wanted ids, only
    the frames of those documents are decompressed. Unused columns cost nothing but the plan.
    """
    files = _files(path, spark)

    def tables(rows: Iterator[tuple]) -> Iterable[tuple]:
        for part, piece, content in rows:
            reader = Reader.of_bytes(content)
            before = 0
            for seq, (key, size) in enumerate(zip(reader.documents(), (reader.plain // 4).tolist())):
                yield part, piece, seq, key, before, size
                before += size

    def totals(rows: Iterator[tuple]) -> Iterable[tuple]:
        for part, piece, content in rows:
            yield part, piece, int(Reader.of_bytes(content).plain.sum()) // 4

    # One row per file; offsets within a task's files, then over the tasks.
    sizes = map_rows(files, totals, "part long, piece long, total long")
    within = F.sum("total").over(Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    tasks = sizes.groupBy("part").agg(F.sum("total").alias("total"))
    earlier = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        sizes.withColumn("_within", F.coalesce(within, F.lit(0)))
        .join(tasks.select("part", F.coalesce(earlier, F.lit(0)).alias("_earlier")), "part")
        .select("part", "piece", (F.col("_within") + F.col("_earlier")).alias("_offset")))

    if doc_ids is not None:
        wanted = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        index = map_rows(files, tables, "part long, piece long, seq long, doc_id long, before long, size long")
        picks = (
            index.join(wanted, index["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
            .groupBy("part", "piece").agg(F.sort_array(F.collect_list("seq")).alias("picks")))
        files = files.join(picks, ["part", "piece"]).select("part", "piece", "content", "picks")

    def frames(rows: Iterator[tuple]) -> Iterable[tuple]:
        for part, piece, content, *picks in rows:
            reader = Reader.of_bytes(content)
            names, starts = reader.documents(), np.cumsum(reader.plain // 4) - reader.plain // 4
            for k in picks[0] if picks else range(len(names)):
                data = reader.plain_bytes(k)
                yield part, piece, names[k], int(starts[k]), len(data) // 4, zlib.crc32(data), data

    schema = "part long, piece long, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary"
    return (
        map_rows(files, frames, schema, rows=256).join(offsets, ["part", "piece"])
        .select("doc_id", (F.col("_offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids"))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` and read the files back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    path = path or work_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path)
    return read_token_files(docs.sparkSession, path).drop("ids")
