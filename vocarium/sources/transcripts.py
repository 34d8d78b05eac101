"""Transcript documents: gzip JSON files, their normal form, and their rows."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vocarium.functions import identity, text as tx
from vocarium.schemas import FILES, NORM_TRANSCRIPT, RAW_TRANSCRIPT

_CORRUPT = "_corrupt_record"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of each file, null where it is damaged: a cut gzip stream, or bytes that are no text."""
    for batch in batches:
        texts: list[str | None] = []
        for content, packed in zip(batch.column("content").to_pylist(), batch.column("packed").to_pylist()):
            try:
                texts.append((gzip.decompress(content) if packed else content).decode())
            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                texts.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(texts, pa.string())], names=["file_id", "value"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gzip file of each text."""
    for batch in batches:
        contents = [gzip.compress(text.encode(), 6, mtime=0) for text in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary())], names=["path", "content"])


def _files(spark: SparkSession, folder: str, packed: bool, pattern: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of single files, or of those ``pack_documents`` has put together."""
    if packed:
        return spark.read.schema(FILES).parquet(folder)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def _read(files: DataFrame, schema: str) -> DataFrame:
    """One document per file; a damaged or empty one gives a row with ``corrupt`` set, not an error."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(F.regexp_extract(name, r"^(.*)\.json(\.gz)?$", 1).alias("file_id"), name.endswith(".gz").alias("packed"), "content")
    document = F.from_json("value", f"{schema}, {_CORRUPT} STRING", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    whole = F.col("d").isNotNull() & F.col(f"d.{_CORRUPT}").isNull()
    return named.mapInArrow(_unpacked, "file_id STRING, value STRING").select("file_id", document.alias("d")).select(
        "file_id", "d.*", (~whole).alias("corrupt")).drop(_CORRUPT)


def scan_raw(spark: SparkSession, folder: str, packed: bool = False) -> DataFrame:
    return _read(_files(spark, folder, packed, "*.json*"), RAW_TRANSCRIPT)


def scan_normalised(spark: SparkSession, folder: str, packed: bool = False) -> DataFrame:
    """Normalised transcripts with ``utterances``, or ``chunks`` of older files in their place."""
    items = F.when(F.size("utterances") > 0, F.col("utterances")).when(
        F.size("chunks") > 0, F.col("chunks")).otherwise(F.slice(F.coalesce("utterances", "chunks"), 1, 0))
    return _read(_files(spark, folder, packed, "*.json*"), NORM_TRANSCRIPT).withColumn("utterances", items).drop("chunks")


def scan_files(spark: SparkSession, folder: str, packed: bool = False) -> DataFrame:
    """Files below a folder with path and size; contents are not read."""
    return _files(spark, folder, packed, "*.json.gz").select("path", "length", "modificationTime")


def pack_documents(documents: DataFrame, folder: str) -> None:
    """A gzip JSON file for each document, many of them in one table with the columns of a file listing.

    Files of their own cost the committer a rename and the driver a listing entry and a split for each document.
    Here both follow the tasks, a damaged file still harms no other, and a listing reads no contents.
    """
    path = F.concat(F.substring("file_id", 1, 2), F.lit("/"), "file_id", F.lit(".json.gz"))
    rows = documents.select(path.alias("path"), F.to_json(F.struct(*[c for c in documents.columns if c != "file_id"])).alias("value"))
    rows.mapInArrow(_packed, "path STRING, content BINARY").select(
        "path", F.current_timestamp().alias("modificationTime"), F.length("content").cast("bigint").alias("length"), "content",
    ).write.parquet(folder)


def write_documents(documents: DataFrame, folder: str) -> None:
    """Compact gzip JSON below two-character prefix folders; the commit is all or nothing."""
    prefixed = documents.withColumn("prefix", F.substring("file_id", 1, 2))
    prefixed.write.partitionBy("prefix").option("compression", "gzip").mode("overwrite").json(folder)


def normalise_terms(documents: DataFrame, rules: Sequence[tuple[str, str]] = tx.DOMAIN_TERMS) -> DataFrame:
    """Apply the term rules to every text of a raw response."""
    fix = lambda text: tx.normalise_terms(text, rules)

    def fix_word(word: Column) -> Column:
        return word.withField("word", fix(word["word"])).withField("punctuated_word", fix(word["punctuated_word"]))

    def fix_paragraph(paragraph: Column) -> Column:
        return paragraph.withField("sentences", F.transform(
            paragraph["sentences"], lambda s: s.withField("text", fix(s["text"]))))

    def fix_alternative(alt: Column) -> Column:
        paragraphs = alt["paragraphs"]
        fixed = paragraphs.withField("transcript", fix(paragraphs["transcript"])).withField(
            "paragraphs", F.transform(paragraphs["paragraphs"], fix_paragraph))
        return alt.withField("transcript", fix(alt["transcript"])).withField(
            "words", F.transform(alt["words"], fix_word)).withField("paragraphs", F.when(paragraphs.isNotNull(), fixed))

    def fix_utterance(item: Column) -> Column:
        return item.withField("transcript", fix(item["transcript"])).withField(
            "words", F.transform(item["words"], fix_word))

    results = F.col("results")
    channels = F.transform(results["channels"], lambda c: c.withField(
        "alternatives", F.transform(c["alternatives"], fix_alternative)))
    return documents.withColumn("results", results.withField("channels", channels).withField(
        "utterances", F.transform(results["utterances"], fix_utterance)))


def normalise(documents: DataFrame) -> DataFrame:
    """Raw responses to ``(file_id, transcript, confidence, utterances, duration)``.

    Without utterances the sentences of the paragraphs stand in. A missing start takes the end
    of the utterance before it, a missing end its own start plus a tenth of a second.
    """
    alternative = F.get(F.get("results.channels", F.lit(0))["alternatives"], F.lit(0))
    has_channel = F.coalesce(F.size("results.channels"), F.lit(0)) > 0
    item = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, confidence: DOUBLE>>"
    spoken = F.transform("results.utterances", lambda u: F.struct(
        u["start"].alias("start"), u["end"].alias("end"),
        F.coalesce(F.nullif(u["transcript"], F.lit("")), u["text"], F.lit("")).alias("text"),
        F.coalesce(u["confidence"], F.lit(1.0)).alias("confidence")))
    sentences = F.transform(
        F.flatten(F.transform(alternative["paragraphs"]["paragraphs"], lambda p: F.coalesce(
            p["sentences"], F.slice(p["sentences"], 1, 0)))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                           F.coalesce(s["text"], F.lit("")).alias("text"), F.lit(1.0).alias("confidence")))
    nothing = F.expr(f"CAST(array() AS {item})")
    source = F.when(~has_channel, nothing).when(F.size("results.utterances") > 0, spoken).otherwise(
        F.coalesce(sentences, nothing))
    return documents.withColumn("source", source).select(
        "file_id",
        F.when(has_channel, F.coalesce(alternative["transcript"], F.lit(""))).otherwise("").alias("transcript"),
        F.when(has_channel, F.coalesce(alternative["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"),
        fill_times(F.col("source")).alias("utterances"),
        F.coalesce("metadata.duration", F.lit(0.0)).alias("duration"))


def fill_times(items: Column) -> Column:
    """Fill missing starts and ends in order; a filled end feeds the next missing start."""
    empty = F.slice(items, 1, 0)

    def step(done: Column, item: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0.0))
        start = F.coalesce(item["start"], last)
        end = F.coalesce(item["end"], start + 0.1)
        filled = F.struct(start.alias("start"), end.alias("end"), item["text"].alias("text"),
                          item["confidence"].alias("confidence"))
        return F.concat(done, F.array(filled))

    complete = F.forall(items, lambda i: i["start"].isNotNull() & i["end"].isNotNull())
    return F.when(complete, items).otherwise(F.aggregate(items, empty, step))


def utterance_rows(normalised: DataFrame) -> DataFrame:
    """One row per utterance with its position."""
    return normalised.select("file_id", F.posexplode("utterances").alias("pos", "u")).select("file_id", "pos", "u.*")


def word_rows(documents: DataFrame) -> DataFrame:
    """Timed words of the first alternative; words without text or start are dropped."""
    words = F.get(F.get("results.channels", F.lit(0))["alternatives"], F.lit(0))["words"]
    text = tx.strip(F.coalesce(F.nullif(F.col("w.word"), F.lit("")), F.col("w.punctuated_word"), F.lit("")))
    return (
        documents.select("file_id", F.posexplode(words).alias("pos", "w"))
        .select("file_id", "pos", text.alias("word"), F.col("w.start").alias("start"),
                F.coalesce("w.end", "w.start").alias("end"))
        .filter("word <> '' AND start IS NOT NULL"))


def listing_rows(export: DataFrame) -> DataFrame:
    """Exported inventory documents to listing rows; the owner is who shared, else the first owner."""
    return export.select(
        "id", "name", F.col("mimeType").alias("mime_type"), F.col("md5Checksum").alias("md5_checksum"),
        F.get("parents", F.lit(0)).alias("parent_id"),
        (F.col("mimeType") == "application/vnd.google-apps.folder").alias("is_folder"),
        F.coalesce("sharingUser.displayName", F.get("owners", F.lit(0))["displayName"]).alias("owner"))


def file_paths(files: DataFrame, corrupt: DataFrame, kind: str) -> DataFrame:
    """Files found, by relative path, with whether they could be read."""
    found = files.select(F.regexp_extract("path", r"([^/]+)\.json\.gz$", 1).alias("file_id"))
    bad = corrupt.filter("corrupt").select("file_id", F.lit(True).alias("corrupt")).distinct()
    return found.join(bad, "file_id", "left").select(
        identity.path_layout(F.col("file_id"), kind).alias("path"), F.coalesce("corrupt", F.lit(False)).alias("corrupt"))
