"""Stable identities, hashes and small numeric conversions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, functions as F

from vocarium.functions.text import strip

#: Error texts that make a retry pointless.
PERMANENT_MARKERS = ("401", "403", "forbidden", "unauthorized", "invalid api key", "доступ запрещен")

SHORT_MAX_SEC = 1800
RETRY_BASE_SEC, RETRY_MAX_SEC, DEFAULT_MAX_RETRIES = 15, 900, 3


def logical_id(source_file_id: Column, chunk_index: Column) -> Column:
    """Identity of a chunk that outlives row replacement."""
    return F.sha2(F.concat_ws(":", source_file_id, chunk_index.cast("string")), 256)


def content_hash(text: Column, start_sec: Column, end_sec: Column) -> Column:
    """Digest of everything searchable in a chunk, as compact JSON with sorted keys."""
    body = F.struct(end_sec.cast("double").alias("end_sec"), start_sec.cast("double").alias("start_sec"),
                    strip(text).alias("text"))
    return F.sha2(F.to_json(body), 256)


def stable_numeric_id(value: Column) -> Column:
    """A whole number as it is, any other text by the first 15 hex digits of its MD5."""
    hashed = F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")
    return F.coalesce(value.try_cast("bigint"), hashed)


def path_layout(file_id: Column, kind: str) -> Column:
    """Relative path of a transcript: kind, two-character prefix, file."""
    return F.concat_ws("/", F.lit("transcripts"), F.lit(kind), F.substring(file_id, 1, 2),
                       F.concat(file_id, F.lit(".json.gz")))


def config_hash(settings: dict) -> str:
    """Digest of settings; a constant of the job, computed where the job is written."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def generation_name(chunking: dict, embedding: dict) -> str:
    identity = f"{config_hash(chunking)}:{config_hash(embedding)}"
    return "index-" + hashlib.sha256(identity.encode()).hexdigest()[:16]


def date_to_int(date: Column) -> Column:
    """ISO text to yyyymmdd; absent or unreadable dates are 0."""
    digits = F.regexp_replace(F.substring(strip(date), 1, 10), "-", "")
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def int_to_date(number: Column) -> Column:
    """yyyymmdd to ISO text; 0 or anything not eight digits long is null."""
    text = number.cast("string")
    return F.when((number != 0) & (F.length(text) == 8), F.concat_ws(
        "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))


def is_short(duration_sec: Column) -> Column:
    return F.coalesce((duration_sec > 0) & (duration_sec <= SHORT_MAX_SEC), F.lit(False))


def half_second(start_sec: Column) -> Column:
    """Half-second bucket, rounding ties to even."""
    return F.bround(start_sec * 2) / 2


def permanent_error(message: Column) -> Column:
    markers = F.array(*[F.lit(m) for m in PERMANENT_MARKERS])
    return F.coalesce(F.exists(markers, lambda m: F.lower(message).contains(m)), F.lit(False))


def retry_plan(retries: Column, max_retries: Column, message: Column) -> Column:
    """Next state of a failed task: status, kind of failure, retries and delay in seconds."""
    tried = F.coalesce(retries, F.lit(0)) + 1
    allowed = F.when(F.coalesce(max_retries, F.lit(0)) == 0, DEFAULT_MAX_RETRIES).otherwise(max_retries)
    permanent = permanent_error(message)
    again = ~permanent & (tried < allowed)
    delay = F.least(F.lit(RETRY_BASE_SEC) * F.pow(F.lit(2.0), tried - 1), F.lit(float(RETRY_MAX_SEC)))
    return F.struct(
        F.when(again, "pending").otherwise("failed").alias("status"),
        F.when(permanent, "permanent").when(again, "transient").otherwise("retry_exhausted").alias("failure_kind"),
        tried.cast("int").alias("retries"),
        F.when(again, delay.cast("int")).alias("delay_sec"),
    )


def is_json_object(payload: Column) -> Column:
    """True when the text parses as JSON and its top level is an object."""
    parsed = F.try_parse_json(payload)
    return F.coalesce(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def parse_vector(text: Column) -> Column:
    """``"[1,2]"`` to an array of doubles; any bad member makes it empty."""
    body = F.btrim(text, F.lit("[]"))
    parts = F.filter(F.split(body, ","), lambda p: strip(p) != "")
    numbers = F.transform(parts, lambda p: strip(p).try_cast("double"))
    empty = F.array().cast("array<double>")
    return F.when(text.isNull() | F.exists(numbers, lambda n: n.isNull()), empty).otherwise(numbers)


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
