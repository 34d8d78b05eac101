"""Table schemas, declared once as DDL."""

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

FOLDERS = "id STRING, name STRING, parent_id STRING"

VIDEOS = """
    id BIGINT, source_file_id STRING, parent_folder_id STRING, md5_checksum STRING, title STRING,
    recorded_date STRING, is_short BOOLEAN, is_4k BOOLEAN, source_url STRING, mime_type STRING,
    size_bytes BIGINT, duration_sec DOUBLE, status STRING, is_missing BOOLEAN, is_excluded BOOLEAN,
    is_silent BOOLEAN, original_id BIGINT
"""

UTTERANCES = "video_id BIGINT, pos INT, start DOUBLE, end DOUBLE, text STRING, confidence DOUBLE"

WORDS = "video_id BIGINT, pos INT, word STRING, start DOUBLE, end DOUBLE"

CHUNKS = """
    id BIGINT, video_id BIGINT, chunk_index INT, start_sec DOUBLE, end_sec DOUBLE, text STRING,
    logical_id STRING, content_hash STRING, chunking_version STRING, generation_id BIGINT
"""

VECTORS = "chunk_id BIGINT, embedding ARRAY<FLOAT>"

QUERIES = """
    query_id BIGINT, text STRING, mode STRING, video_type STRING, date_from STRING, date_to STRING,
    embedding ARRAY<FLOAT>
"""

TASKS = """
    id BIGINT, video_id BIGINT, task_type STRING, payload STRING, status STRING, priority INT,
    retries INT, max_retries INT, error_message STRING, next_attempt_at TIMESTAMP,
    created_at TIMESTAMP, updated_at TIMESTAMP, generation_id BIGINT
"""

OUTBOX = """
    event_key STRING, event_type STRING, video_id BIGINT, chunk_id BIGINT, generation_id BIGINT,
    status STRING, ts TIMESTAMP
"""

FLAGS = "id BIGINT, chunk_id BIGINT, status STRING, locked_by STRING, locked_at TIMESTAMP, created_at TIMESTAMP"

HISTORY = "id BIGINT, user_id STRING, query STRING, created_at TIMESTAMP"

LISTING = """
    id STRING, name STRING, mime_type STRING, md5_checksum STRING, parent_id STRING,
    is_folder BOOLEAN, pos BIGINT
"""

ISSUES = "severity STRING, category STRING, message STRING, context MAP<STRING,STRING>"

GENERATIONS = """
    id BIGINT, name STRING, status STRING, path STRING, config_hash STRING, expected_chunks BIGINT,
    indexed_chunks BIGINT, activated_at TIMESTAMP
"""

_WORD = "STRUCT<word: STRING, punctuated_word: STRING, start: DOUBLE, end: DOUBLE, confidence: DOUBLE>"
_SENTENCE = "STRUCT<text: STRING, start: DOUBLE, end: DOUBLE>"
_UTTERANCE = (
    "STRUCT<start: DOUBLE, end: DOUBLE, transcript: STRING, text: STRING, confidence: DOUBLE, "
    f"words: ARRAY<{_WORD}>>"
)
_ALTERNATIVE = (
    f"STRUCT<transcript: STRING, confidence: DOUBLE, words: ARRAY<{_WORD}>, "
    f"paragraphs: STRUCT<transcript: STRING, paragraphs: ARRAY<STRUCT<sentences: ARRAY<{_SENTENCE}>>>>>"
)

#: Speech-to-text response, one document per file.
RAW_TRANSCRIPT = (
    "metadata STRUCT<duration: DOUBLE>, "
    f"results STRUCT<channels: ARRAY<STRUCT<alternatives: ARRAY<{_ALTERNATIVE}>>>, "
    f"utterances: ARRAY<{_UTTERANCE}>>"
)

_NORMALISED = "STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, confidence: DOUBLE>"

#: Normalised transcript; older files carry ``chunks`` in place of ``utterances``.
NORM_TRANSCRIPT = (
    "transcript STRING, confidence DOUBLE, duration DOUBLE, "
    f"utterances ARRAY<{_NORMALISED}>, chunks ARRAY<{_NORMALISED}>"
)
