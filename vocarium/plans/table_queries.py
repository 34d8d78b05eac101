"""Scans, filters, joins, aggregates, windows, sorts and set operations over the archive's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocarium.functions import identity, text as tx
from vocarium.operators import chunking, dedupe, filters, folders, indexing, people, quality, queue, ranking, sync
from vocarium.plans.registry import query
from vocarium.plans.views import DUCK, NOW, SPARK
from vocarium.session import work_path
from vocarium.sources import generations

VIDEO_COLUMNS = ("id, source_file_id, parent_folder_id, md5_checksum, title, recorded_date, is_short, is_4k, source_url, "
                 "size_bytes, duration_sec, status, is_missing, is_excluded, is_silent, original_id")

OPEN_REFS = """
SELECT id AS task_id, video_id AS vid, NULL AS fid FROM {tasks} WHERE status IN ('pending', 'running') AND video_id IS NOT NULL
UNION ALL SELECT id, TRY_CAST(CASE WHEN json_valid(payload) THEN payload ->> '$.video_id' END AS BIGINT), NULL FROM {tasks}
  WHERE status IN ('pending', 'running')
UNION ALL SELECT id, NULL, CASE WHEN json_valid(payload) THEN payload ->> '$.file_id' END FROM {tasks}
  WHERE status IN ('pending', 'running')
"""
DUCK["open_refs"] = OPEN_REFS
DUCK["open_work"] = """
SELECT DISTINCT v.id, r.task_id FROM {videos} v JOIN {open_refs} r ON r.vid = v.id
UNION SELECT DISTINCT v.id, r.task_id FROM {videos} v JOIN {open_refs} r ON r.fid = v.source_file_id
"""
DUCK["active_videos"] = "SELECT DISTINCT id FROM {open_work}"

DUCK["media"] = r"""
SELECT * FROM {listing} WHERE NOT is_folder AND (contains(mime_type, 'video/')
  OR regexp_matches(lower(name), '\.(mp4|mkv|mov|avi|webm|flv|3gp|mpeg|mpg|m4v)$'))
"""

DUCK["issue_videos"] = r"""
SELECT id, message, CAST(COALESCE(nullif(regexp_extract(message, '\(ID:(\d+)\)', 1), ''),
  nullif(regexp_extract(message, 'Video (\d+):', 1), ''), nullif(regexp_extract(message, '(?i)video ID (\d+):', 1), '')) AS BIGINT)
  AS video_id FROM {raw_issues}
"""


# -- scans and sinks -----------------------------------------------------------------------

@query("scan_tables", f"SELECT {VIDEO_COLUMNS} FROM {{videos}}")
def scan_tables(v):
    return v["videos"].drop("mime_type")


@query("index_full_scan", "SELECT id, video_id, chunk_index, text FROM {index_points}")
def index_full_scan(v):
    return v["index_points"]


@query("lookup_by_ids", "SELECT p.id, p.text FROM {index_points} p WHERE p.id IN (SELECT chunk_id FROM {flags})")
def lookup_by_ids(v):
    return filters.lookup_by_ids(v["index_points"], v["flags"].select(F.col("chunk_id").alias("id")), "id").select("id", "text")


@query("drive_listing_scan", "SELECT id, name, mime_type, md5_checksum, parent_id, is_folder FROM {listing}")
def drive_listing_scan(v):
    return v["listing"].drop("pos")


@query("upsert_points", """
SELECT i.id, i.video_id, i.chunk_index, i.text FROM {index_points} i WHERE i.id NOT IN (SELECT id FROM {chunks})
UNION ALL SELECT id, video_id, chunk_index, text FROM {chunks}""")
def upsert_points(v):
    changes = v["chunks"].select("id", "video_id", "chunk_index", "text", F.lit(1).alias("version"))
    older = changes.withColumns({"text": F.lit("older"), "version": F.lit(0)})
    return indexing.upsert_points(v["index_points"], changes.unionByName(older), "id", "version")


@query("delete_points", "SELECT id FROM {index_points} WHERE id NOT IN (SELECT chunk_id FROM {flags})")
def delete_points(v):
    return indexing.delete_points(v["index_points"], v["flags"].select(F.col("chunk_id").alias("id")), "id").select("id")


@query("export_transcript", "SELECT video_id, chunk_index, id, text FROM {chunks}")
def export_transcript(v):
    folder = work_path(v.spark, "export")
    indexing.export_transcripts(v["chunks"], folder)
    return v.spark.read.schema("video_id BIGINT, chunk_index BIGINT, id BIGINT, text STRING").json(folder)


@query("snapshot_manifest", """
SELECT 'videos' AS "table", count(*) AS "rows" FROM {videos} UNION ALL SELECT 'chunks', count(*) FROM {chunks}
UNION ALL SELECT 'tasks', count(*) FROM {tasks}""")
def snapshot_manifest(v):
    return generations.snapshot({n: v[n] for n in ("videos", "chunks", "tasks")}).select("table", "rows")


# -- filters and projections ---------------------------------------------------------------

@query("filter_media_files", "SELECT id, name FROM {media}")
def filter_media_files(v):
    return filters.media_files(v["listing"]).select("id", "name")


@query("exclude_keywords", "SELECT id, contains(upper(name), 'GALLERY') OR contains(upper(name), 'TALK 12') AS is_excluded FROM {media}")
def exclude_keywords(v):
    return filters.split_by_keywords(filters.media_files(v["listing"]), ["Gallery", "talk 12"]).select("id", "is_excluded")


@query("active_work_predicate", "SELECT id, task_id FROM {open_work}")
def active_work_predicate(v):
    return queue.open_work(v["videos"], v["tasks"])


@query("eligible_tasks", f"""SELECT id FROM {{tasks}} WHERE status = 'pending' AND task_type IN ('stage_1_download', 'stage_3_index')
AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}')""")
def eligible_tasks(v):
    return filters.eligible_tasks(v["tasks"], ["stage_1_download", "stage_3_index"], NOW).select("id")


@query("regexp_predicate", "SELECT id FROM {raw_issues} WHERE regexp_matches(message, '(?i)VIDEO ID [0-9]+|low wpm')")
def regexp_predicate(v):
    return v["raw_issues"].filter(tx.regexp_match(F.col("message"), "VIDEO ID [0-9]+|low wpm")).select("id")


@query("time_window_context", """
SELECT f.chunk_id AS target_id, t.video_id, string_agg(c.text, ' ' ORDER BY c.start_sec, c.id) AS context
FROM {flags} f JOIN {chunks} t ON t.id = f.chunk_id
JOIN {chunks} c ON c.video_id = t.video_id AND abs(c.start_sec - t.start_sec) <= 30 GROUP BY f.chunk_id, t.video_id""")
def time_window_context(v):
    targets = v["chunks"].join(v["flags"].select(F.col("chunk_id").alias("id")), "id", "left_semi").select(
        F.col("id").alias("target_id"), "video_id", F.col("start_sec").alias("target_sec"))
    return filters.time_window_context(v["chunks"], targets)


@query("timestamped_link", """
SELECT c.id, concat(v.source_url, CASE WHEN contains(v.source_url, '?') THEN '&' ELSE '?' END, 't=',
       CAST(floor(c.start_sec) AS BIGINT), 's') AS link
FROM {chunks} c JOIN {videos} v ON v.id = c.video_id WHERE v.source_url IS NOT NULL""")
def timestamped_link(v):
    joined = v["chunks"].join(v["videos"].select(F.col("id").alias("video_id"), "source_url"), "video_id")
    return joined.filter("source_url IS NOT NULL").select(
        "id", tx.timestamped_link(F.col("source_url"), F.col("start_sec")).alias("link"))


_LISTING = """SELECT id, name, TRUE AS is_folder, 'folder' AS mime_type, NULL AS is_short, NULL AS is_4k,
  NULL AS is_md5_duplicate, NULL AS is_silent, NULL AS chunk_count FROM {folders} WHERE %s
UNION ALL SELECT CAST(v.id AS VARCHAR), v.title, FALSE, v.mime_type, v.is_short, v.is_4k, v.original_id IS NOT NULL, v.is_silent,
  (SELECT count(*) FROM {chunks} c WHERE c.video_id = v.id) FROM {videos} v WHERE %s"""


@query("folder_listing", _LISTING % ("parent_id = 'n3'", "v.parent_folder_id = 'n3'"))
def folder_listing(v):
    return folders.folder_listing(v["folders"], v["videos"], v["chunks"], "n3")


@query("folder_listing_root", _LISTING % (
    "parent_id IS NULL OR parent_id NOT IN (SELECT id FROM {folders})",
    "v.parent_folder_id IS NULL OR v.parent_folder_id NOT IN (SELECT id FROM {folders})"))
def folder_listing_root(v):
    return folders.folder_listing(v["folders"], v["videos"], v["chunks"], None)


@query("root_items_not_in", """SELECT id FROM {videos} WHERE parent_folder_id IS NULL
OR parent_folder_id NOT IN (SELECT id FROM {folders})""")
def root_items_not_in(v):
    return folders.at_root(v["videos"], "parent_folder_id", v["folders"]).select("id")


DUCK["inventory"] = """
SELECT l.id, l.is_folder,
  CASE WHEN l.is_folder THEN l.id IN (SELECT id FROM {folders})
       ELSE l.id IN (SELECT source_file_id FROM {videos}) OR COALESCE(l.md5_checksum IN (SELECT md5_checksum FROM {videos}), FALSE) END AS is_indexed,
  l.id IN (SELECT fid FROM {open_refs} WHERE fid IS NOT NULL
           UNION ALL SELECT v.source_file_id FROM {videos} v JOIN (
             SELECT TRY_CAST(CASE WHEN json_valid(payload) THEN payload ->> '$.video_id' END AS BIGINT) AS vid
             FROM {tasks} WHERE status IN ('pending', 'running')) t ON t.vid = v.id) AS is_queued
FROM {listing} l
"""


def _inventory(v):
    return sync.inventory_status(v["listing"], v["videos"], v["folders"], v["tasks"])


@query("inventory_status", "SELECT * FROM {inventory}")
def inventory_status(v):
    return _inventory(v)


@query("folder_import_split", """SELECT id, CASE WHEN is_indexed OR is_queued THEN 'skip' ELSE 'ingest' END AS decision
FROM {inventory} WHERE NOT is_folder""")
def folder_import_split(v):
    return sync.import_split(_inventory(v))


@query("video_list", "SELECT id, title FROM {videos}")
def video_list(v):
    return v["videos"].select("id", "title").orderBy("title", "id")


@query("video_chunks", "SELECT id, video_id, chunk_index, text FROM {chunks}")
def video_chunks(v):
    return v["chunks"].select("id", "video_id", "chunk_index", "text").orderBy("video_id", "chunk_index", "id")


# -- joins ---------------------------------------------------------------------------------

@query("flag_hits", "SELECT c.id, c.id IN (SELECT chunk_id FROM {flags}) AS is_flagged FROM {chunks} c")
def flag_hits(v):
    flagged = v["flags"].select(F.col("chunk_id").alias("id")).distinct().withColumn("f", F.lit(True))
    return v["chunks"].select("id").join(flagged, "id", "left").select("id", F.col("f").isNotNull().alias("is_flagged"))


@query("chunk_video_join", """SELECT c.id AS chunk_id, c.video_id, c.chunk_index, v.title, v.source_file_id, v.recorded_date
FROM {chunks} c JOIN {videos} v ON v.id = c.video_id""")
def chunk_video_join(v):
    meta = v["videos"].select(F.col("id").alias("video_id"), "title", "source_file_id", "recorded_date")
    return v["chunks"].select(F.col("id").alias("chunk_id"), "video_id", "chunk_index").join(meta, "video_id")


@query("video_details", """
SELECT v.id, v.title, f.name AS folder_name, o.title AS original_title,
       (SELECT count(*) FROM {chunks} c WHERE c.video_id = v.id) AS chunk_count
FROM {videos} v LEFT JOIN {folders} f ON f.id = v.parent_folder_id LEFT JOIN {videos} o ON o.id = v.original_id""")
def video_details(v):
    names = v["folders"].select(F.col("id").alias("parent_folder_id"), F.col("name").alias("folder_name"))
    titles = v["videos"].select(F.col("id").alias("original_id"), F.col("title").alias("original_title"))
    counts = v["chunks"].groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n"))
    return v["videos"].join(names, "parent_folder_id", "left").join(titles, "original_id", "left").join(
        counts, "id", "left").select("id", "title", "folder_name", "original_title",
                                     F.coalesce("n", F.lit(0)).alias("chunk_count"))


@query("moderation_list", """
SELECT f.id AS flag_id, f.chunk_id, c.video_id, c.chunk_index, c.start_sec, c.end_sec, c.text AS original_text, v.title AS video_title
FROM {flags} f JOIN {chunks} c ON c.id = f.chunk_id JOIN {videos} v ON v.id = c.video_id""")
def moderation_list(v):
    return people.moderation_list(v["flags"], v["chunks"], v["videos"]).drop("created_at")


DUCK["reconciled"] = """
SELECT COALESCE(c.id, i.id) AS chunk_id, COALESCE(c.video_id, i.video_id) AS video_id,
       COALESCE(c.chunk_index, i.chunk_index) AS chunk_index,
       unnest(list_filter([CASE WHEN i.id IS NULL THEN 'missing_in_index' END, CASE WHEN c.id IS NULL THEN 'orphan_in_index' END,
         CASE WHEN c.id = i.id AND (c.video_id <> i.video_id OR c.chunk_index <> i.chunk_index) THEN 'index_metadata_mismatch' END,
         CASE WHEN c.id = i.id AND trim(c.text) <> trim(i.text) THEN 'index_text_mismatch' END], lambda x: x IS NOT NULL)) AS category
FROM {chunks} c FULL JOIN {index_points} i ON c.id = i.id
"""


@query("reconcile_index", "SELECT * FROM {reconciled}")
def reconcile_index(v):
    return indexing.reconcile(v["chunks"], v["index_points"])


DUCK["synced"] = """
SELECT COALESCE(l.id, v.source_file_id) AS id, v.id AS video_id,
  CASE WHEN l.excluded THEN 'excluded'
       WHEN l.id IS NOT NULL AND v.id IS NOT NULL THEN CASE WHEN l.name IS NOT DISTINCT FROM v.title
            AND l.parent_id IS NOT DISTINCT FROM v.parent_folder_id AND l.new_date IS NOT DISTINCT FROM v.recorded_date
            AND contains(l.name, '4K') = v.is_4k THEN 'unchanged' ELSE 'update' END
       WHEN l.id IS NOT NULL THEN CASE WHEN l.id IN (SELECT CASE WHEN json_valid(payload) THEN payload ->> '$.file_id' END FROM {tasks}
            WHERE task_type IN ('stage_1_download', 'stage_2_transcribe') AND json_valid(payload)
              AND payload ->> '$.file_id' IS NOT NULL) THEN 'already_queued' ELSE 'insert' END
       WHEN v.status IN ('failed', 'skipped_silent') THEN 'absent' ELSE 'missing' END AS action, v.status
FROM (SELECT *, contains(upper(name), 'GALLERY') AS excluded, {title_date(name)} AS new_date FROM {media}) l
FULL JOIN {videos} v ON v.source_file_id = l.id
"""


def title_date_sql(t: str) -> str:
    def part(pattern, y, m, d, century):
        g = [f"regexp_extract({t}, '{pattern}', {i})" for i in (y, m, d)]
        return (f"CASE WHEN regexp_matches({t}, '{pattern}') AND {g[1]} BETWEEN '01' AND '12' AND {g[2]} BETWEEN '01' AND '31' "
                f"THEN concat('{century}', {g[0]}, '-', {g[1]}, '-', {g[2]}) END")

    n = r"(\d\d)"
    return "COALESCE(" + ", ".join((
        part(rf"^(\d\d\d\d)\.{n}\.{n}\b", 1, 2, 3, ""), part(rf"^{n}\.{n}\.(\d\d\d\d)\b", 3, 2, 1, ""),
        part(rf"^{n}\.{n}\.{n}\b", 1, 2, 3, "20"))) + ")"


DUCK["synced"] = DUCK["synced"].replace("{title_date(name)}", title_date_sql("name"))


@query("inventory_sync", """
SELECT s.id, s.video_id, s.action, COALESCE(s.action = 'update' AND s.status IN ('indexed_chunks_ready', 'transcribed', 'indexing')
  AND s.video_id NOT IN (SELECT video_id FROM {tasks} WHERE task_type = 'stage_3_index' AND status IN ('pending', 'running')
                         AND video_id IS NOT NULL), FALSE) AS requeue FROM {synced} s""")
def inventory_sync(v):
    return sync.inventory_sync(v["listing"], v["videos"], v["tasks"], ["Gallery"]).select("id", "video_id", "action", "requeue")


@query("folder_sync", """
SELECT COALESCE(l.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'insert' WHEN l.id IS NULL THEN 'delete'
  WHEN l.name = f.name AND l.parent_id IS NOT DISTINCT FROM f.parent_id THEN 'unchanged' ELSE 'update' END AS action
FROM (SELECT * FROM {listing} WHERE is_folder) l FULL JOIN {folders} f ON f.id = l.id""")
def folder_sync(v):
    return sync.folder_sync(v["listing"].filter("is_folder"), v["folders"])


@query("folders_to_delete", "SELECT id FROM {folders} WHERE id NOT IN (SELECT id FROM {listing} WHERE is_folder)")
def folders_to_delete(v):
    return sync.folder_sync(v["listing"].filter("is_folder"), v["folders"]).filter("action = 'delete'").select("id")


@query("title_collisions", """
SELECT l.name AS title, l.id AS new_file_id, t.existing AS existing_file_id
FROM {media} l JOIN (SELECT title, max_by(source_file_id, id) AS existing FROM {videos} WHERE original_id IS NULL GROUP BY title) t
  ON t.title = l.name
WHERE t.existing <> l.id AND l.id NOT IN (SELECT source_file_id FROM {videos} WHERE original_id IS NOT NULL)""")
def title_collisions(v):
    return sync.title_collisions(v["listing"], v["videos"])


@query("md5_match", """
SELECT l.id AS file_id, o.id AS original_id FROM {listing} l
JOIN (SELECT md5_checksum, min(id) AS id, min_by(source_file_id, id) AS fid FROM {videos} WHERE original_id IS NULL GROUP BY 1) o
  ON o.md5_checksum = l.md5_checksum WHERE o.fid <> l.id""")
def md5_match(v):
    return dedupe.md5_match(v["listing"], v["videos"])


@query("unembedded_chunks", "SELECT id FROM {chunks} WHERE id NOT IN (SELECT id FROM {index_points})")
def unembedded_chunks(v):
    return indexing.unembedded(v["chunks"], v["index_points"]).select("id")


@query("issue_to_video", """SELECT i.id, i.video_id, v.source_url FROM {issue_videos} i LEFT JOIN {videos} v ON v.id = i.video_id""")
def issue_to_video(v):
    named = v["raw_issues"].withColumn("video_id", tx.issue_video_id(F.col("message")))
    return named.join(v["videos"].select(F.col("id").alias("video_id"), "source_url"), "video_id", "left").select(
        "id", "video_id", "source_url")


_PATHS = """
WITH RECURSIVE walk AS (
  SELECT id, id AS top, parent_id AS up, name AS path, 1 AS depth FROM {src}
  UNION ALL SELECT w.id, f.id, f.parent_id, concat(f.name, '/', w.path), w.depth + 1 FROM walk w JOIN {src} f ON f.id = w.up)
SELECT id, top AS root_id, depth, path FROM walk w WHERE up IS NULL OR up NOT IN (SELECT id FROM {src})
"""
DUCK["paths"] = "SELECT * FROM (" + _PATHS.replace("{src}", "{folders}") + ")"
DUCK["listed_folders"] = "SELECT * FROM {listing} WHERE is_folder"
DUCK["listed_paths"] = "SELECT * FROM (" + _PATHS.replace("{src}", "{listed_folders}") + ")"


@query("folder_path", "SELECT * FROM {paths}")
def folder_path(v):
    return folders.folder_paths(v["folders"])


@query("folder_tree_scan", """
SELECT l.id, p.root_id, CASE WHEN l.is_folder THEN p.depth ELSE p.depth + 1 END AS depth FROM {listing} l
JOIN {listed_paths} p ON p.id = CASE WHEN l.is_folder THEN l.id ELSE l.parent_id END WHERE p.root_id IN ('r0', 'r2')""")
def folder_tree_scan(v):
    roots = v["listing"].filter("id IN ('r0', 'r2')").select("id")
    return folders.tree_scan(v["listing"], roots).select("id", "root_id", "depth")


# -- aggregates ----------------------------------------------------------------------------

@query("archive_stats", """
SELECT count(*) AS videos, round(sum(duration_sec), 3) AS seconds, CAST(floor(sum(duration_sec) / 3600) AS BIGINT) AS hours
FROM {videos} WHERE status = 'indexed_chunks_ready'""")
def archive_stats(v):
    return v["videos"].filter("status = 'indexed_chunks_ready'").agg(
        F.count("*").alias("videos"), F.round(F.sum("duration_sec"), 3).alias("seconds"),
        F.floor(F.sum("duration_sec") / 3600).alias("hours"))


@query("tasks_by_status", "SELECT status, count(*) AS n FROM {tasks} GROUP BY status")
def tasks_by_status(v):
    return queue.counts_by_status(v["tasks"])


@query("pending_by_stage", """
SELECT CASE WHEN task_type = 'ingest_video' THEN 'stage_1_download' ELSE task_type END AS stage, count(*) AS n
FROM {tasks} WHERE status = 'pending' GROUP BY 1""")
def pending_by_stage(v):
    return queue.pending_by_stage(v["tasks"])


@query("chunk_counts", "SELECT v.id, count(c.id) AS n FROM {videos} v LEFT JOIN {chunks} c ON c.video_id = v.id GROUP BY v.id")
def chunk_counts(v):
    counts = v["chunks"].groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n"))
    return v["videos"].select("id").join(counts, "id", "left").fillna(0, ["n"])


@query("having_zero", """SELECT v.id FROM {videos} v LEFT JOIN {chunks} c ON c.video_id = v.id
WHERE v.status IN ('completed', 'indexed_chunks_ready') AND NOT v.is_silent GROUP BY v.id HAVING count(c.id) = 0""")
def having_zero(v):
    return quality.videos_without_chunks(v["videos"], v["chunks"]).select(F.col("context")["id"].cast("bigint").alias("id"))


@query("duplicate_keys", """SELECT md5_checksum, count(*) AS "count" FROM {videos} GROUP BY md5_checksum HAVING count(*) > 1""")
def duplicate_keys(v):
    found = quality.duplicate_keys(v["videos"], ["md5_checksum"], "md5")
    return found.select(F.col("context")["md5_checksum"].alias("md5_checksum"),
                        F.col("context")["count"].cast("bigint").alias("count"))


@query("words_per_minute", """
SELECT v.id, sum(length(c.text) - length(replace(c.text, ' ', '')) + 1) AS words,
       round(sum(length(c.text) - length(replace(c.text, ' ', '')) + 1) / (any_value(v.duration_sec) / 60), 4) AS wpm
FROM {videos} v JOIN {chunks} c ON c.video_id = v.id
WHERE v.status IN ('completed', 'indexed_chunks_ready') AND NOT v.is_silent AND v.duration_sec > 30 GROUP BY v.id""")
def words_per_minute(v):
    return quality.words_per_minute(v["videos"], v["chunks"]).select("id", "words", F.round("wpm", 4).alias("wpm"))


@query("distinct_indexed_chunks", """
SELECT generation_id, count(DISTINCT chunk_id) AS indexed_chunks FROM {outbox}
WHERE event_type = 'upsert' AND status = 'completed' GROUP BY generation_id""")
def distinct_indexed_chunks(v):
    return indexing.indexed_per_generation(v["outbox"])


@query("distinct_videos_with_chunks", "SELECT DISTINCT v.id, v.title FROM {videos} v JOIN {chunks} c ON c.video_id = v.id")
def distinct_videos_with_chunks(v):
    return v["videos"].join(v["chunks"].select(F.col("video_id").alias("id")), "id", "left_semi").select("id", "title")


DUCK["hashed_chunks"] = """
SELECT c.id, c.video_id, c.chunk_index, c.start_sec, c.end_sec, c.text,
  sha256(concat(v.source_file_id, ':', c.chunk_index)) AS logical_id,
  sha256(concat('{{"end_sec":', c.end_sec, ',"start_sec":', c.start_sec, ',"text":', to_json(trim(c.text, E' \\n\\r\\t')), '}}')) AS content_hash
FROM {chunks} c JOIN {videos} v ON v.id = c.video_id
"""
DUCK["set_hashes"] = """
SELECT video_id, sha256(string_agg(concat(logical_id, ':', content_hash, chr(10)), '' ORDER BY chunk_index, id)) AS set_hash
FROM {hashed_chunks} GROUP BY video_id
"""


def hashed_chunks(v):
    return chunking.with_identity(v["chunks"], v["videos"])


SPARK["hashed_chunks"] = hashed_chunks


@query("stable_chunk_id", "SELECT id, logical_id FROM {hashed_chunks}")
def stable_chunk_id(v):
    return v["hashed_chunks"].select("id", "logical_id")


@query("content_hash", "SELECT id, content_hash FROM {hashed_chunks}")
def content_hash(v):
    return v["hashed_chunks"].select("id", "content_hash")


@query("chunk_set_hash", "SELECT video_id, set_hash FROM {set_hashes}")
def chunk_set_hash(v):
    return indexing.chunk_set_hash(v["hashed_chunks"])


@query("chunk_span_stats", """SELECT video_id, count(*) AS n, min(chunk_index) AS first_index, max(chunk_index) AS last_index
FROM {chunks} GROUP BY video_id""")
def chunk_span_stats(v):
    return v["chunks"].groupBy("video_id").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first_index"),
                                               F.max("chunk_index").alias("last_index"))


@query("index_coverage", """SELECT (SELECT count(*) FROM {chunks}) AS stored, count(*) AS indexed,
(SELECT count(*) FROM {chunks}) = count(*) AS ok FROM {index_points}""")
def index_coverage(v):
    return indexing.coverage(v["chunks"], v["index_points"])


@query("readiness_rollup", """
SELECT 'index_coverage' AS "check", (SELECT count(*) FROM {chunks}) = (SELECT count(*) FROM {index_points}) AS ok
UNION ALL SELECT 'outbox_done', (SELECT count(*) FROM {outbox} WHERE status IN ('pending', 'processing', 'failed')) = 0
UNION ALL SELECT 'duplicates_clean', (SELECT count(*) FROM {videos} v JOIN {videos} o ON o.id = v.original_id
                                      WHERE o.original_id IS NOT NULL) = 0
UNION ALL SELECT 'ready', FALSE""")
def readiness_rollup(v):
    unfinished = v["outbox"].filter("status IN ('pending', 'processing', 'failed')").agg((F.count("*") == 0).alias("ok"))
    chains = quality.duplicate_chains(v["videos"]).agg((F.count("*") == 0).alias("ok"))
    checks = (
        indexing.coverage(v["chunks"], v["index_points"]).select(F.lit("index_coverage").alias("check"), "ok")
        .unionByName(unfinished.select(F.lit("outbox_done").alias("check"), "ok"))
        .unionByName(chains.select(F.lit("duplicates_clean").alias("check"), "ok")))
    return checks.unionByName(checks.agg(F.bool_and("ok").alias("ok")).select(F.lit("ready").alias("check"), "ok"))


# -- windows -------------------------------------------------------------------------------

@query("chunk_sequence_gaps", """
SELECT * FROM (SELECT id, video_id, chunk_index, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, id) - 1
  AS expected_index FROM {chunks}) WHERE chunk_index <> expected_index""")
def chunk_sequence_gaps(v):
    numbered = ranking.position_in_group(v["chunks"], "video_id", "chunk_index", "id", "expected_index")
    return numbered.filter("chunk_index <> expected_index").select("id", "video_id", "chunk_index", "expected_index")


@query("utterance_pause", """SELECT video_id, pos, round(lead(start) OVER (PARTITION BY video_id ORDER BY pos) - "end", 6) AS pause
FROM {utterances}""")
def utterance_pause(v):
    u = v["utterances"].select("video_id", "pos", "start", "end")
    following = u.select("video_id", (F.col("pos") - 1).alias("pos"), F.col("start").alias("next_start"))
    return u.join(following, ["video_id", "pos"], "left").select(
        "video_id", "pos", F.round(F.col("next_start") - F.col("end"), 6).alias("pause"))


DUCK["history"] = """
SELECT user_id, query, max(created_at) AS created_at, min(id) AS id FROM {history_log}
WHERE user_id IN (SELECT user_id FROM {user_settings} WHERE search_history_enabled) GROUP BY user_id, query
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(created_at) DESC, min(id) DESC) <= 20
"""


def history(v):
    return people.history_table(v["history_log"], v["user_settings"])


SPARK["history"] = history


@query("history_dedupe", "SELECT user_id, query, id FROM {history}")
def history_dedupe(v):
    return v["history"].select("user_id", "query", "id")


@query("history_topn", """SELECT user_id, query, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank
FROM {history} QUALIFY rank <= 10""")
def history_topn(v):
    return people.newest_queries(v["history"]).select("user_id", "query", "rank")


@query("history_suggest", "SELECT user_id, query FROM {history} WHERE contains(lower(query), 'er')")
def history_suggest(v):
    typed = v["user_settings"].select("user_id", F.lit("ER").alias("typed"))
    return people.suggest(v["history"], typed).select("user_id", "query")


@query("recent_queries", "SELECT id, query FROM {history_log} ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_queries(v):
    return v["history_log"].orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "query")


@query("md5_canonical", """SELECT id, first_value(id) OVER (PARTITION BY md5_checksum ORDER BY id) AS primary_id FROM {videos}
QUALIFY count(*) OVER (PARTITION BY md5_checksum) > 1""")
def md5_canonical(v):
    everyone = v["videos"].withColumn("original_id", F.lit(None).cast("bigint"))
    shared = dedupe.canonical_by_md5(everyone)
    return everyone.join(shared, "md5_checksum").select("id", "primary_id")


@query("vector_sample", """
SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS p, count(*) OVER () AS n FROM {vectors})
WHERE p % greatest(1, n // 60) = 0 AND p < 60 * greatest(1, n // 60)""")
def vector_sample(v):
    return ranking.vector_sample(v["vectors"], "chunk_id", 60)


@query("latest_state", """SELECT chunk_id, event_type, event_id FROM {outbox}
QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_state(v):
    return ranking.latest(v["outbox"], ["chunk_id"], ["ts", "event_id"]).select("chunk_id", "event_type", "event_id")


SPARK["generations"] = lambda v: v["tasks"].groupBy(F.col("generation_id").alias("id")).agg(
    F.max(F.when(F.col("status") == "failed", F.col("id"))).alias("last_id")).select(
    "id", F.when(F.col("id") < 4, "active").otherwise("retired").alias("status"),
    F.concat(F.lit("cfg"), (F.col("id") % 2).cast("string")).alias("config_hash"), "last_id")
DUCK["generations"] = """
SELECT generation_id AS id, CASE WHEN generation_id < 4 THEN 'active' ELSE 'retired' END AS status,
       concat('cfg', generation_id % 2) AS config_hash, max(CASE WHEN status = 'failed' THEN id END) AS last_id
FROM {tasks} GROUP BY generation_id
"""


@query("active_generation", "SELECT id, config_hash FROM {generations} WHERE status = 'active' ORDER BY id DESC LIMIT 1")
def active_generation(v):
    return generations.active_generation(v["generations"]).select("id", "config_hash")


# -- sorts and limits ----------------------------------------------------------------------

@query("next_task", f"""SELECT task_type, id FROM {{tasks}} WHERE status = 'pending'
AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}') AND task_type LIKE 'stage%'
QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY priority DESC, created_at, id) = 1""")
def next_task(v):
    return queue.next_task(v["tasks"], queue.STAGES, NOW).select("task_type", "id")


DUCK["free_flags"] = f"""SELECT * FROM {{flags}} WHERE locked_by IS NULL OR locked_at + INTERVAL 10800 SECOND < TIMESTAMP '{NOW}'"""
DUCK["own_flags"] = """SELECT locked_by AS user_id, chunk_id FROM {flags} WHERE locked_by IN (SELECT user_id FROM {moderators})
QUALIFY row_number() OVER (PARTITION BY locked_by ORDER BY created_at, chunk_id) = 1"""


@query("next_flag", """
SELECT m.user_id, COALESCE(o.chunk_id, (SELECT chunk_id FROM {free_flags} ORDER BY created_at, chunk_id LIMIT 1)) AS chunk_id
FROM {moderators} m LEFT JOIN {own_flags} o USING (user_id)""")
def next_flag(v):
    return people.next_flag(v["flags"], v["moderators"], NOW)


@query("lease_assignment", """
SELECT user_id, chunk_id FROM {own_flags}
UNION ALL SELECT u.user_id, f.chunk_id
FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS seat FROM {moderators} WHERE user_id NOT IN (SELECT user_id FROM {own_flags})) u
JOIN (SELECT chunk_id, row_number() OVER (ORDER BY created_at, chunk_id) AS seat FROM {free_flags}
      WHERE chunk_id NOT IN (SELECT chunk_id FROM {own_flags})) f USING (seat)""")
def lease_assignment(v):
    return people.assign_leases(v["flags"], v["moderators"], NOW)


@query("recent_failures", r"""
SELECT id, CASE WHEN NOT json_valid(payload) THEN 'Unknown Task'
  ELSE COALESCE(nullif(payload ->> '$.title', ''), nullif(payload ->> '$.file_id', ''), 'Task') END AS title, task_type, error_message,
  COALESCE(retries, 0) AS retries, COALESCE(nullif(max_retries, 0), 3) AS max_retries
FROM {tasks} WHERE status = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 5""")
def recent_failures(v):
    return queue.recent_failures(v["tasks"])


@query("no_space_list", r"""
SELECT id, COALESCE(nullif(payload ->> '$.title', ''), 'Unknown') AS title,
  printf('%.2f', COALESCE(CAST(payload ->> '$.file_size' AS DOUBLE), 0) / 1073741824) AS size_gb
FROM (SELECT * FROM {tasks} WHERE status = 'skipped_no_space' AND json_valid(payload) AND left(payload, 1) = '{{'
      ORDER BY updated_at DESC, id DESC LIMIT 20)""")
def no_space_list(v):
    return queue.no_space_list(v["tasks"])


@query("inventory_order", "SELECT id, is_folder FROM {listing} ORDER BY is_folder DESC, lower(name), id LIMIT 200")
def inventory_order(v):
    return sync.inventory_order(v["listing"]).limit(200).select("id", "is_folder")


@query("recent_issues", "SELECT id, message FROM {raw_issues} ORDER BY id DESC LIMIT 100")
def recent_issues(v):
    return v["raw_issues"].orderBy(F.desc("id")).limit(100)


# -- set operations ------------------------------------------------------------------------

@query("missing_ids", "SELECT id FROM {chunks} EXCEPT SELECT id FROM {index_points}")
def missing_ids(v):
    return v["chunks"].select("id").join(v["index_points"].select("id"), "id", "left_anti")


@query("orphan_ids", "SELECT id FROM {index_points} EXCEPT SELECT id FROM {chunks}")
def orphan_ids(v):
    return v["index_points"].select("id").join(v["chunks"].select("id"), "id", "left_anti")


@query("common_ids", "SELECT id FROM {index_points} INTERSECT SELECT id FROM {chunks}")
def common_ids(v):
    return v["index_points"].select("id").intersect(v["chunks"].select("id"))


@query("unique_ordered_ids", "SELECT parent_id, min(pos) AS pos FROM {listing} WHERE COALESCE(parent_id, '') <> '' GROUP BY parent_id")
def unique_ordered_ids(v):
    return sync.unique_ordered(v["listing"], "parent_id", "pos")


@query("listing_union_dedupe", """
SELECT id, name, source_no FROM (
  SELECT id, concat('drive ', name) AS name, 0 AS source_no, 0 AS pos FROM {folders}
  UNION ALL SELECT id, name, 1, pos FROM {listing})
QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_no, pos) = 1""")
def listing_union_dedupe(v):
    drives = v["folders"].select("id", F.concat(F.lit("drive "), "name").alias("name"), F.lit(0).cast("bigint").alias("pos"))
    return sync.listing_union([drives, v["listing"].select("id", "name", "pos")]).select("id", "name", "source_no")


@query("path_layout", """SELECT id, concat('transcripts/raw/', left(source_file_id, 2), '/', source_file_id, '.json.gz') AS path
FROM {videos}""")
def path_layout(v):
    return v["videos"].select("id", identity.path_layout(F.col("source_file_id"), "raw").alias("path"))
