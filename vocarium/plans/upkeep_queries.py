"""De-duplication, cascades, queue state, publishing and the integrity audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocarium.functions import identity, text as tx
from vocarium.operators import chunking, dedupe, indexing, people, quality, queue, sparse, sync, vectors
from vocarium.plans.registry import query
from vocarium.plans.views import DUCK, NOW, SPARK, tokens_sql
from vocarium.session import work_path, written
from vocarium.sources import generations, transcripts

# -- duplicates ----------------------------------------------------------------------------

DUCK["gallery"] = r"""
SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM (
  SELECT id, pos, COALESCE(created, '') AS created, COALESCE(CASE WHEN regexp_matches(size, '^\d+$') THEN CAST(size AS BIGINT) END, -1) AS size,
    regexp_matches(name, '(?i)\b(gallery|галерея)\b') AS marked,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[._\-]+', ' ', 'g'), '\b(gallery|галерея)\b', ' ', 'g'), '\s+', ' ', 'g')) AS key
  FROM {gallery_files})
"""
_WINS = """CASE WHEN f.marked <> g.marked THEN f.marked ELSE
  (g.created <> '' AND (f.created = '' OR g.created < f.created)) OR g.size > f.size END"""
DUCK["gallery_fold"] = f"""
SELECT * FROM (
  WITH RECURSIVE f AS (
    SELECT key, i, id, created, size, marked, NULL::VARCHAR AS skipped FROM {{gallery}} WHERE i = 1
    UNION ALL SELECT g.key, g.i, CASE WHEN {_WINS} THEN g.id ELSE f.id END, CASE WHEN {_WINS} THEN g.created ELSE f.created END,
      CASE WHEN {_WINS} THEN g.size ELSE f.size END, CASE WHEN {_WINS} THEN g.marked ELSE f.marked END,
      CASE WHEN {_WINS} THEN f.id ELSE g.id END
    FROM f JOIN {{gallery}} g ON g.key = f.key AND g.i = f.i + 1)
  SELECT * FROM f)
"""


@query("gallery_dedupe", "SELECT key, max_by(id, i) AS id FROM {gallery_fold} GROUP BY key")
def gallery_dedupe(v):
    return dedupe.gallery_dedupe(v["gallery_files"])[0]


@query("gallery_skipped_pairs", "SELECT key, skipped, id AS preferred FROM {gallery_fold} WHERE i > 1")
def gallery_skipped_pairs(v):
    return dedupe.gallery_dedupe(v["gallery_files"])[1]


@query("oldest_first_batch", """
SELECT id FROM {gallery_files} WHERE id IN (SELECT max_by(id, i) FROM {gallery_fold} GROUP BY key)
ORDER BY COALESCE(created, ''), lower(name), pos LIMIT 100""")
def oldest_first_batch(v):
    kept = dedupe.gallery_dedupe(v["gallery_files"])[0]
    return dedupe.oldest_first(v["gallery_files"], kept, 100).select("id")


# All copies as originals, the state before duplicates are linked.
SPARK["unlinked"] = lambda v: v["videos"].withColumn("original_id", F.lit(None).cast("bigint"))
DUCK["linked"] = """
SELECT id, CASE WHEN first_id <> id THEN first_id END AS original_id,
       CASE WHEN first_id <> id THEN 'skipped_duplicate_md5' ELSE status END AS status,
       CASE WHEN first_id = id THEN size_bytes END AS size_bytes
FROM (SELECT *, min(id) OVER (PARTITION BY md5_checksum) AS first_id FROM {videos})
"""


@query("md5_dedupe_links", "SELECT * FROM {linked}")
def md5_dedupe_links(v):
    return dedupe.link_md5_duplicates(v["unlinked"]).select("id", "original_id", "status", "size_bytes")


@query("chunks_after_linking", "SELECT id FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {linked} WHERE original_id IS NOT NULL)")
def chunks_after_linking(v):
    return dedupe.chunks_after_linking(v["chunks"], dedupe.link_md5_duplicates(v["unlinked"])).select("id")


# Each original with copies changes places with its first copy.
SPARK["swaps"] = lambda v: v["videos"].filter("original_id IS NOT NULL").groupBy("original_id").agg(F.min("id").alias("duplicate_id"))
DUCK["swaps"] = "SELECT original_id, min(id) AS duplicate_id FROM {videos} WHERE original_id IS NOT NULL GROUP BY original_id"


@query("swap_duplicate", """
SELECT v.id, CASE WHEN up.duplicate_id IS NOT NULL THEN NULL WHEN down.original_id IS NOT NULL THEN down.duplicate_id
                  ELSE COALESCE(sib.duplicate_id, v.original_id) END AS original_id,
  CASE WHEN up.duplicate_id IS NOT NULL THEN 'transcribed' WHEN down.original_id IS NOT NULL THEN 'skipped_duplicate_md5' ELSE v.status END AS status,
  CASE WHEN up.duplicate_id IS NOT NULL THEN o.size_bytes WHEN down.original_id IS NOT NULL THEN NULL ELSE v.size_bytes END AS size_bytes
FROM {videos} v LEFT JOIN {swaps} up ON up.duplicate_id = v.id LEFT JOIN {swaps} down ON down.original_id = v.id
LEFT JOIN {swaps} sib ON sib.original_id = v.original_id LEFT JOIN {videos} o ON o.id = up.original_id""")
def swap_duplicate(v):
    return dedupe.swap_duplicates(v["videos"], v["chunks"], v["swaps"])[0].select("id", "original_id", "status", "size_bytes")


@query("swap_duplicate_chunks", """SELECT c.id, COALESCE(s.duplicate_id, c.video_id) AS video_id FROM {chunks} c
LEFT JOIN {swaps} s ON s.original_id = c.video_id""")
def swap_duplicate_chunks(v):
    return dedupe.swap_duplicates(v["videos"], v["chunks"], v["swaps"])[1].select("id", "video_id")


# Originals divisible by three are gone.
SPARK["broken"] = lambda v: v["videos"].filter("original_id IS NOT NULL OR id % 3 <> 0")
DUCK["broken"] = "SELECT * FROM {videos} WHERE original_id IS NOT NULL OR id % 3 <> 0"


@query("orphan_duplicate_relink", """
SELECT v.id, v.original_id AS lost_id, o.found AS new_original_id,
       CASE WHEN o.found IS NULL THEN 'make_original_and_queue' ELSE 'relink' END AS action
FROM {broken} v LEFT JOIN (SELECT md5_checksum, min(id) AS found FROM {broken} WHERE original_id IS NULL GROUP BY 1) o USING (md5_checksum)
WHERE v.original_id IS NOT NULL AND v.original_id NOT IN (SELECT id FROM {broken} WHERE original_id IS NULL)""")
def orphan_duplicate_relink(v):
    return dedupe.relink_orphans(v["broken"])


@query("orphan_duplicates", """SELECT id, original_id FROM {broken} WHERE original_id IS NOT NULL
AND original_id NOT IN (SELECT id FROM {broken} WHERE original_id IS NULL)""")
def orphan_duplicates(v):
    return _context(quality.orphan_duplicates(v["broken"]), "id", "original_id")


@query("ingest_decision", """
SELECT l.id, CASE WHEN v.id IS NOT NULL THEN 'already_indexed' WHEN o.id IS NOT NULL THEN 'skipped_duplicate_md5' ELSE 'queued' END AS decision,
       COALESCE(v.id, o.id) AS video_id
FROM {listing} l LEFT JOIN {videos} v ON v.source_file_id = l.id
LEFT JOIN (SELECT md5_checksum, min(id) AS id FROM {videos} WHERE original_id IS NULL GROUP BY 1) o ON o.md5_checksum = l.md5_checksum
WHERE NOT l.is_folder""")
def ingest_decision(v):
    return dedupe.ingest_decision(v["listing"].filter("NOT is_folder"), v["videos"])


# -- cascades ------------------------------------------------------------------------------

SPARK["silent"] = lambda v: v["videos"].filter("is_silent").select("id")
DUCK["silent"] = "SELECT id, source_file_id FROM {videos} WHERE is_silent"
DUCK["task_refs"] = """
SELECT id, video_id AS vid, NULL AS fid FROM {tasks}
UNION ALL SELECT id, TRY_CAST(CASE WHEN json_valid(payload) THEN payload ->> '$.video_id' END AS BIGINT), NULL FROM {tasks}
UNION ALL SELECT id, NULL, CASE WHEN json_valid(payload) THEN payload ->> '$.file_id' END FROM {tasks}
"""


@query("mark_silent_cascade", """
SELECT 'chunks' AS "table", count(*) AS n FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {silent})
UNION ALL SELECT 'tasks', count(*) FROM {tasks} WHERE id NOT IN (SELECT r.id FROM {task_refs} r JOIN {silent} s ON s.id = r.vid OR s.source_file_id = r.fid)
UNION ALL SELECT 'issues', count(*) FROM {issue_videos} WHERE video_id IS NULL OR video_id NOT IN (SELECT id FROM {silent})
UNION ALL SELECT 'videos', count(*) FROM {videos} WHERE is_silent""")
def mark_silent_cascade(v):
    after = indexing.mark_silent(v["videos"], v["chunks"], v["tasks"], v["raw_issues"], v["silent"])
    after["videos"] = after["videos"].filter("is_silent")
    return _counts(after)


def _counts(tables):
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


DUCK["gone"] = "SELECT id FROM {videos} WHERE is_excluded AND id NOT IN (SELECT id FROM {active_videos})"


@query("delete_video_cascade", """
SELECT 'refused' AS "table", count(*) AS n FROM {videos} WHERE is_excluded AND id IN (SELECT id FROM {active_videos})
UNION ALL SELECT 'videos', count(*) FROM {videos} WHERE id NOT IN (SELECT id FROM {gone})
UNION ALL SELECT 'chunks', count(*) FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {gone})
UNION ALL SELECT 'issues', count(*) FROM {issue_videos} WHERE video_id IS NULL OR video_id NOT IN (SELECT id FROM {gone})""")
def delete_video_cascade(v):
    return _counts(indexing.delete_videos(v["videos"], v["chunks"], v["tasks"], v["raw_issues"],
                                          v["videos"].filter("is_excluded").select("id")))


@query("integrity_issue_cleanup", """
SELECT id FROM {issue_videos} WHERE video_id IS NULL OR video_id NOT IN (SELECT id FROM {silent})""")
def integrity_issue_cleanup(v):
    return indexing.drop_issues(v["raw_issues"], v["silent"]).select("id")


@query("sync_metadata", """
SELECT v.id, l.id IS NOT NULL AND (l.name <> v.title OR l.parent_id IS DISTINCT FROM v.parent_folder_id) AS changed,
       COALESCE(l.name, v.title) AS title FROM {videos} v LEFT JOIN {listing} l ON l.id = v.source_file_id""")
def sync_metadata(v):
    return sync.sync_metadata(v["videos"], v["listing"]).select("id", "changed", "title")


# -- queue ---------------------------------------------------------------------------------

@query("retry_backoff", """
SELECT id, COALESCE(retries, 0) + 1 AS retries,
  CASE WHEN perm THEN 'permanent' WHEN COALESCE(retries, 0) + 1 < m THEN 'transient' ELSE 'retry_exhausted' END AS failure_kind,
  CASE WHEN NOT perm AND COALESCE(retries, 0) + 1 < m THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN NOT perm AND COALESCE(retries, 0) + 1 < m THEN CAST(least(15 * pow(2, COALESCE(retries, 0)), 900) AS INT) END AS delay_sec
FROM (SELECT *, COALESCE(regexp_matches(lower(error_message), '401|403|forbidden|unauthorized|invalid api key'), FALSE) AS perm,
             CASE WHEN max_retries = 0 THEN 3 ELSE max_retries END AS m FROM {tasks})""")
def retry_backoff(v):
    return queue.fail_tasks(v["tasks"], NOW).select("id", "retries", "failure_kind", "status", "delay_sec")


@query("purge_old_tasks", f"""
SELECT id FROM {{tasks}} WHERE NOT (status IN ('completed', 'failed', 'skipped_silent', 'skipped_duplicate_md5', 'skipped_no_space')
  AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 20 DAY)""")
def purge_old_tasks(v):
    return queue.purge_old(v["tasks"], NOW, 20).select("id")


@query("queue_state_changes", """
SELECT CASE status WHEN 'failed' THEN 'pending' WHEN 'skipped_no_space' THEN 'pending' WHEN 'running' THEN 'pending' ELSE status END AS status,
       count(*) AS n FROM {tasks} GROUP BY 1""")
def queue_state_changes(v):
    moved = queue.reset_running(queue.restart(queue.restart(v["tasks"], "failed"), "skipped_no_space"))
    return queue.counts_by_status(moved)


@query("supersede_duplicates", """
SELECT id, CASE WHEN status IN ('pending', 'running') AND id > min(CASE WHEN status IN ('pending', 'running') THEN id END)
  OVER (PARTITION BY video_id, generation_id) AND video_id IS NOT NULL THEN 'superseded' ELSE status END AS status FROM {tasks}""")
def supersede_duplicates(v):
    key = F.when(F.col("video_id").isNotNull(), F.concat_ws(":", F.col("video_id").cast("string"), F.col("generation_id").cast("string")))
    return queue.supersede_duplicates(v["tasks"].withColumn("dedupe_key", key)).select("id", "status")


@query("stage_outcome", """
SELECT id, CASE outcome WHEN 'no_space' THEN 'no_space_busy' ELSE outcome END AS outcome,
  CASE outcome WHEN 'success' THEN CASE task_type WHEN 'stage_1_download' THEN 'stage_2_transcribe' WHEN 'ingest_video' THEN 'stage_2_transcribe'
       ELSE 'stage_3_index' END WHEN 'audio_lost' THEN 'stage_1_download' ELSE task_type END AS next_stage,
  CASE outcome WHEN 'success' THEN CASE WHEN task_type = 'stage_3_index' THEN 'completed' ELSE 'pending' END
       WHEN 'no_space' THEN 'pending' WHEN 'completed_silent' THEN 'completed'
       ELSE CASE WHEN COALESCE(retries, 0) + 1 < CASE WHEN max_retries = 0 THEN 3 ELSE max_retries END THEN 'pending' ELSE 'failed' END END AS next_status
FROM (SELECT *, CASE id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'no_space' WHEN 2 THEN 'audio_lost' WHEN 3 THEN 'completed_silent' ELSE 'error' END AS outcome
      FROM {tasks})""")
def stage_outcome(v):
    names = F.array(*[F.lit(n) for n in ("success", "no_space", "audio_lost", "completed_silent", "error")])
    results = v["tasks"].select("id", F.get(names, (F.col("id") % 5).cast("int")).alias("outcome"), F.lit("timeout").alias("message"))
    return queue.stage_outcome(results, v["tasks"]).select("id", "outcome", "next_stage", "next_status")


@query("index_task_dedupe_key", """
SELECT video_id, concat('stage_3_index:1:', video_id, ':', set_hash) AS dedupe_key FROM {set_hashes} WHERE video_id % 4 <> 0""")
def index_task_dedupe_key(v):
    sets = indexing.chunk_set_hash(v["hashed_chunks"])
    opened = sets.filter("video_id % 4 = 0").select(
        F.col("video_id").alias("id"), "video_id", F.lit("pending").alias("status"),
        F.concat_ws(":", F.lit("stage_3_index"), F.lit("1"), F.col("video_id").cast("string"), "set_hash").alias("dedupe_key"))
    return queue.index_dedupe_keys(sets, opened, 1)


@query("requeue_plan", """
SELECT DISTINCT v.id AS video_id, 'stage_1_download' AS task_type, 8 AS priority FROM {videos} v
JOIN {issue_videos} i ON i.video_id = v.id WHERE v.id NOT IN (SELECT id FROM {active_videos})""")
def requeue_plan(v):
    named = v["raw_issues"].withColumn("video_id", tx.issue_video_id(F.col("message")))
    return queue.requeue_for_issues(named, v["videos"], v["tasks"]).select("video_id", "task_type", "priority")


@query("backfill_metadata", """
SELECT id, CASE WHEN id % 2 = 0 THEN 'kept' ELSE logical_id END AS logical_id, content_hash, CASE WHEN id % 3 = 0 THEN 7 ELSE 2 END AS generation_id
FROM {hashed_chunks}""")
def backfill_metadata(v):
    holes = v["chunks"].withColumns({
        "logical_id": F.when(F.col("id") % 2 == 0, "kept"), "content_hash": F.lit(None).cast("string"),
        "generation_id": F.when(F.col("id") % 3 == 0, F.lit(7).cast("bigint"))})
    return indexing.backfill(holes, v["videos"], 2).select("id", "logical_id", "content_hash", "generation_id")


@query("stale_snapshot_guard", """
SELECT video_id, CASE WHEN video_id IN (SELECT video_id FROM {chunks} WHERE id % 31 = 5) THEN 'stale' ELSE 'publish' END AS decision
FROM {set_hashes}""")
def stale_snapshot_guard(v):
    edited = v["chunks"].withColumn("text", F.when(F.col("id") % 31 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    now = indexing.chunk_set_hash(chunking.with_identity(edited, v["videos"]))
    return indexing.stale_snapshot_guard(indexing.chunk_set_hash(v["hashed_chunks"]), now)


@query("apply_outbox", """
SELECT c.id AS chunk_id FROM {chunks} c JOIN {last_events} l ON l.chunk_id = c.id WHERE l.event_type = 'upsert'
UNION SELECT i.id FROM {index_points} i LEFT JOIN {last_events} l ON l.chunk_id = i.id
WHERE l.event_type IS NULL OR l.event_type = 'upsert'""")
def apply_outbox(v):
    content = v["chunks"].select("id", "video_id", "chunk_index", "text")
    return indexing.apply_outbox(v["index_points"], v["outbox"].withColumnRenamed("chunk_id", "id"), content, "id").select(
        F.col("id").alias("chunk_id"))


DUCK["last_events"] = "SELECT chunk_id, max_by(event_type, {{'ts': ts, 'k': event_key}}) AS event_type FROM {outbox} GROUP BY chunk_id"


@query("complete_outbox", """SELECT CASE WHEN event_id % 2 = 0 AND status IN ('pending', 'processing') THEN 'completed' ELSE status END AS status,
count(*) AS n FROM {outbox} GROUP BY 1""")
def complete_outbox(v):
    done = indexing.complete_events(v["outbox"], v["outbox"].filter("event_id % 2 = 0").select("event_id"))
    return done.groupBy("status").agg(F.count("*").alias("n"))


@query("flag_upsert", """SELECT id AS chunk_id FROM {chunks} WHERE chunk_index % 2 = 0 AND id NOT IN (SELECT chunk_id FROM {flags})""")
def flag_upsert(v):
    asked = v["chunks"].select(F.col("id").alias("chunk_id"), F.when(
        F.col("chunk_index") % 2 == 0, F.col("video_id")).otherwise(-1).alias("video_id"))
    return people.upsert_flags(v["flags"], asked.unionByName(asked), v["chunks"])


@query("flag_dismiss", "SELECT chunk_id FROM {flags} WHERE chunk_id NOT IN (SELECT id FROM {chunks} WHERE chunk_index = 0 AND video_id % 2 = 0)")
def flag_dismiss(v):
    gone = v["chunks"].filter("chunk_index = 0 AND video_id % 2 = 0").select(F.col("id").alias("chunk_id"))
    return people.dismiss_flags(v["flags"], gone).select("chunk_id")


@query("history_delete", """SELECT user_id, query FROM {history} WHERE user_id NOT IN ('u1', 'u2')
AND NOT (query = 'click 1') """)
def history_delete(v):
    single = v["user_settings"].select("user_id", F.lit(" click 1 ").alias("query"))
    cleared = v["user_settings"].filter("user_id IN ('u1', 'u2')").select("user_id", F.lit(None).cast("string").alias("query"))
    return people.forget(v["history"], single.unionByName(cleared)).select("user_id", "query")


# -- embeddings, sparse vectors, publishing ------------------------------------------------

@query("embed_chunks", """
SELECT chunk_id, 26 AS size, length(regexp_replace(lower(text), '[^a-z]', '', 'g'))::DOUBLE AS letters FROM {points}""")
def embed_chunks(v):
    made = vectors.embed_chunks(v["points"].select("chunk_id", "text"), _letter_counts, 26)
    return made.select("chunk_id", F.size("embedding").alias("size"), F.round(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("letters"))


def _letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: counts of the Latin letters."""
    return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]


@query("embedding_memo", "SELECT count(*) AS n, count(DISTINCT text) AS texts, (SELECT count(DISTINCT text) FROM {points} "
                         "WHERE text NOT IN (SELECT text FROM {points} WHERE chunk_index = 0)) AS fresh FROM {points}")
def embedding_memo(v):
    points = written(v["points"].select("chunk_id", "chunk_index", "text"), "memo_texts")
    texts = points.select("chunk_id", "text")
    first = points.filter("chunk_index = 0").select("text").distinct()
    memo = first.select(F.sha2(F.concat_ws(":", F.lit("RETRIEVAL_DOCUMENT"), "text"), 256).alias("key"),
                        vectors.hashed_embedding(F.col("text")).alias("embedding"))
    done, fresh = vectors.embedding_memo(texts, memo, "RETRIEVAL_DOCUMENT")
    added = fresh.agg(F.count("*").alias("fresh")).scalar()
    return done.agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts")).withColumn("fresh", added)


DUCK["sparse"] = f"""
SELECT id, slot, count(*) AS value FROM (SELECT id, CAST(('0x' || left(md5(w), 4)) AS BIGINT) AS slot
  FROM (SELECT id, unnest({tokens_sql('text')}) AS w FROM {{chunks}})) GROUP BY id, slot
"""


@query("sparse_vectors", f"""
SELECT q.item_id AS query_id, s.id AS chunk_id, sum(q.value * s.value)::BIGINT AS score
FROM (SELECT item_id, CAST(('0x' || left(md5(w), 4)) AS BIGINT) AS slot, count(*) AS value
      FROM (SELECT item_id, unnest({tokens_sql('text')}) AS w FROM {{benchmark}}) GROUP BY 1, 2) q
JOIN {{sparse}} s USING (slot) GROUP BY q.item_id, s.id""")
def sparse_vectors(v):
    def of(df, key, name):
        slots = F.transform(tx.tokens(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("bigint"))
        return df.select(F.col(key).alias(name), slots.alias("indices")).withColumn("values", F.transform("indices", lambda i: F.lit(1.0)))

    index = sparse.sparse_index(of(v["chunks"], "id", "id"))
    return sparse.sparse_dot(of(v["benchmark"], "item_id", "query_id"), index).withColumn("score", F.col("score").cast("bigint"))


@query("publish_generation", """SELECT id, status, n AS indexed_chunks FROM (VALUES (1, 'retired'), (2, 'active')) t(id, status),
(SELECT count(*) AS n FROM {chunks})""")
def publish_generation(v):
    root = work_path(v.spark, "generations")
    points = v["chunks"].select("id", "video_id", "chunk_index", "text")
    expected = points.count()
    for number in (1, 2):
        generations.publish(v.spark, root, points, number, f"index-{number}", "cfg", expected)
    return generations.read_generations(v.spark, root).select("id", "status", "indexed_chunks")


@query("validate_snapshot", """SELECT 'chunks' AS "table", 'content differs' AS problem UNION ALL SELECT 'tasks', 'row count differs'""")
def validate_snapshot(v):
    before = generations.snapshot({n: v[n] for n in ("chunks", "tasks", "videos")})
    after = generations.snapshot({
        "chunks": v["chunks"].withColumn("text", F.when(F.col("id") == 0, "changed").otherwise(F.col("text"))),
        "tasks": v["tasks"].filter("id > 0"), "videos": v["videos"]})
    return generations.validate_snapshot(before, after)


# -- audit ---------------------------------------------------------------------------------

def _context(found, *keys):
    """Context numbers of issues as columns."""
    return found.select(*[F.col("context")[k].cast("bigint").alias(k) for k in keys])


@query("dq_foreign_keys", """
SELECT 'videos' AS "table", CAST(id AS VARCHAR) AS rowid FROM {videos} WHERE parent_folder_id NOT IN (SELECT id FROM {folders})
UNION ALL SELECT 'chunks', CAST(id AS VARCHAR) FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {videos})
UNION ALL SELECT 'tasks', CAST(id AS VARCHAR) FROM {tasks} WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT id FROM {videos})""")
def dq_foreign_keys(v):
    found = quality.foreign_keys([
        ("videos", v["videos"], "parent_folder_id", v["folders"]), ("chunks", v["chunks"], "video_id", v["videos"]),
        ("folders", v["folders"], "parent_id", v["folders"]), ("tasks", v["tasks"], "video_id", v["videos"])])
    return found.select(F.col("context")["table"].alias("table"), F.col("context")["rowid"].alias("rowid"))


@query("dq_active_work", "SELECT count(*) AS n FROM {tasks} WHERE status IN ('pending', 'running')")
def dq_active_work(v):
    return _context(quality.active_work(v["tasks"]), "n")


@query("dq_missing_source_id", "SELECT id FROM {videos} WHERE original_id IS NULL AND NOT is_silent AND id % 50 = 3")
def dq_missing_source_id(v):
    holes = v["videos"].withColumn("source_file_id", F.when(F.col("id") % 50 != 3, F.col("source_file_id")).otherwise(""))
    return _context(quality.missing_source_id(holes), "id")


# Transcripts on disk: those of conversations, under the file ids of their videos.
def _files(v, kind):
    named = v["raw_documents"].withColumn("conv", F.substring("file_id", 3, 20).cast("bigint")).drop("file_id").join(
        v["videos"].select(F.col("id").alias("conv"), F.col("source_file_id").alias("file_id")), "conv")
    strays = v["raw_documents"].withColumn("file_id", F.concat(F.lit("stray-"), "file_id"))
    listed = named.select("file_id").unionByName(strays.select("file_id")).withColumn(
        "path", F.concat(F.lit("/data/"), "file_id", F.lit(".json.gz")))
    corrupt = named.select("file_id", (F.col("conv") % 7 == 0).alias("corrupt"))
    return transcripts.file_paths(listed, corrupt, kind)


@query("dq_missing_or_corrupt_files", """
SELECT CASE WHEN c.conv_id IS NULL THEN 'missing_raw' ELSE 'corrupt_raw' END AS category, count(*) AS n
FROM {videos} v LEFT JOIN (SELECT DISTINCT conv_id FROM {conversations}) c ON c.conv_id = v.id
WHERE v.original_id IS NULL AND NOT v.is_silent AND (c.conv_id IS NULL OR c.conv_id % 7 = 0) GROUP BY 1""")
def dq_missing_or_corrupt_files(v):
    found = quality.missing_files(v["videos"], _files(v, "raw"), "raw")
    return found.groupBy("category").agg(F.count("*").alias("n"))


@query("dq_orphan_files", """SELECT count(*) AS n FROM (
  SELECT DISTINCT conv_id FROM {conversations}
  UNION ALL SELECT DISTINCT c.conv_id FROM {conversations} c JOIN {videos} v ON v.id = c.conv_id WHERE v.original_id IS NOT NULL OR v.is_silent)""")
def dq_orphan_files(v):
    return quality.orphan_files(v["videos"], _files(v, "raw"), "raw").agg(F.count("*").alias("n"))


@query("orphan_files", """SELECT DISTINCT concat('transcripts/raw/st/stray-cv', conv_id, '.json.gz') AS path FROM {conversations}""")
def orphan_files(v):
    found = _files(v, "raw").select("path")
    return found.join(v["videos"].select(identity.path_layout(F.col("source_file_id"), "raw").alias("path")), "path", "left_anti")


@query("dq_chunk_count", """
SELECT v.id AS video_id, COALESCE(s.n, 0) AS stored_count, COALESCE(d.n, 0) AS derived_count FROM {videos} v
LEFT JOIN (SELECT video_id, count(*) AS n FROM {chunks} GROUP BY 1) s ON s.video_id = v.id
LEFT JOIN (SELECT video_id, count(*) AS n FROM {rechunked} GROUP BY 1) d ON d.video_id = v.id
WHERE v.original_id IS NULL AND NOT v.is_silent AND COALESCE(s.n, 0) <> COALESCE(d.n, 0)""")
def dq_chunk_count(v):
    derived = chunking.rechunk_videos(v["videos"], v["utterances"])
    return _context(quality.chunk_count(v["videos"], v["chunks"], derived), "video_id", "stored_count", "derived_count")


@query("dq_first_text", """
SELECT v.id AS video_id FROM {videos} v JOIN (SELECT video_id, min_by(text, chunk_index) AS t FROM {derived_chunks}
  WHERE video_id % 3 <> 0 OR chunk_index > 0 GROUP BY 1) c ON c.video_id = v.id
JOIN {utterances} u ON u.video_id = v.id AND u.pos = 0
WHERE v.original_id IS NULL AND NOT v.is_silent AND u.text <> '' AND NOT starts_with(c.t, u.text)""")
def dq_first_text(v):
    cut = v["derived_chunks"].filter("video_id % 3 <> 0 OR chunk_index > 0")
    return _context(quality.first_text(v["videos"], cut, v["utterances"]), "video_id")


for _kind in ("missing_in_index", "orphan_in_index", "index_metadata_mismatch", "index_text_mismatch"):
    _name = {"missing_in_index": "dq_index_missing", "orphan_in_index": "dq_index_orphan",
             "index_metadata_mismatch": "dq_index_metadata", "index_text_mismatch": "dq_index_text"}[_kind]

    @query(_name, f"SELECT chunk_id, video_id FROM {{reconciled}} WHERE category = '{_kind}'")
    def _index_check(v, kind=_kind):
        found = quality.index_findings(v["chunks"], v["index_points"]).filter(F.col("category") == kind)
        return _context(found, "chunk_id", "video_id")


@query("dq_vectors", """
SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'vector_dimension' WHEN chunk_id % 5 = 0 THEN 'zero_vector' ELSE 'missing_sample_vector' END AS category
FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS p, count(*) OVER () AS n FROM {vectors})
WHERE p % greatest(1, n // 100) = 0 AND p < 100 * greatest(1, n // 100) AND (chunk_id % 3 = 0 OR chunk_id % 5 = 0 OR chunk_id % 7 = 0)""")
def dq_vectors(v):
    short = F.slice("embedding", 1, 10)
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    broken = v["vectors"].filter("chunk_id % 3 = 0 OR chunk_id % 5 = 0 OR chunk_id % 7 <> 0").withColumn(
        "embedding", F.when(F.col("chunk_id") % 3 == 0, short).when(F.col("chunk_id") % 5 == 0, zero).otherwise(F.col("embedding")))
    found = quality.vector_findings(broken, v["vectors"].select("chunk_id"), 100, 64)
    return found.select(F.col("context")["chunk_id"].cast("bigint").alias("chunk_id"), "category")


@query("dq_videos_without_chunks", """SELECT id FROM {videos} WHERE status IN ('completed', 'indexed_chunks_ready') AND NOT is_silent
AND id NOT IN (SELECT video_id FROM {chunks})""")
def dq_videos_without_chunks(v):
    return _context(quality.videos_without_chunks(v["videos"], v["chunks"]), "id")


@query("dq_duplicate_sources", """SELECT id AS source_file_id, count(*) AS "count" FROM (
  SELECT source_file_id AS id FROM {videos} UNION ALL SELECT id FROM {listing} WHERE NOT is_folder) GROUP BY id HAVING count(*) > 1""")
def dq_duplicate_sources(v):
    both = v["videos"].select("source_file_id").unionByName(
        v["listing"].filter("NOT is_folder").select(F.col("id").alias("source_file_id")))
    found = quality.duplicate_keys(both, ["source_file_id"], "duplicate_source_file_id")
    return found.select(F.col("context")["source_file_id"].alias("source_file_id"), F.col("context")["count"].cast("bigint").alias("count"))


@query("dq_duplicate_md5", """SELECT md5_checksum, count(*) AS "count" FROM {videos} GROUP BY 1 HAVING count(*) > 1""")
def dq_duplicate_md5(v):
    found = quality.duplicate_keys(v["unlinked"], ["md5_checksum"], "duplicate_original_md5")
    return found.select(F.col("context")["md5_checksum"].alias("md5_checksum"), F.col("context")["count"].cast("bigint").alias("count"))


@query("dq_duplicate_index", """SELECT video_id, chunk_index, count(*) AS "count" FROM {chunks} GROUP BY 1, 2 HAVING count(*) > 1""")
def dq_duplicate_index(v):
    return _context(quality.duplicate_keys(v["chunks"], ["video_id", "chunk_index"], "duplicate_chunk_index"),
                    "video_id", "chunk_index", "count")


_DUPLICATE_CHUNKS = """SELECT v.id, count(*) AS chunk_count FROM {videos} v JOIN {derived_chunks} c ON c.video_id = v.id
WHERE v.original_id IS NOT NULL GROUP BY v.id"""


@query("dq_duplicate_has_chunks", _DUPLICATE_CHUNKS)
def dq_duplicate_has_chunks(v):
    return _context(quality.duplicates_with_chunks(v["videos"], v["derived_chunks"]), "id", "chunk_count")


@query("duplicates_with_chunks", "SELECT id FROM (" + _DUPLICATE_CHUNKS + ")")
def duplicates_with_chunks(v):
    return v["videos"].filter("original_id IS NOT NULL").join(
        v["derived_chunks"].select(F.col("video_id").alias("id")), "id", "left_semi").select("id")


@query("dq_orphan_duplicates", """SELECT id FROM {broken} WHERE original_id IS NOT NULL AND original_id NOT IN (SELECT id FROM {broken} WHERE original_id IS NULL)""")
def dq_orphan_duplicates(v):
    return _context(quality.orphan_duplicates(v["broken"]), "id")


# Copies linked to the copy before them, not to the oldest.
SPARK["chained"] = lambda v: v["videos"].withColumn("original_id", F.when(
    F.col("original_id").isNull() & (F.col("id") % 10 == 1), F.col("id") - 1).otherwise(F.col("original_id")))
DUCK["chained"] = "SELECT id, CASE WHEN original_id IS NULL AND id % 10 = 1 THEN id - 1 ELSE original_id END AS original_id FROM {videos}"


@query("dq_chains", "SELECT id FROM {chained} WHERE original_id IN (SELECT id FROM {chained} WHERE original_id IS NOT NULL)")
def dq_chains(v):
    return _context(quality.duplicate_chains(v["chained"]), "id")


@query("dq_orphan_chunks", "SELECT id, video_id FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {videos})")
def dq_orphan_chunks(v):
    return _context(quality.orphan_chunks(v["chunks"], v["videos"]), "id", "video_id")


@query("orphan_chunks", "SELECT id FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {videos})")
def orphan_chunks(v):
    return quality.dangling(v["chunks"], "video_id", v["videos"]).select("id")


DUCK["slow"] = """
SELECT v.id FROM {videos} v JOIN {chunks} c ON c.video_id = v.id
WHERE v.status IN ('completed', 'indexed_chunks_ready') AND NOT v.is_silent AND v.duration_sec > 30
GROUP BY v.id HAVING sum(length(c.text) - length(replace(c.text, ' ', '')) + 1) / (any_value(v.duration_sec) / 60) < 100
"""


@query("dq_low_wpm", "SELECT id FROM {slow}")
def dq_low_wpm(v):
    return _context(quality.low_wpm(v["videos"], v["chunks"], 100), "id")


@query("dq_sequence", """
SELECT * FROM (SELECT id, chunk_index, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, id) - 1 AS expected_index FROM {chunks})
WHERE chunk_index <> expected_index""")
def dq_sequence(v):
    return _context(quality.chunk_sequence(v["chunks"]), "id", "chunk_index", "expected_index")


@query("dq_time", "SELECT id FROM {chunks} WHERE start_sec IS NULL OR end_sec IS NULL OR start_sec >= end_sec OR start_sec < 0")
def dq_time(v):
    return _context(quality.chunk_time(v["chunks"]), "id")


@query("dq_task_payload", """SELECT id FROM {tasks} WHERE CASE WHEN json_valid(payload) THEN json_type(payload) <> 'OBJECT' ELSE TRUE END""")
def dq_task_payload(v):
    return _context(quality.task_payload(v["tasks"]).select(F.create_map(
        F.lit("id"), F.col("context")["id"]).alias("context")), "id")


# Nations 0 and 1 are put into a customer of theirs, which closes two loops.
_CYCLE = "CASE WHEN id IN ('n0', 'n1') THEN (SELECT min(id) FROM {folders} c WHERE c.parent_id = f.id) ELSE parent_id END"
DUCK["looped"] = f"SELECT id, name, {_CYCLE} AS parent_id FROM {{folders}} f"


def _looped(v):
    child = v["folders"].filter("parent_id IN ('n0', 'n1')").groupBy(F.col("parent_id").alias("id")).agg(F.min("id").alias("child"))
    return v["folders"].join(child, "id", "left").select("id", "name", F.coalesce("child", "parent_id").alias("parent_id"))


SPARK["looped"] = _looped


@query("dq_folder_cycles", """
SELECT id FROM (WITH RECURSIVE w AS (SELECT id, parent_id AS up, 1 AS n FROM {looped} WHERE parent_id IS NOT NULL
  UNION SELECT w.id, f.parent_id, w.n + 1 FROM w JOIN {looped} f ON f.id = w.up WHERE w.n < 8 AND w.up <> w.id AND f.parent_id IS NOT NULL)
  SELECT DISTINCT id FROM w WHERE up = id)""")
def dq_folder_cycles(v):
    return quality.folder_cycle(v["looped"]).select(F.col("context")["id"].alias("id"))


@query("dq_table_constraints", """
SELECT 'chunks' AS "table", CAST(id AS VARCHAR) AS rowid FROM {chunks} WHERE end_sec - 16 * (id % 2) < start_sec
UNION ALL SELECT 'videos', CAST(id AS VARCHAR) FROM {videos} WHERE size_bytes - 100000 < 0
UNION ALL SELECT 'folders', id FROM {folders} WHERE id = 'r1'""")
def dq_table_constraints(v):
    bad_folders = v["folders"].withColumn("parent_id", F.when(F.col("id") == "r1", "r1").otherwise(F.col("parent_id")))
    bad_videos = v["videos"].withColumn("size_bytes", F.col("size_bytes") - 100000)
    bad_chunks = v["chunks"].withColumn("end_sec", F.col("end_sec") - 16 * (F.col("id") % 2))
    found = quality.table_constraints(bad_folders, bad_videos, bad_chunks)
    return found.select(F.col("context")["table"].alias("table"), F.col("context")["rowid"].alias("rowid"))


DUCK["audit_counts"] = """
SELECT 'error' AS severity, 'foreign_key' AS category, (SELECT count(*) FROM {videos} WHERE parent_folder_id NOT IN (SELECT id FROM {folders}))
   + (SELECT count(*) FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {videos}))
   + (SELECT count(*) FROM {tasks} WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT id FROM {videos})) AS n
UNION ALL SELECT 'warning', 'worker_active', 1
UNION ALL SELECT 'error', category, count(*) FROM {reconciled} GROUP BY category
UNION ALL SELECT 'error', 'video_without_chunks', count(*) FROM {videos} WHERE status IN ('completed', 'indexed_chunks_ready') AND NOT is_silent
   AND id NOT IN (SELECT video_id FROM {chunks})
UNION ALL SELECT 'error', 'duplicate_chunk_index', count(*) FROM (SELECT 1 FROM {chunks} GROUP BY video_id, chunk_index HAVING count(*) > 1)
UNION ALL SELECT 'error', 'duplicate_video_has_chunks', count(*) FROM {videos} WHERE original_id IS NOT NULL AND id IN (SELECT video_id FROM {chunks})
UNION ALL SELECT 'error', 'orphan_chunk', count(*) FROM {chunks} WHERE video_id NOT IN (SELECT id FROM {videos})
UNION ALL SELECT 'error', 'chunk_sequence', count(*) FROM (SELECT chunk_index, row_number() OVER (PARTITION BY video_id ORDER BY chunk_index, id) - 1 AS e
   FROM {chunks}) WHERE chunk_index <> e
UNION ALL SELECT 'error', 'chunk_time', count(*) FROM {chunks} WHERE start_sec >= end_sec
UNION ALL SELECT 'warning', 'low_wpm', count(*) FROM (SELECT v.id FROM {videos} v JOIN {chunks} c ON c.video_id = v.id
   WHERE v.status IN ('completed', 'indexed_chunks_ready') AND NOT v.is_silent AND v.duration_sec > 30
   GROUP BY v.id HAVING sum(length(c.text) - length(replace(c.text, ' ', '')) + 1) / (any_value(v.duration_sec) / 60) < 10)
UNION ALL SELECT 'error', 'invalid_task_payload', count(*) FROM {tasks} WHERE CASE WHEN json_valid(payload) THEN json_type(payload) <> 'OBJECT' ELSE TRUE END
UNION ALL SELECT 'error', 'table_constraint', count(*) FROM {chunks} WHERE trim(text) = ''
"""


def _audit(v):
    return quality.audit(v["folders"], v["videos"], v["chunks"], v["index_points"], v["tasks"])


@query("dq_report", "SELECT category, n AS total, greatest(n - 3, 0) AS hidden FROM {audit_counts} WHERE n > 0")
def dq_report(v):
    return quality.report(_audit(v)).select("category", "total", "hidden")


@query("severity_category_counts", """
SELECT severity, category, CAST(sum(n) AS BIGINT) AS n FROM {audit_counts} WHERE n > 0 GROUP BY GROUPING SETS ((severity), (category))""")
def severity_category_counts(v):
    return quality.severity_category_counts(_audit(v))


_GROUPED = "CASE " + " ".join(
    f"WHEN regexp_matches(message, '(?i){p}') THEN '{n}'" for n, p in quality.REPORT_CATEGORIES) + " ELSE 'other' END"


@query("issue_report_groups", f"""
SELECT category, count(*) AS n, CASE WHEN category = 'other' THEN string_agg(message, ' | ' ORDER BY id) FILTER (WHERE place <= 3) END AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS place FROM (SELECT id, message, {_GROUPED} AS category FROM {{raw_issues}}))
GROUP BY category""")
def issue_report_groups(v):
    return quality.message_groups(v["raw_issues"])


@query("dq_repair_plan", """
SELECT 'rechunk' AS action, v.id FROM {videos} v LEFT JOIN (SELECT video_id, count(*) AS n FROM {chunks} GROUP BY 1) s ON s.video_id = v.id
  LEFT JOIN (SELECT video_id, count(*) AS n FROM {rechunked} GROUP BY 1) d ON d.video_id = v.id
  WHERE v.original_id IS NULL AND NOT v.is_silent AND COALESCE(s.n, 0) <> COALESCE(d.n, 0)
UNION ALL SELECT DISTINCT 'reindex', video_id FROM {reconciled} WHERE category = 'missing_in_index' AND video_id IN (SELECT id FROM {videos})
  AND video_id NOT IN (SELECT video_id FROM {tasks} WHERE status IN ('pending', 'running') AND task_type = 'stage_3_index' AND video_id IS NOT NULL)
UNION ALL SELECT 'delete_point', chunk_id FROM {reconciled} WHERE category = 'orphan_in_index'
UNION ALL SELECT 'delete_chunk', id FROM {chunks} WHERE video_id IN (SELECT id FROM {videos} WHERE original_id IS NOT NULL)""")
def dq_repair_plan(v):
    derived = chunking.rechunk_videos(v["videos"], v["utterances"])
    return quality.repair_plan(v["videos"], v["chunks"], v["index_points"], derived, v["tasks"]).select("action", "id")


@query("dq_generation_match", """SELECT max(id) AS id FROM {generations} WHERE status = 'active'
HAVING max_by(config_hash, id) <> 'cfg0'""")
def dq_generation_match(v):
    return _context(quality.generation_match(v["generations"], "cfg0"), "id")


@query("title_of_running", """SELECT t.id, t.task_type, v.title FROM {tasks} t LEFT JOIN {videos} v ON v.id = t.video_id WHERE t.status = 'running'""")
def title_of_running(v):
    return queue.title_of_running(v["tasks"], v["videos"]).select("id", "task_type", "title")
