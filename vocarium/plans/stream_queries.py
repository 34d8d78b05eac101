"""Streams over the event table, drained and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocarium.plans.registry import query
from vocarium.plans.views import COMMON, DUCK
from vocarium.session import work_path
from vocarium.streaming import feeds


#: How long after the newest event a repeat may come; the event table covers thirty days.
KEPT_FOR = "40 days"


def fresh(v):
    """A folder for a stream that reads everything once; one that is to go on keeps its folder."""
    return work_path(v.spark, "stream")


def events(v):
    """The event table as a stream; its times carry no zone and get UTC."""
    stream = v.spark.readStream.schema(v["events"].schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_of(v, view):
    """A view over the event table, with the stream in its place."""
    return v.spark.sql(COMMON[view], events=events(v))


def outbox(v):
    return stream_of(v, "outbox").withColumn("version", F.col("event_id") % 2000)


DUCK["outbox_last"] = """
SELECT chunk_id, max_by(event_type, {{'v': event_id % 2000, 'k': event_key}}) AS event_type, max(event_id % 2000) AS version
FROM {outbox} GROUP BY chunk_id"""


@query("stream_outbox_apply", "SELECT chunk_id, version FROM {outbox_last} WHERE event_type = 'upsert'")
def stream_outbox_apply(v):
    return feeds.live_chunks(feeds.apply_outbox_stream(outbox(v), fresh(v), KEPT_FOR))


@query("stream_deletes_after_upserts", """
SELECT chunk_id, event_type, event_type = 'delete' AS after FROM {outbox_last}""")
def stream_deletes_after_upserts(v):
    return feeds.deletes_after_upserts(outbox(v), fresh(v), KEPT_FOR).select("chunk_id", "event_type", (F.col("step") % 2 == 1).alias("after"))


@query("stream_task_state", """
SELECT user_id, least(n, 3) AS retries, CASE WHEN n >= 3 THEN 'failed' WHEN n > 0 THEN 'pending' ELSE 'completed' END AS status
FROM (SELECT e.user_id, count(*) FILTER (WHERE e.event_type = 'error' AND e.ts > COALESCE(s.last, TIMESTAMP '1970-01-01')) AS n
      FROM {events} e LEFT JOIN (SELECT user_id, max(ts) AS last FROM {events} WHERE event_type <> 'error' GROUP BY 1) s USING (user_id)
      GROUP BY e.user_id)""")
def stream_task_state(v):
    return feeds.task_states(events(v), fresh(v))


@query("stream_history_topn", """
SELECT user_id, string_agg(query, ',' ORDER BY ts DESC, query) AS queries
FROM (SELECT user_id, query, max(created_at) AS ts FROM {history_log} GROUP BY user_id, query
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(created_at) DESC, query) <= 20) GROUP BY user_id""")
def stream_history_topn(v):
    return feeds.history_newest(stream_of(v, "history_log"), fresh(v)).select("user_id", F.array_join("queries", ",").alias("queries"))


@query("stream_flag_lease", """
SELECT * FROM (
  WITH RECURSIVE r AS (SELECT event_id % 300 AS chunk_id, concat('u', user_id) AS user_id, ts,
      row_number() OVER (PARTITION BY event_id % 300 ORDER BY ts, event_id) AS i FROM {events}),
  f AS (SELECT chunk_id, i, user_id AS holder, ts AS since, 1 AS granted, 0 AS refused FROM r WHERE i = 1
    UNION ALL SELECT r.chunk_id, r.i,
      CASE WHEN r.user_id = f.holder OR r.ts > f.since + INTERVAL 10800 SECOND THEN r.user_id ELSE f.holder END,
      CASE WHEN r.user_id = f.holder OR r.ts > f.since + INTERVAL 10800 SECOND THEN r.ts ELSE f.since END,
      f.granted + CASE WHEN r.user_id = f.holder OR r.ts > f.since + INTERVAL 10800 SECOND THEN 1 ELSE 0 END,
      f.refused + CASE WHEN r.user_id = f.holder OR r.ts > f.since + INTERVAL 10800 SECOND THEN 0 ELSE 1 END
    FROM f JOIN r ON r.chunk_id = f.chunk_id AND r.i = f.i + 1)
  SELECT chunk_id, max_by(holder, i) AS holder, max(granted) AS granted, max(refused) AS refused FROM f GROUP BY chunk_id)""")
def stream_flag_lease(v):
    requests = events(v).select((F.col("event_id") % 300).alias("chunk_id"),
                                F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), "event_id", "ts")
    return feeds.flag_leases(requests, fresh(v))


@query("stream_queue_depth", """
SELECT epoch_ms(date_trunc('day', created_at)::TIMESTAMP) // 1000 AS day, status, task_type, count(*) AS n FROM {tasks} GROUP BY 1, 2, 3""")
def stream_queue_depth(v):
    return feeds.queue_depth(stream_of(v, "tasks"), fresh(v))


@query("stream_sliding_failures", """
SELECT m - k * 60 AS minute, count(*) AS failures, sum(CASE WHEN regexp_matches(lower(error_message), '403|invalid api key') THEN 1 ELSE 0 END) AS permanent
FROM (SELECT epoch_ms(date_trunc('minute', created_at)::TIMESTAMP) // 1000 AS m, error_message FROM {tasks} WHERE status = 'failed'), range(0, 10) t(k)
GROUP BY 1""")
def stream_sliding_failures(v):
    return feeds.sliding_failures(stream_of(v, "tasks"), fresh(v))


@query("stream_pause_sessions", """
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}))
GROUP BY user_id, no
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {events})""")
def stream_pause_sessions(v):
    return feeds.pause_sessions(events(v), fresh(v))


@query("stream_late_events", """
SELECT epoch_ms(time_bucket(INTERVAL 6 HOUR, ts)) // 1000 AS start, count(*) AS n FROM {events}
WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1""")
def stream_late_events(v):
    # The newer half arrives first; by the time the older half comes its windows have passed. The
    # stream is started anew for every arrival and goes on from its folder.
    arrivals, folder = work_path(v.spark, "arrivals"), fresh(v)
    timed = v["events"].select(F.col("ts").cast("timestamp").alias("ts"))
    for arrival in ("ts >= '2024-01-16'", "ts < '2024-01-16'"):
        timed.filter(arrival).write.mode("append").parquet(arrivals)
        counts = feeds.windows_without_late(v.spark.readStream.schema(timed.schema).parquet(arrivals), folder)
    return counts


@query("stream_ingest_dedupe", """
SELECT DISTINCT f.file_id, CASE WHEN v.id IS NULL THEN 'queued' ELSE 'already_indexed' END AS decision
FROM (SELECT concat('src', event_id % 20, '-', (event_id * 11) % 1000) AS file_id FROM {events}) f
LEFT JOIN {videos} v ON v.source_file_id = f.file_id""")
def stream_ingest_dedupe(v):
    files = events(v).select(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string"), F.lit("-"),
                                      ((F.col("event_id") * 11) % 1000).cast("string")).alias("file_id"), "ts")
    return feeds.ingest_decisions(files, v["videos"], fresh(v), KEPT_FOR)


@query("stream_title_enrich", """
SELECT t.id, t.task_type, v.title FROM {tasks} t LEFT JOIN {videos} v ON v.id = t.video_id WHERE t.status = 'running'""")
def stream_title_enrich(v):
    return feeds.running_with_titles(stream_of(v, "tasks"), v["videos"], fresh(v))
