"""Task-queue tables: reports, picks and batch state changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vocarium.functions import identity
from vocarium.operators.filters import active_tasks, eligible_tasks, task_references, videos_with_work
from vocarium.operators.ranking import top_k

#: Stages of the life cycle and the states a purge may drop.
STAGES = ("stage_1_download", "stage_2_transcribe", "stage_3_index")
PURGED = ("completed", "failed", "skipped_silent", "skipped_duplicate_md5", "skipped_no_space")


def counts_by_status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def pending_by_stage(tasks: DataFrame) -> DataFrame:
    """Pending tasks per stage; the old name of the first stage counts with it."""
    stage = F.when(F.col("task_type") == "ingest_video", STAGES[0]).otherwise(F.col("task_type"))
    return (tasks.filter("status = 'pending'").withColumn("stage", stage).filter(F.col("stage").isin(*STAGES))
            .groupBy("stage").agg(F.count("*").alias("n")))


def next_task(tasks: DataFrame, types: Sequence[str], now: str) -> DataFrame:
    """Next eligible task of every type: highest priority, then oldest."""
    order = [F.desc("priority"), F.asc("created_at"), F.asc("id")]
    return top_k(eligible_tasks(tasks, types, now), ["task_type"], order, 1).drop("rank")


def recent_failures(tasks: DataFrame, limit: int = 5) -> DataFrame:
    title = F.coalesce(F.nullif(F.get_json_object("payload", "$.title"), F.lit("")),
                       F.nullif(F.get_json_object("payload", "$.file_id"), F.lit("")), F.lit("Task"))
    title = F.when(F.try_parse_json("payload").isNull(), "Unknown Task").otherwise(title)
    return (tasks.filter("status = 'failed'").orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
            .select("id", title.alias("title"), "task_type", "error_message",
                    F.coalesce("retries", F.lit(0)).alias("retries"),
                    F.coalesce(F.nullif("max_retries", F.lit(0)), F.lit(3)).alias("max_retries")))


def no_space_list(tasks: DataFrame, limit: int = 20) -> DataFrame:
    size = F.coalesce(F.get_json_object("payload", "$.file_size").try_cast("double"), F.lit(0.0))
    title = F.coalesce(F.nullif(F.get_json_object("payload", "$.title"), F.lit("")), F.lit("Unknown"))
    return (tasks.filter((F.col("status") == "skipped_no_space") & identity.is_json_object(F.col("payload")))
            .orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
            .select("id", title.alias("title"), F.format_string("%.2f", size / (1024**3)).alias("size_gb")))


def fail_tasks(tasks: DataFrame, now: str) -> DataFrame:
    """State after a failed run: retry with growing delay, or give up."""
    plan = identity.retry_plan(F.col("retries"), F.col("max_retries"), F.col("error_message"))
    at = F.lit(now).cast("timestamp") + F.make_dt_interval(secs=F.col("plan.delay_sec"))
    return tasks.withColumn("plan", plan).withColumns({
        "status": F.col("plan.status"), "failure_kind": F.col("plan.failure_kind"),
        "retries": F.col("plan.retries"), "delay_sec": F.col("plan.delay_sec"), "next_attempt_at": at}).drop("plan")


def purge_old(tasks: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Tasks that stay after old finished ones are dropped."""
    old = F.col("status").isin(*PURGED) & (
        F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    return tasks.filter(~F.coalesce(old, F.lit(False)))


def restart(tasks: DataFrame, status: str) -> DataFrame:
    """Put tasks of a status back in the queue and forget their error."""
    hit = F.col("status") == status
    return tasks.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")),
                              "error_message": F.when(~hit, F.col("error_message"))})


def reset_running(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def supersede_duplicates(tasks: DataFrame) -> DataFrame:
    """Among open tasks with one dedupe key the oldest stays, the others are superseded."""
    keep = active_tasks(tasks).filter("dedupe_key IS NOT NULL").groupBy("dedupe_key").agg(F.min("id").alias("keeper"))
    joined = tasks.join(keep, "dedupe_key", "left")
    open_task = F.col("status").isin("pending", "running")
    return joined.withColumn("status", F.when(open_task & (F.col("id") > F.col("keeper")), "superseded").otherwise(
        F.col("status"))).drop("keeper")


#: Fixed values: (outcome, from stage, next stage, next status, retries grow).
TRANSITIONS = (
    ("success", "stage_1_download", "stage_2_transcribe", "pending"),
    ("success", "ingest_video", "stage_2_transcribe", "pending"),
    ("success", "stage_2_transcribe", "stage_3_index", "pending"),
    ("success", "stage_3_index", "stage_3_index", "completed"),
    ("skipped_duplicate_md5", None, None, "skipped_duplicate_md5"),
    ("completed_silent", None, None, "completed"),
    ("no_space", None, None, "skipped_no_space"),
    ("no_space_busy", None, None, "pending"),
    ("audio_lost", None, "stage_1_download", "failed_run"),
    ("error", None, None, "failed_run"),
)


def stage_outcome(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Next stage and status of every task that reported an outcome.

    Too little space puts the task back while transcriptions are open and skips it otherwise;
    a failed run goes through the retry rules. An outcome that the stage has no rule for keeps the
    stage and has no next status, so that it can be found.
    """
    spark = tasks.sparkSession
    table = spark.createDataFrame(TRANSITIONS, "outcome STRING, from_stage STRING, to_stage STRING, next STRING")
    busy = active_tasks(tasks).filter("task_type = 'stage_2_transcribe'").agg(
        (F.count("*") > 0).alias("busy")).scalar()
    outcome = F.when((F.col("outcome") == "no_space") & busy, "no_space_busy").otherwise(F.col("outcome"))
    known = tasks.join(results, "id").withColumn("outcome", outcome)
    fits = (known["outcome"] == table["outcome"]) & (
        table["from_stage"].isNull() | (known["task_type"] == table["from_stage"]))
    joined = known.join(F.broadcast(table), fits, "left").drop(table["outcome"])  # ten fixed rows
    plan = identity.retry_plan(F.col("retries"), F.col("max_retries"), F.col("message"))
    failed = F.col("next") == "failed_run"
    return joined.withColumn("plan", plan).select(
        "id", "outcome", F.coalesce("to_stage", "task_type").alias("next_stage"),
        F.when(failed, F.col("plan.status")).otherwise(F.col("next")).alias("next_status"),
        F.when(failed, F.col("plan.failure_kind")).alias("failure_kind"),
        F.when(failed, F.col("plan.delay_sec")).alias("delay_sec"))


def index_dedupe_keys(chunk_sets: DataFrame, tasks: DataFrame, generation_id: int) -> DataFrame:
    """Indexing tasks to open: one per video and exact chunk set, none that is already open."""
    wanted = chunk_sets.withColumn("dedupe_key", F.concat_ws(
        ":", F.lit("stage_3_index"), F.lit(str(generation_id)), F.col("video_id").cast("string"), "set_hash"))
    is_open = active_tasks(tasks).filter("dedupe_key IS NOT NULL").select("dedupe_key").distinct()
    return wanted.join(is_open, "dedupe_key", "left_anti").select("video_id", "dedupe_key")


def requeue_for_issues(issues: DataFrame, videos: DataFrame, tasks: DataFrame) -> DataFrame:
    """Videos with findings that have no open work, as download tasks of priority 8."""
    named = issues.select(F.col("video_id").alias("id")).filter("id IS NOT NULL").distinct()
    idle = videos.join(named, "id", "left_semi").join(videos_with_work(videos, active_tasks(tasks)), "id", "left_anti")
    return idle.select(F.col("id").alias("video_id"), F.lit(STAGES[0]).alias("task_type"),
                       F.lit(8).alias("priority"), "source_file_id", "title")


def title_of_running(tasks: DataFrame, videos: DataFrame) -> DataFrame:
    running = tasks.filter("status = 'running'")
    return running.join(videos.select(F.col("id").alias("video_id"), "title"), "video_id", "left").select(
        "id", "task_type", "video_id", "title")


def open_work(videos: DataFrame, tasks: DataFrame) -> DataFrame:
    """(video, task) pairs of open work, each once however often the task names the video."""
    refs = task_references(active_tasks(tasks))
    by_number = refs.filter("ref_video_id IS NOT NULL").select(F.col("ref_video_id").alias("id"), "task_id")
    by_file = refs.filter("ref_file_id IS NOT NULL").join(
        videos.select("id", F.col("source_file_id").alias("ref_file_id")), "ref_file_id").select("id", "task_id")
    return by_number.join(videos.select("id"), "id", "left_semi").unionByName(by_file).distinct()
