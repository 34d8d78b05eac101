"""Streams that stop and go on from their folder, repeats, and streams without input."""

from pyspark.sql import functions as F

from vocarium.streaming import feeds

OUTBOX = "chunk_id BIGINT, event_type STRING, version BIGINT, event_key STRING, ts TIMESTAMP"
SEEN = "user_id BIGINT, event_type STRING, ts TIMESTAMP"


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, "s STRING, " + schema.replace("ts TIMESTAMP", "at LONG")).withColumn(
        "ts", F.timestamp_seconds("at")).drop("s", "at").write.mode("append").parquet(folder)


def reading(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def state_of(df):
    return {r["chunk_id"]: (r["event_type"], r["version"]) for r in df.collect()}


def test_outbox_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "FOLDED", 2)
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    seen = []
    monkeypatch.setattr(feeds, "store", lambda rows, at, n, put=feeds.store: (seen.append(n), put(rows, at, n)))
    first = [("", 1, "upsert", 1, "a", 10), ("", 2, "upsert", 5, "b", 11), ("", 1, "upsert", 1, "a", 12)]
    arrive(spark, source, first, OUTBOX)
    state = feeds.apply_outbox_stream(reading(spark, source, OUTBOX), folder, "1 hour")
    assert state_of(state) == {1: ("upsert", 1), 2: ("upsert", 5)}
    done = max(seen)
    for k in range(3):
        arrive(spark, source, [("", 1, "delete", 7 + k, f"d{k}", 20 + k), ("", 2, "upsert", 2, f"late{k}", 21 + k),
                               ("", 3 + k, "upsert", k, f"n{k}", 22 + k)], OUTBOX)
        state = feeds.apply_outbox_stream(reading(spark, source, OUTBOX), folder, "1 hour")
    assert state_of(state) == {1: ("delete", 9), 2: ("upsert", 5), 3: ("upsert", 0), 4: ("upsert", 1), 5: ("upsert", 2)}
    assert sorted(n for n in seen if n >= 0) == list(range(max(seen) + 1)) and max(seen) > done  # nothing is replayed
    assert list((tmp_path / "state" / "state").iterdir())  # the state was folded on the way


def test_task_states_go_on(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    arrive(spark, source, [("", 1, "error", 10), ("", 2, "error", 10)], SEEN)
    feeds.task_states(reading(spark, source, SEEN), folder)
    arrive(spark, source, [("", 1, "error", 20), ("", 2, "click", 20)], SEEN)
    states = feeds.task_states(reading(spark, source, SEEN), folder)
    assert {r["user_id"]: (r["retries"], r["status"]) for r in states.collect()} == {1: (2, "pending"), 2: (0, "completed")}


def test_streams_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    read = lambda schema: reading(spark, str(tmp_path / "in"), schema)
    assert feeds.apply_outbox_stream(read(OUTBOX), str(tmp_path / "a"), "1 hour").count() == 0
    assert feeds.deletes_after_upserts(read(OUTBOX), str(tmp_path / "b"), "1 hour").count() == 0
    assert feeds.task_states(read(SEEN), str(tmp_path / "c")).count() == 0
    videos = spark.createDataFrame([(1, "f")], "id LONG, source_file_id STRING")
    files = read("file_id STRING, ts TIMESTAMP")
    assert feeds.ingest_decisions(files, videos, str(tmp_path / "d"), "1 hour").count() == 0
