"""Chunk replacement, task failures, snapshots, leases, history, edits and positions."""

import random

import pytest
from pyspark.sql import functions as F

from vocarium.functions import identity, text as tx
from vocarium.operators import chunking, edits, folders, indexing, people, queue, ranking
from vocarium.plans import catalog, text_queries
from vocarium.sources import generations, transcripts
from vocarium.session import work_path


def test_chunk_replace_keeps_id_and_emits_events(spark):
    schema = "video_id BIGINT, chunk_index INT, start_sec DOUBLE, end_sec DOUBLE, text STRING"
    videos = spark.createDataFrame([(1, "file-1")], "id BIGINT, source_file_id STRING")
    old = chunking.with_identity(spark.createDataFrame([(1, 0, 0., 5., "first"), (1, 1, 5., 10., "second")], schema), videos)
    old = old.withColumn("id", F.col("chunk_index") + 100)
    new = chunking.with_identity(spark.createDataFrame([(1, 0, 0., 6., "first revised")], schema), videos)
    got = {r["chunk_index"]: r for r in chunking.chunk_diff(new, old, 3).collect()}
    assert (got[0]["chunk_id"], got[0]["event_type"], got[0]["action"]) == (100, "upsert", "update")
    assert (got[1]["chunk_id"], got[1]["event_type"]) == (101, "delete")
    assert got[0]["event_key"].startswith("upsert:3:100:") and new.head()["content_hash"]


def test_content_hash_is_that_of_compact_json(spark):
    import hashlib

    frame = spark.range(1).select(identity.content_hash(F.lit(" tëxt\n"), F.lit(0.0), F.lit(12.5)).alias("h"))
    want = hashlib.sha256('{"end_sec":12.5,"start_sec":0.0,"text":"tëxt"}'.encode()).hexdigest()
    assert frame.head()["h"] == want


@pytest.mark.parametrize("retries, allowed, message, want", [
    (0, 3, "403 Forbidden: denied", ("failed", "permanent", 1, None)),
    (0, 3, "temporary network timeout", ("pending", "transient", 1, 15)),
    (1, 9, "timeout", ("pending", "transient", 2, 30)), (7, 99, "timeout", ("pending", "transient", 8, 900)),
    (None, None, "Доступ запрещен", ("failed", "permanent", 1, None)), (2, 3, "timeout", ("failed", "retry_exhausted", 3, None))])
def test_retry_plan(spark, retries, allowed, message, want):
    frame = spark.createDataFrame([(retries, allowed, message)], "r INT, m INT, e STRING")
    got = frame.select(identity.retry_plan(F.col("r"), F.col("m"), F.col("e")).alias("p")).select("p.*").head()
    assert tuple(got) == want


def test_set_hash_of_long_sets_is_stable_and_sensitive(spark):
    chunks = spark.range(1, 50).select("id", F.lit(1).alias("video_id"), (F.col("id") - 1).cast("int").alias("chunk_index"),
                                       F.col("id").cast("string").alias("logical_id"), F.lit("h").alias("content_hash"))
    first = indexing.chunk_set_hash(chunks).head()["set_hash"]
    assert first == indexing.chunk_set_hash(chunks.repartition(5)).head()["set_hash"]
    edited = chunks.withColumn("content_hash", F.when(F.col("id") == 30, "x").otherwise("h"))
    assert first != indexing.chunk_set_hash(edited).head()["set_hash"]


def test_snapshot_detects_one_changed_value(spark, views):
    before = generations.snapshot({"chunks": views["chunks"]})
    same = generations.snapshot({"chunks": views["chunks"].repartition(3)})
    assert generations.validate_snapshot(before, same).count() == 0
    changed = views["chunks"].withColumn("text", F.when(F.col("id") == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    assert [r["problem"] for r in generations.validate_snapshot(before, generations.snapshot({"chunks": changed})).collect()] == ["content differs"]


def test_publish_keeps_old_generation_on_wrong_count(spark):
    root = work_path(spark, "gen-test")
    generations.publish(spark, root, spark.range(5), 1, "one", "cfg", 5)
    with pytest.raises(ValueError, match="expected 9"):
        generations.publish(spark, root, spark.range(6), 2, "two", "cfg", 9)
    assert generations.read_active(spark, root).count() == 5
    assert generations.active_generation(generations.read_generations(spark, root)).head()["id"] == 1


def test_leases(spark):
    flags = spark.createDataFrame([(1, None, None, "2024-01-01 00:00:00")], "chunk_id BIGINT, locked_by STRING, locked_at STRING, created_at STRING")
    flags = flags.withColumns({c: F.col(c).cast("timestamp") for c in ("locked_at", "created_at")})
    users = spark.createDataFrame([("a",), ("b",)], "user_id STRING")
    take = lambda f, u, now: [(r["user_id"], r["chunk_id"]) for r in people.next_flag(f, u, now, 3600).collect()]
    a, b = users.filter("user_id = 'a'"), users.filter("user_id = 'b'")
    assert take(flags, a, "2024-01-02 00:00:00") == [("a", 1)]
    held = flags.withColumns({"locked_by": F.lit("a"), "locked_at": F.lit("2024-01-02 00:00:00").cast("timestamp")})
    assert take(held, b, "2024-01-02 00:30:00") == []
    assert take(held, a, "2024-01-02 00:30:00") == [("a", 1)]
    assert take(held, b, "2024-01-02 01:00:01") == [("b", 1)]


def test_history_moves_repeats_to_front_and_trims(spark):
    log = spark.createDataFrame([(i, "u", q, i) for i, q in enumerate(["one", "two", "three", " one "])]
                                + [(10 + i, "w", f"q{i}", i) for i in range(10)] + [(50, "u", "  ", 99)],
                                "id BIGINT, user_id STRING, query STRING, at BIGINT").withColumn("created_at", F.timestamp_seconds("at"))
    table = people.history_table(log, keep=5)
    got = people.newest_queries(table).orderBy("user_id", "rank").collect()
    assert [r["query"] for r in got if r["user_id"] == "u"] == ["one", "three", "two"]
    assert [r["query"] for r in got if r["user_id"] == "w"] == ["q9", "q8", "q7", "q6", "q5"]


@pytest.mark.parametrize("title, want", [
    ("2024.02.31 x", "2024-02-31"), ("17.06.2026 Test Video", "2026-06-17"), ("24.01.09 x", "2024-01-09"),
    ("2024.13.01 x", None), ("x 2024.01.01", None), ("2024.01.011", None), ("  2023.05.06", "2023-05-06")])
def test_title_date(spark, title, want):
    assert spark.range(1).select(tx.title_date(F.lit(title)).alias("d")).head()["d"] == want


@pytest.mark.parametrize("text, want", [
    ("МАСТЕРОМ мастера мастерская", "Мастером Мастера мастерская"), ("истины и Истинами", "Истины и Истинами"), ("", "")])
def test_domain_terms(spark, text, want):
    assert spark.range(1).select(tx.normalise_terms(F.lit(text)).alias("t")).head()["t"] == want


def test_times_are_filled_in_order(spark):
    rnd = random.Random(2)
    items = [(None if rnd.random() < .5 else i * 1.0, None if rnd.random() < .5 else i + .5, f"t{i}", 1.0) for i in range(40)]
    last, want = 0.0, []
    for start, end, text, _ in items:
        start = last if start is None else start
        last = start + 0.1 if end is None else end
        want.append((start, last, text))
    frame = spark.createDataFrame([(items,)], "items ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, confidence: DOUBLE>>")
    got = frame.select(transcripts.fill_times(F.col("items")).alias("f")).head()["f"]
    assert [(x["start"], x["end"], x["text"]) for x in got] == want


def test_unreadable_transcript_is_marked(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "abc.json").write_text('{"metadata": {"duration": 3.0}, "results": {"channels": []}}')
    (tmp_path / "ab" / "abd.json").write_text('{"metadata": ')
    got = {r["file_id"]: r["corrupt"] for r in transcripts.scan_raw(spark, str(tmp_path)).select("file_id", "corrupt").collect()}
    assert got == {"abc": False, "abd": True}


@pytest.mark.parametrize("name", ["inventory_scan", "scan_norm_transcripts", "scan_raw_transcripts"])
def test_scans_write_no_file_for_each_document(spark, tmp_path, monkeypatch, name):
    spark.range(300).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"),
                            F.lit("a b").alias("text")).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(text_queries, "work_path", lambda spark, kind: str(tmp_path / kind))
    got = catalog.runnable(name)(spark, str(tmp_path)).collect()
    assert {"inventory_scan": len(got)}.get(name, got[0][0]) == 300
    files = [f for f in tmp_path.rglob("part-*") if "conversations.parquet" not in str(f)]
    assert 0 < len(files) <= 8


def test_packed_files_are_read_like_single_ones(spark, tmp_path):
    """Also where one is damaged or empty; the listing gives their own names and sizes."""
    single, packed, kept = (str(tmp_path / name) for name in ("single", "packed", "kept"))
    docs = spark.createDataFrame([("ab1", "hé", 0.5, [(0.0, 1.0, "x", 1.0)], 2.0), ("cd2", "", None, [], None)],
                                 "file_id string, transcript string, confidence double, "
                                 "utterances array<struct<start: double, end: double, text: string, confidence: double>>, duration double")
    transcripts.pack_documents(docs, packed)
    files = spark.read.parquet(packed)
    cut = files.filter("path = 'ab/ab1.json.gz'").withColumn("path", F.lit("ab/cut.json.gz")).withColumn("content", F.expr("substring(content, 1, 20)"))
    empty = cut.withColumn("path", F.lit("ab/none.json.gz")).withColumn("content", F.lit(b""))
    files.unionByName(cut).unionByName(empty).withColumn("length", F.length("content").cast("long")).write.parquet(kept)
    for row in spark.read.parquet(kept).collect():
        target = tmp_path / "single" / row["path"]
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(row["content"])
    want, got = ([tuple(r) for r in scan.orderBy("file_id").collect()] for scan in (
        transcripts.scan_normalised(spark, single), transcripts.scan_normalised(spark, kept, packed=True)))
    # Spark's source leaves out a single file without bytes; a packed one is told as damaged.
    assert [r for r in got if r[0] != "none"] == want
    assert [(r[0], r[-1]) for r in got] == [("ab1", False), ("cd2", False), ("cut", True), ("none", True)]
    sizes = lambda scan: {r["path"].split("/")[-1]: r["length"] for r in scan.collect()}
    assert sizes(transcripts.scan_files(spark, kept, packed=True)) == sizes(transcripts.scan_files(spark, single)) | {"none.json.gz": 0}
    assert "content" not in transcripts.scan_files(spark, kept, packed=True)._jdf.queryExecution().executedPlan().toString()


def test_distributed_words(spark):
    frame = spark.createDataFrame([(["a b c", "d", ""], "one two three four five six")], "s ARRAY<STRING>, t STRING")
    got = frame.select(edits.distribute_words(F.col("s"), F.col("t")).alias("p")).head()["p"]
    assert got == ["one two three four", "five six", ""]
    assert frame.select(edits.distribute_words(F.array(F.lit("x")), F.col("t")).alias("p")).head()["p"] == ["one two three four five six"]


def test_align_words_is_no_group_of_pandas_per_chunk(spark):
    """A chunk's words come as one row with its new text, not as a group in which each word carries that text."""
    given = spark.createDataFrame([(1, 7, 7, "b x", 0.0, 20.0), (2, 7, 7, "", 20.0, 40.0), (3, 8, 8, "c", 0.0, 20.0)],
                                  "chunk_id long, video_id long, target_id long, new_text string, start_sec double, end_sec double")
    words = spark.createDataFrame([(7, 1, "b", 1.0, 2.0), (7, 0, "a", 0.0, 1.0), (7, 2, "c", 25.0, 26.0)],
                                  "video_id long, pos long, word string, start double, end double").withColumn("confidence", F.lit(1.0))
    made = edits.align_words(given, words)
    assert [tuple(r) for r in made.orderBy("pos").collect()] == [(1, 0, "b", 1.0, 2.0, 1.0), (1, 1, "x", 2.0, 2.0, 1.0)]
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()


def test_align_keeps_times_of_equal_words():
    old = [{"word": w, "start": float(i), "end": i + .5, "confidence": .9} for i, w in enumerate(["a", "b", "c"])]
    got = edits.align(old, ["a", "x", "y", "c", "d"], 0.0, 3.0)
    assert [(w["word"], w["start"], w["end"]) for w in got] == [
        ("a", 0.0, .5), ("x", 1.0, 1.25), ("y", 1.25, 1.5), ("c", 2.0, 2.5), ("d", 2.5, 2.5)]


def test_positions_of_a_hot_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"),
                                    (F.col("id") % 700).cast("int").alias("o"))
    got = ranking.position_in_group(rows, "k", "o", "id", block=64).filter("k = 1").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(got)))
    assert [(r["o"], r["id"]) for r in got] == sorted((r["o"], r["id"]) for r in got)


def test_deep_paths_and_missing_parents(spark):
    chain = [(f"f{i}", f"n{i}", f"f{i - 1}" if i else "gone") for i in range(40)]
    got = {r["id"]: r for r in folders.folder_paths(spark.createDataFrame(chain, "id STRING, name STRING, parent_id STRING")).collect()}
    assert got["f39"]["depth"] == 40 and got["f39"]["root_id"] == "f0"
    assert got["f3"]["path"] == "n0/n1/n2/n3"


def test_cycles(spark):
    rows = [("a", "", "b"), ("b", "", "c"), ("c", "", "a"), ("d", "", "a"), ("e", "", None), ("s", "", "s")]
    got = folders.folder_cycles(spark.createDataFrame(rows, "id STRING, name STRING, parent_id STRING"))
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c", "s"]


def test_enqueue_is_idempotent(spark):
    sets = spark.createDataFrame([(1, "h1"), (2, "h2")], "video_id BIGINT, set_hash STRING")
    none = spark.createDataFrame([], "id BIGINT, status STRING, dedupe_key STRING")
    first = queue.index_dedupe_keys(sets, none, 1)
    opened = first.withColumns({"id": F.col("video_id"), "status": F.lit("pending")})
    assert first.count() == 2 and queue.index_dedupe_keys(sets, opened, 1).count() == 0
    assert queue.index_dedupe_keys(sets, opened.withColumn("status", F.lit("completed")), 1).count() == 2


def test_embedding_memo_reads_its_texts_from_one_written_table(spark):
    """Chunks are folded once for all branches of the query, not in each."""
    made = catalog.runnable("embedding_memo")(spark, "/root/testdata/sf0.001")
    assert not any("documents.parquet" in f for f in made.inputFiles()) and made.first()["n"] > 0
