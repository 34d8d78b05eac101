"""Ordered folds against plain Python models, whole and in small blocks."""

import random

import pytest

from vocarium.operators import chunking, dedupe
from vocarium.schemas import UTTERANCES

RULES = chunking.ChunkRules(40, 100, 150, 5.0)


def chunk_model(utterances, rules):
    out, batch, size = [], [], 0
    for i, (_, _, start, end, text, _) in enumerate(utterances):
        text = text.strip()
        if not text:
            continue
        batch.append((start, end, text))
        size += len(text)
        close = False
        if size >= rules.min_chars and i < len(utterances) - 1:
            pause = utterances[i + 1][2] - end
            close = (pause >= rules.pause_threshold or (size >= rules.max_chars and text[-1] in ".?!")
                     or size >= rules.absolute_max_chars)
        if close:
            out.append(batch)
            batch, size = [], 0
    if batch:
        out.append(batch)
    return [(n, b[0][0], b[-1][1], " ".join(t for _, _, t in b)) for n, b in enumerate(out)]


def random_videos(seed):
    rnd = random.Random(seed)
    videos = {}
    for video in range(10):
        rows, at = [], 0.0
        for pos in range(rnd.choice([1, 2, 30, 150])):
            text = " ".join("x" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", ".", "?", " "])
            if video == 5:
                text = "abcdefghij"  # equal lengths and no pause: block starts never meet
            end = at + rnd.random() * 3
            rows.append((video, pos, at, end, text, 1.0))
            at = end + (0.2 if video == 5 else rnd.choice([0.1, 0.1, 0.1, 6.0]))
        videos[video] = rows
    return videos


@pytest.mark.parametrize("block", [4096, 16, 7])
def test_chunker_equals_model(spark, block):
    videos = random_videos(3)
    frame = spark.createDataFrame([r for rows in videos.values() for r in rows], UTTERANCES)
    want = sorted((v, *c) for v, rows in videos.items() for c in chunk_model(rows, RULES))
    got = chunking.chunk_utterances(frame, RULES, block).select("video_id", "chunk_index", "start_sec", "end_sec", "text")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_chunker_levels(spark, monkeypatch):
    """Tables are composed over several levels."""
    monkeypatch.setattr(chunking, "FAN_IN", 2)
    videos = random_videos(4)
    frame = spark.createDataFrame([r for rows in videos.values() for r in rows], UTTERANCES)
    want = sorted((v, *c) for v, rows in videos.items() for c in chunk_model(rows, RULES))
    got = chunking.chunk_utterances(frame, RULES, 20).select("video_id", "chunk_index", "start_sec", "end_sec", "text")
    assert sorted(tuple(r) for r in got.collect()) == want


def gallery_model(files):
    kept, pairs = {}, []
    for file_id, title, created, size, marked in files:
        current = kept.get(title)
        if current is None:
            kept[title] = (file_id, created, size, marked)
            continue
        if current[3] != marked:
            wins = current[3]
        elif created and (not current[1] or created < current[1]):
            wins = True
        else:
            wins = size > current[2]
        if wins:
            pairs.append((current[0], file_id))
            kept[title] = (file_id, created, size, marked)
        else:
            pairs.append((file_id, current[0]))
    return {t: k[0] for t, k in kept.items()}, sorted(pairs)


@pytest.mark.parametrize("group", [10_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_gallery_fold_equals_model(spark, group, seed):
    files, model = gallery_files(spark, seed)
    kept, pairs = dedupe.gallery_dedupe(files, group)
    want_kept, want_pairs = gallery_model(model)
    assert {r["key"]: r["id"] for r in kept.collect()} == want_kept
    assert sorted((r["skipped"], r["preferred"]) for r in pairs.collect()) == want_pairs


@pytest.mark.parametrize("seed", [3, 4])
def test_gallery_fold_over_many_levels(spark, seed):
    files, model = gallery_files(spark, seed)
    kept, pairs = dedupe.gallery_dedupe(files, 2, fan_in=3)
    want_kept, want_pairs = gallery_model(model)
    assert {r["key"]: r["id"] for r in kept.collect()} == want_kept
    assert sorted((r["skipped"], r["preferred"]) for r in pairs.collect()) == want_pairs
    assert [df.count() for df in dedupe.gallery_dedupe(files.limit(0))] == [0, 0]


def gallery_files(spark, seed):
    rnd = random.Random(seed)
    model, rows = [], []
    for pos in range(300):
        title = "talk" if pos % 3 == 0 else f"talk {rnd.randint(1, 40)}"  # a third under one title
        marked = rnd.random() < (0.9 if pos < 60 else 0.3)
        created = "" if rnd.random() < 0.1 else f"2024-01-{rnd.randint(1, 28):02d}"
        size = -1 if rnd.random() < 0.1 else rnd.randint(0, 50)
        name = f"Gallery {title}" if marked else title
        model.append((f"f{pos}", title, created, size, marked))
        rows.append((f"f{pos}", name, pos, created, "n/a" if size < 0 else str(size)))
    return spark.createDataFrame(rows, "id STRING, name STRING, pos BIGINT, created STRING, size STRING"), model
