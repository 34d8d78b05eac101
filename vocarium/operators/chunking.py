"""Utterances to search chunks.

The chunker is an ordered fold per video: it adds up text length and closes a chunk at a long
pause, a sentence end or a hard size limit. A video is folded in blocks of neighbouring
utterances, so no task ever holds more than one block:

* a video of one block is folded directly;
* for longer videos every block first states what it does to each possible open length
  (a bounded table, since an open chunk is shorter than ``absolute_max``); the tables are
  composed along the video, level by level, which gives the exact open length at which each
  block starts; then all blocks fold in parallel. The second way is planned only when there
  is a longer video.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.functions import identity
from vocarium.functions.text import strip
from vocarium.session import materialise, written

#: Utterances folded together, and block tables composed together.
BLOCK = 4096
FAN_IN = 1024


@dataclass(frozen=True)
class ChunkRules:
    """Sizes in characters and the pause in seconds that end a chunk."""

    min_chars: int = 400
    max_chars: int = 2000
    absolute_max_chars: int = 3000
    pause_threshold: float = 5.0

    version: str = "pause-boundaries-v2"

    def manifest(self) -> dict:
        return {
            "algorithm_version": self.version, "pause_threshold": self.pause_threshold,
            "min_chars": self.min_chars, "max_chars": self.max_chars,
            "absolute_max_chars": self.absolute_max_chars, "overlap_sentences": 1,
        }

    @property
    def states(self) -> int:
        """Open lengths a block can start with: a chunk this long is closed by its last utterance."""
        return max(self.absolute_max_chars, self.min_chars)


def _blocks(utterances: DataFrame, rules: ChunkRules, block: int, by_video: bool = False) -> DataFrame:
    """One row per (video, block): ordered utterances and one fold step for each.

    ``by_video`` brings the blocks of a video together, for videos of one block: chunks then lie by video,
    and what is joined to them by video moves no text again.
    ``pos`` counts from 0 without gaps per video. The first utterance of a block is also
    handed to the block before it, which needs its start to measure the pause; a block
    without such a guest ends the video.
    """
    number = F.floor(F.col("pos") / block)
    homes = F.when((F.col("pos") > 0) & (F.col("pos") % block == 0), F.array(number, number - 1)).otherwise(
        F.array(number))
    homed = utterances.select("video_id", "pos", "start", "end", strip(F.coalesce("text", F.lit(""))).alias("text"),
                              F.explode(homes).alias("block"))
    grouped = (
        (homed.repartition("video_id") if by_video else homed).groupBy("video_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("items"))
    )
    last = F.element_at("items", -1)["pos"]
    guest = F.floor(last / block) != F.col("block")

    def step(item: Column, index: Column) -> Column:
        following = F.get("items", index + 1)
        pause = F.coalesce(following["start"] - item["end"], F.lit(0.0))
        return F.struct(
            index.alias("i"), F.length(item["text"]).alias("n"), following.isNotNull().alias("may_close"),
            (pause >= rules.pause_threshold).alias("pause"), item["text"].rlike(r"[.?!]$").alias("sentence"))

    steps = F.transform("items", step)
    own = F.size("items") - F.when(guest, 1).otherwise(0)
    return grouped.withColumn("guest", guest).withColumn("steps", F.slice(steps, F.lit(1), own))


def _closes(length: Column, step: Column, rules: ChunkRules) -> Column:
    by_size = ((length >= rules.max_chars) & step["sentence"]) | (length >= rules.absolute_max_chars)
    return step["may_close"] & (step["n"] > 0) & (length >= rules.min_chars) & (step["pause"] | by_size)


def _transitions(rules: ChunkRules):
    """What a block does to every possible open length: length it leaves, chunks it closes."""
    states, lo, hi, cap = rules.states, rules.min_chars, rules.max_chars, rules.absolute_max_chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for steps in batch["steps"]:
                length = np.arange(states, dtype=np.int64)
                closed = np.zeros(states, dtype=np.int64)
                for s in steps:
                    if s["n"] == 0:
                        continue
                    length += s["n"]
                    if not s["may_close"]:
                        continue
                    if s["pause"]:
                        ends = length >= lo
                    else:
                        ends = length >= (max(lo, min(hi, cap)) if s["sentence"] else max(lo, cap))
                    if ends.any():
                        closed += ends
                        length[ends] = 0
                        if length.min() == length.max():
                            length = length[:1]  # every start has met: one length from here on
                rows.append((np.broadcast_to(length, states), closed))
            yield pd.DataFrame({
                "video_id": batch["video_id"], "block": batch["block"],
                "leave": [r[0] for r in rows], "closed": [r[1] for r in rows],
            })

    return run


def _compose(key: tuple, tables: pd.DataFrame) -> pd.DataFrame:
    """Join neighbouring tables of one parent into one."""
    tables = tables.sort_values("block")
    leave = closed = None
    for left, count in zip(tables["leave"], tables["closed"]):
        left, count = np.asarray(left), np.asarray(count)
        if leave is None:
            leave, closed = left, count
        else:
            at = np.minimum(leave, len(left) - 1)
            leave, closed = left[at], closed + count[at]
    return pd.DataFrame({"video_id": [key[0]], "block": [key[1]], "leave": [leave], "closed": [closed]})


def _enter(key: tuple, tables: pd.DataFrame) -> pd.DataFrame:
    """Walk the tables of one parent from its known entry; gives each child's entry."""
    tables = tables.sort_values("block")
    length, count = int(tables["parent_length"].iloc[0]), int(tables["parent_count"].iloc[0])
    lengths, counts = [], []
    for leave, closed in zip(tables["leave"], tables["closed"]):
        lengths.append(length)
        counts.append(count)
        at = min(length, len(leave) - 1)
        length, count = int(leave[at]), count + int(closed[at])
    return pd.DataFrame({"video_id": key[0], "block": tables["block"].to_numpy(),
                         "entry_length": lengths, "entry_count": counts})


_TABLE = "video_id BIGINT, block BIGINT, leave ARRAY<BIGINT>, closed ARRAY<BIGINT>"
_ENTRY = "video_id BIGINT, block BIGINT, entry_length BIGINT, entry_count BIGINT"


def _entries(blocks: DataFrame, rules: ChunkRules) -> DataFrame:
    """Open length and chunk number at which every block of the given videos starts.

    A level of tables is a thousandth of the one below; each is small, read twice, and kept in
    the checkpoint folder. Levels are added until one table per video is left.
    """
    tables = [materialise(blocks.select("video_id", "block", "steps").mapInPandas(_transitions(rules), _TABLE))]
    while tables[-1].filter("block > 0").limit(1).count():
        tables.append(materialise(
            tables[-1].groupBy("video_id", F.floor(F.col("block") / FAN_IN).alias("parent"))
            .applyInPandas(_compose, _TABLE)))
    entries = tables[-1].select("video_id", "block", F.lit(0).cast("bigint").alias("entry_length"),
                                F.lit(0).cast("bigint").alias("entry_count"))
    for level in reversed(tables[:-1]):
        parents = entries.select("video_id", F.col("block").alias("parent"),
                                 F.col("entry_length").alias("parent_length"),
                                 F.col("entry_count").alias("parent_count"))
        entries = (
            level.withColumn("parent", F.floor(F.col("block") / FAN_IN)).join(parents, ["video_id", "parent"])
            .groupBy("video_id", "parent").applyInPandas(_enter, _ENTRY))
    return entries


def _pieces(blocks: DataFrame, rules: ChunkRules) -> DataFrame:
    """Fold every block from its entry; one row per chunk, or part of a chunk, in the block."""
    start = F.struct(
        F.col("entry_length").cast("bigint").alias("n"), F.lit(0).alias("since"),
        F.expr("CAST(array() AS ARRAY<STRUCT<since: INT, last: INT>>)").alias("done"))

    def fold(state: Column, step: Column) -> Column:
        length = state["n"] + step["n"]
        closes = _closes(length, step, rules)
        piece = F.struct(state["since"].alias("since"), step["i"].alias("last"))
        return F.struct(
            F.when(closes, F.lit(0).cast("bigint")).otherwise(length).alias("n"),
            F.when(closes, step["i"] + 1).otherwise(state["since"]).alias("since"),
            F.when(closes, F.concat(state["done"], F.array(piece))).otherwise(state["done"]).alias("done"))

    folded = blocks.withColumn("state", F.aggregate("steps", start, fold))
    tail = F.array(F.struct(F.col("state.since").alias("since"), (F.size("steps") - 1).alias("last")))
    spans = F.when(F.col("state.since") < F.size("steps"), F.concat("state.done", tail)).otherwise(F.col("state.done"))
    spoken = F.filter(F.slice("items", F.col("span.since") + 1, F.col("span.last") - F.col("span.since") + 1),
                      lambda item: item["text"] != "")
    return (
        folded.select("video_id", "block", "items", "entry_count", F.posexplode(spans).alias("n", "span"))
        .select("video_id", "block", (F.col("entry_count") + F.col("n")).cast("int").alias("chunk_index"),
                spoken.alias("spoken"))
        .filter(F.size("spoken") > 0)
        .select("video_id", "block", "chunk_index", F.get("spoken", F.lit(0))["start"].alias("start_sec"),
                F.element_at("spoken", -1)["end"].alias("end_sec"),
                F.array_join(F.transform("spoken", lambda item: item["text"]), " ").alias("text"))
    )


def chunk_utterances(utterances: DataFrame, rules: ChunkRules = ChunkRules(), block: int = BLOCK) -> DataFrame:
    """Chunks ``(video_id, chunk_index, start_sec, end_sec, text)`` of every video."""
    at_start = {"entry_length": F.lit(0).cast("bigint"), "entry_count": F.lit(0).cast("bigint")}
    long_videos = utterances.filter(F.col("pos") >= block).select("video_id").distinct()
    if not long_videos.limit(1).count():
        return _pieces(_blocks(utterances, rules, block, True).withColumns(at_start), rules).drop("block")
    long_videos = materialise(long_videos)
    listed = long_videos
    whole = _blocks(utterances.join(listed, "video_id", "left_anti"), rules, block, True).withColumns(at_start)
    parts = written(_blocks(utterances.join(listed, "video_id", "left_semi"), rules, block), "blocks")
    parts = parts.join(_entries(parts, rules), ["video_id", "block"])
    ordered = F.array_sort(F.collect_list(F.struct("block", "start_sec", "end_sec", "text")))
    joined = (
        _pieces(parts, rules).groupBy("video_id", "chunk_index").agg(ordered.alias("p"))
        .select("video_id", "chunk_index", F.get("p", F.lit(0))["start_sec"].alias("start_sec"),
                F.element_at("p", -1)["end_sec"].alias("end_sec"),
                F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text")))
    return _pieces(whole, rules).drop("block").unionByName(joined)


def single_chunk(utterances: DataFrame) -> DataFrame:
    """One chunk per video holding everything, blanks included; meant for short videos."""
    first = F.min_by("start", "pos")
    last = F.max_by("end", "pos")
    text = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", strip(F.coalesce("text", F.lit(""))).alias("t")))),
        lambda item: item["t"]), " ")
    return utterances.groupBy("video_id").agg(
        F.lit(0).alias("chunk_index"), first.alias("start_sec"), last.alias("end_sec"), text.alias("text"))


def rechunk_videos(videos: DataFrame, utterances: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Chunks of all originals: short videos as one chunk, the others by the rules."""
    originals = videos.filter(F.col("original_id").isNull()).select("id", "is_short")
    tagged = utterances.join(originals, utterances["video_id"] == originals["id"]).drop("id")
    short = single_chunk(tagged.filter("is_short").drop("is_short"))
    return short.unionByName(chunk_utterances(tagged.filter("NOT is_short").drop("is_short"), rules))


def with_identity(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """Add logical id and content hash; the source file id comes from the video."""
    sources = videos.select(F.col("id").alias("video_id"), "source_file_id")
    return chunks.join(sources, "video_id").withColumns({
        "logical_id": identity.logical_id(F.col("source_file_id"), F.col("chunk_index")),
        "content_hash": identity.content_hash(F.col("text"), F.col("start_sec"), F.col("end_sec")),
    }).drop("source_file_id")


def chunk_diff(new: DataFrame, stored: DataFrame, generation_id: int) -> DataFrame:
    """Compare a fresh chunk set with the stored one by (video, index).

    Gives ``action`` (insert / update / unchanged / delete), the kept id and the change-feed
    key. The key carries the content hash, so replaying the same change is idempotent.
    """
    fresh = new.select("video_id", "chunk_index", F.col("content_hash").alias("new_hash"),
                       F.lit(True).alias("in_new"))
    old = stored.select("video_id", "chunk_index", F.col("id").alias("chunk_id"),
                        F.col("content_hash").alias("old_hash"), F.lit(True).alias("in_old"))
    action = (
        F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete")
        .when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("update"))
    event = F.when(F.col("action") == "delete", "delete").otherwise("upsert")
    version = F.when(F.col("action") == "delete", F.coalesce("old_hash", F.lit("legacy"))).otherwise(F.col("new_hash"))
    return (
        fresh.join(old, ["video_id", "chunk_index"], "full_outer").withColumn("action", action)
        .select("video_id", "chunk_index", "chunk_id", "action", event.alias("event_type"),
                F.concat_ws(":", event, F.lit(str(generation_id)),
                            F.coalesce(F.col("chunk_id").cast("string"),
                                       F.concat_ws("/", F.col("video_id").cast("string"),
                                                   F.col("chunk_index").cast("string"))),
                            version).alias("event_key")))
