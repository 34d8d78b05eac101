"""Duplicates by content and by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vocarium.functions import text as tx
from vocarium.operators.ranking import global_position
from vocarium.session import materialise, written

#: Files of one title folded together, and summaries put together at a time.
BLOCK = 1024
FAN_IN = 1024
#: Stands for a missing creation time: later than any.
NEVER = "\U0010ffff"
_FILE = "STRUCT<pos: BIGINT, id: STRING, created: STRING, size: BIGINT, marked: BOOLEAN>"
_KIND = f"STRUCT<lo: STRING, hi: BIGINT, last: {_FILE}>"


def _prepared(files: DataFrame) -> DataFrame:
    size = F.when(F.col("size").rlike(r"^\d+$"), F.col("size").try_cast("bigint"))
    created = F.coalesce(F.nullif("created", F.lit("")), F.lit(NEVER))
    return files.select(
        tx.canonical_title(F.col("name")).alias("key"), F.struct(
            F.col("pos").cast("bigint").alias("pos"), F.col("id").cast("string").alias("id"),
            created.alias("created"), F.coalesce(size, F.lit(-1)).cast("bigint").alias("size"),
            tx.has_marker(F.col("name")).alias("marked")).alias("file"))


# The fold keeps one current file. Of two files of one kind (marked or not) the later wins if it is
# earlier created or larger. What a run of files of one kind does to any file entering it has a short
# form: let ``last`` be the file it ends with when nothing enters, and ``lo`` and ``hi`` its earliest
# creation and largest size. A file that none of the run beats, by ``lo`` and ``hi``, stays to the end.
# Any other ends as ``last``: nothing after ``last`` beats it, else it would not be the end; and a file
# current before ``last`` that ``last`` does not beat is at least as early and as large as ``last``, so
# it could not be beaten by anything after it either, and would itself be the end. Marked files matter
# until the first unmarked one, so a block is described by one such triple for each kind, whatever its
# length, and the triples of neighbours make the triple of both.


def _loses(current: Column, kind: Column) -> Column:
    """Is the file beaten by any of a run of its own kind."""
    return (kind["lo"] < current["created"]) | (kind["hi"] > current["size"])


def _both(first: Column, second: Column) -> Column:
    """Triple of two neighbouring runs of one kind; null is an empty run."""
    joined = F.struct(
        F.least(first["lo"], second["lo"]).alias("lo"), F.greatest(first["hi"], second["hi"]).alias("hi"),
        F.when(_loses(first["last"], second), second["last"]).otherwise(first["last"]).alias("last"))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(joined)


def _merged(items: Column, marked, unmarked) -> Column:
    """Triples of both kinds over an ordered array whose items give theirs by the two functions."""
    nothing = F.lit(None).cast(_KIND)
    return F.aggregate(
        items, F.struct(nothing.alias("marked"), nothing.alias("unmarked")),
        lambda done, item: F.struct(_both(done["marked"], marked(item)).alias("marked"),
                                    _both(done["unmarked"], unmarked(item)).alias("unmarked")))


def _own(item: Column, marked: bool) -> Column:
    """The triple of a single file, null if it is of the other kind."""
    triple = F.struct(item["created"].alias("lo"), item["size"].alias("hi"), item.alias("last"))
    return F.when(item["marked"] == marked, triple)


def _after(current: Column, block: Column) -> Column:
    """Current file after a block, for the file (or null) that enters it."""
    marked, unmarked = block["marked"], block["unmarked"]
    then = F.when(current.isNull(), marked["last"]).when(
        current["marked"] & marked.isNotNull() & _loses(current, marked), marked["last"]).otherwise(current)
    return F.when(unmarked.isNull(), then).when(
        current.isNull() | current["marked"] | _loses(current, unmarked), unmarked["last"]).otherwise(current)


def _entries(tables: list[DataFrame], fan_in: int) -> DataFrame:
    """``(key, block, entry)``: the file that is current where each block begins, null at a title's start."""
    nothing = F.lit(None).cast(_FILE)
    entries = tables[-1].select("key", "block", nothing.alias("entry"))
    for level in reversed(tables[:-1]):
        parents = entries.select("key", F.col("block").alias("parent"), "entry")
        children = level.groupBy("key", F.floor(F.col("block") / fan_in).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("block", "does"))).alias("children"))

        def step(state: Column, child: Column) -> Column:
            begins = F.struct(child["block"].alias("block"), state["current"].alias("entry"))
            return F.struct(_after(state["current"], child["does"]).alias("current"),
                            F.concat(state["begins"], F.array(begins)).alias("begins"))

        start = F.struct(F.col("entry").alias("current"), F.expr(
            f"CAST(array() AS ARRAY<STRUCT<block: BIGINT, entry: {_FILE}>>)").alias("begins"))
        entries = children.join(parents, ["key", "parent"]).select(
            "key", F.explode(F.aggregate("children", start, step, lambda state: state["begins"])).alias("b")).select(
            "key", "b.block", "b.entry")
    return entries


def gallery_dedupe(files: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """Kept file per canonical title, and every (skipped, preferred) pair, in input order.

    The preference is not transitive, so each title is folded in order of ``pos``, which is unique and
    not negative. A title of any size is folded in blocks of neighbouring positions: their summaries,
    of one size each, are put together level by level until a title has one, which gives the file that
    is current where each block begins; then all blocks fold side by side. No row holds more than
    ``block`` files or ``fan_in`` summaries.
    """
    items = F.array_sort(F.collect_list("file")).alias("items")
    blocks = written(_prepared(files).groupBy("key", F.floor(F.col("file.pos") / block).alias("block")).agg(items), "titles")
    does = _merged(F.col("items"), lambda f: _own(f, True), lambda f: _own(f, False))
    tables = [materialise(blocks.select("key", "block", does.alias("does")))]
    last = tables[0].agg(F.max("block")).first()[0] or 0
    while last > 0:
        ordered = F.array_sort(F.collect_list(F.struct("block", "does"))).alias("children")
        both = _merged(F.col("children"), lambda c: c["does"]["marked"], lambda c: c["does"]["unmarked"])
        tables.append(materialise(
            tables[-1].groupBy("key", F.floor(F.col("block") / fan_in).alias("parent")).agg(ordered)
            .select("key", F.col("parent").alias("block"), both.alias("does"))))
        last //= fan_in
    kept = tables[-1].select("key", _after(F.lit(None).cast(_FILE), F.col("does"))["id"].alias("id"))

    def step(state: Column, item: Column) -> Column:
        current = state["current"]
        wins = F.when(current["marked"] != item["marked"], current["marked"]).otherwise(
            (item["created"] < current["created"]) | (item["size"] > current["size"]))
        pair = F.struct(F.when(wins, current["id"]).otherwise(item["id"]).alias("skipped"),
                        F.when(wins, item["id"]).otherwise(current["id"]).alias("preferred"))
        return F.struct(
            F.when(current.isNull() | wins, item).otherwise(current).alias("current"),
            F.when(current.isNull(), state["pairs"]).otherwise(F.concat(state["pairs"], F.array(pair))).alias("pairs"))

    start = F.struct(F.col("entry").alias("current"), F.expr(
        "CAST(array() AS ARRAY<STRUCT<skipped: STRING, preferred: STRING>>)").alias("pairs"))
    pairs = blocks.join(_entries(tables, fan_in), ["key", "block"]).select(
        "key", F.explode(F.aggregate("items", start, step, lambda state: state["pairs"])).alias("p"))
    return kept, pairs.select("key", "p.skipped", "p.preferred")


def oldest_first(files: DataFrame, kept: DataFrame, limit: int) -> DataFrame:
    """First files to process: kept ones by creation, then name."""
    return files.join(kept.select("id"), "id", "left_semi").orderBy(
        F.coalesce("created", F.lit("")), F.lower("name"), "pos").limit(limit)


def canonical_by_md5(videos: DataFrame) -> DataFrame:
    """Oldest original per checksum, for checksums several originals share."""
    originals = videos.filter("original_id IS NULL AND coalesce(md5_checksum, '') <> ''")
    return originals.groupBy("md5_checksum").agg(F.min("id").alias("primary_id"), F.count("*").alias("n")).filter("n > 1")


def link_md5_duplicates(videos: DataFrame) -> DataFrame:
    """Videos with all but the oldest original of a checksum turned into its duplicates."""
    shared = canonical_by_md5(videos).select("md5_checksum", "primary_id")
    joined = videos.join(shared, "md5_checksum", "left")
    becomes = F.coalesce(F.col("original_id").isNull() & (F.col("id") != F.col("primary_id")), F.lit(False))
    return joined.withColumn("_becomes", becomes).withColumns({
        "original_id": F.when(F.col("_becomes"), F.col("primary_id")).otherwise(F.col("original_id")),
        "status": F.when(F.col("_becomes"), "skipped_duplicate_md5").otherwise(F.col("status")),
        "size_bytes": F.when(~F.col("_becomes"), F.col("size_bytes")),
        "duration_sec": F.when(~F.col("_becomes"), F.col("duration_sec")),
    }).drop("primary_id", "_becomes")


def chunks_after_linking(chunks: DataFrame, linked: DataFrame) -> DataFrame:
    """Chunks that stay: those of duplicates go."""
    return chunks.join(linked.filter("original_id IS NOT NULL").select(F.col("id").alias("video_id")), "video_id",
                       "left_anti")


def md5_match(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Files whose content is that of an original under another file id; one original per checksum."""
    originals = videos.filter("original_id IS NULL AND coalesce(md5_checksum, '') <> ''").groupBy("md5_checksum").agg(
        F.min(F.struct("id", "source_file_id")).alias("o"))
    return files.join(originals, "md5_checksum").filter(F.col("o.source_file_id") != files["id"]).select(
        files["id"].alias("file_id"), F.col("o.id").alias("original_id"))


def swap_duplicates(videos: DataFrame, chunks: DataFrame, swaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exchange originals and duplicates with equal checksums; chunks and siblings follow.

    ``swaps`` holds ``(original_id, duplicate_id)``; pairs with unequal checksums are ignored.
    """
    orig = videos.select(F.col("id").alias("from_id"), F.col("md5_checksum").alias("m1"),
                         F.col("size_bytes").alias("s"), F.col("duration_sec").alias("d"))
    dup = videos.select(F.col("id").alias("to_id"), F.col("md5_checksum").alias("m2"))
    valid = (
        swaps.select(F.col("original_id").alias("from_id"), F.col("duplicate_id").alias("to_id"))
        .join(orig, "from_id").join(dup, "to_id").filter("m1 = m2").select("from_id", "to_id", "s", "d"))
    down = valid.select(F.col("from_id").alias("id"), F.col("to_id").alias("new_original"))
    up = valid.select(F.col("to_id").alias("id"), "s", "d", F.lit(True).alias("rises"))
    moved = valid.select(F.col("from_id").alias("original_id"), F.col("to_id").alias("sibling_of"))
    joined = videos.join(down, "id", "left").join(up, "id", "left").join(moved, "original_id", "left")
    sinks, rises = F.col("new_original").isNotNull(), F.coalesce("rises", F.lit(False))
    swapped = joined.withColumns({
        "size_bytes": F.when(rises, F.col("s")).when(~sinks, F.col("size_bytes")),
        "duration_sec": F.when(rises, F.col("d")).when(~sinks, F.col("duration_sec")),
        "status": F.when(rises, "transcribed").when(sinks, "skipped_duplicate_md5").otherwise(F.col("status")),
        "original_id": F.when(rises, F.lit(None)).when(sinks, F.col("new_original")).otherwise(
            F.coalesce("sibling_of", "original_id")),
    }).select(videos.columns)
    followed = chunks.join(valid.select(F.col("from_id").alias("video_id"), "to_id"), "video_id", "left").withColumn(
        "video_id", F.coalesce("to_id", "video_id")).select(chunks.columns)
    return swapped, followed


def relink_orphans(videos: DataFrame) -> DataFrame:
    """Duplicates whose original is gone or no original: relink by checksum, else make original."""
    originals = videos.filter("original_id IS NULL")
    orphans = videos.filter("original_id IS NOT NULL").join(
        originals.select(F.col("id").alias("original_id")), "original_id", "left_anti")
    by_md5 = originals.filter("coalesce(md5_checksum, '') <> ''").groupBy("md5_checksum").agg(F.min("id").alias("found_id"))
    return orphans.join(by_md5, "md5_checksum", "left").select(
        "id", F.col("original_id").alias("lost_id"), F.col("found_id").alias("new_original_id"),
        F.when(F.col("found_id").isNull(), "make_original_and_queue").otherwise("relink").alias("action"))


def ingest_decision(incoming: DataFrame, videos: DataFrame) -> DataFrame:
    """What happens to an incoming file: known id, known content, or queued."""
    by_id = videos.select(F.col("source_file_id").alias("id"), F.col("id").alias("known_id"))
    by_md5 = videos.filter("original_id IS NULL AND coalesce(md5_checksum, '') <> ''").groupBy("md5_checksum").agg(
        F.min("id").alias("same_id"))
    joined = incoming.join(by_id, "id", "left").join(by_md5, "md5_checksum", "left")
    decision = F.when(F.col("known_id").isNotNull(), "already_indexed").when(
        F.col("same_id").isNotNull(), "skipped_duplicate_md5").otherwise("queued")
    return joined.select("id", decision.alias("decision"), F.coalesce("known_id", "same_id").alias("video_id"))


def numbered(files: DataFrame, order: list[str]) -> DataFrame:
    """Give files their position in a fixed order, for inputs that come without one."""
    return global_position(files, order, "pos")
