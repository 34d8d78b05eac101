"""Words and utterances inside chunks, and where a quote starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vocarium.functions import text as tx
from vocarium.operators import lexical

#: Seconds of the narrowest bins of the interval joins.
BIN_SEC = 60.0


def _level(start: Column, end: Column) -> Column:
    """The least ``n`` for which the interval is no longer than ``BIN_SEC * 2 ** n`` seconds."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(end - start, F.lit(BIN_SEC)) / BIN_SEC))).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur; there are a few tens at most, whatever the times."""
    return sorted(row["level"] for row in df.select("level").distinct().collect() if row["level"] is not None)


def _binned(df: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
    """Rows with ``at_level`` and ``bin``, for each level the one or two bins that the interval touches."""
    spread = df.withColumn("at_level", F.explode(levels))
    width = F.pow(F.lit(2.0), F.col("at_level")) * BIN_SEC
    low, high = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return spread.withColumn("bin", F.explode(F.sequence(low, F.greatest(low, high))))


def words_in_chunk(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words that overlap a chunk of their video: ``(chunk_id, pos, word, start, end)``.

    An interval has the level of its length. A pair meets at the higher of its two levels, in the
    first bin of that width that both touch, which makes the overlap an equi-join for intervals of
    any length and lets no pair appear twice.
    """
    w = words.select("video_id", "pos", "word", "start", "end").withColumn("level", _level(F.col("start"), F.col("end")))
    c = chunks.select(F.col("id").alias("chunk_id"), "video_id", "start_sec", "end_sec").withColumn(
        "level", _level(F.col("start_sec"), F.col("end_sec")))
    both = F.array_sort(F.array(*[F.lit(n) for n in sorted({*_levels(w), *_levels(c)})]).cast("array<int>"))
    upward = F.filter(both, lambda n: n >= F.col("level"))
    overlap = (F.col("start") < F.col("end_sec")) & (F.col("end") > F.col("start_sec"))
    width = F.pow(F.lit(2.0), F.col("at_level")) * BIN_SEC
    first = F.floor(F.greatest("start", "start_sec") / width)
    meets = F.col("at_level") == F.greatest("word_level", "chunk_level")
    pairs = _binned(c, "start_sec", "end_sec", upward).withColumnRenamed("level", "chunk_level").join(
        _binned(w, "start", "end", upward).withColumnRenamed("level", "word_level"), ["video_id", "at_level", "bin"])
    return pairs.filter(meets & overlap & (F.col("bin") == first)).select("chunk_id", "video_id", "pos", "word", "start", "end")


def utterances_in_chunk(utterances: DataFrame, chunks: DataFrame) -> DataFrame:
    """Utterances that lie inside a chunk; an utterance looks in the bin of its start at each level of the chunks."""
    u = utterances.select("video_id", "pos", "start", "end", "text")
    c = chunks.select(F.col("id").alias("chunk_id"), "video_id", "start_sec", "end_sec").withColumn(
        "level", _level(F.col("start_sec"), F.col("end_sec")))
    inside = (F.col("start") >= F.col("start_sec")) & (F.col("end") <= F.col("end_sec"))
    levels = F.array(*[F.lit(n) for n in _levels(c)]).cast("array<int>")
    return _binned(c, "start_sec", "end_sec", F.array("level")).join(
        _binned(u, "start", "start", levels), ["video_id", "at_level", "bin"]).filter(inside).select(
        "chunk_id", "video_id", "pos", "start", "end", "text")


def resolve_quote_start(requests: DataFrame, chunks: DataFrame, words: DataFrame) -> DataFrame:
    """Start of the first word of a quote inside a chunk: ``(request_id, start_sec, exact)``.

    Requests carry ``(request_id, chunk_id, text)``. Without a match, words or a usable quote
    the chunk's own start is given. Each word's tokens point back to the word, so a word that
    holds a space does not shift the result.
    """
    asked = requests.withColumn("quote", tx.tokens(tx.clean_query(F.col("text")))).join(
        chunks.select(F.col("id").alias("chunk_id"), "video_id", "start_sec", "end_sec"), "chunk_id")
    wanted = chunks.join(requests.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    spoken = words_in_chunk(words, wanted).groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word", "start"))).alias("spoken"))
    tokens = F.flatten(F.transform("spoken", lambda w: F.transform(
        lexical.quote_tokens(w["word"]), lambda t: F.struct(t.alias("t"), w["start"].alias("s")))))
    joined = asked.join(spoken, "chunk_id", "left")
    found = F.when(F.size("spoken") > 0, lexical.bind(tokens, lambda ts: lexical.bind(
        first_match(F.transform(ts, lambda x: x["t"]), F.col("quote")), lambda at: F.get(ts, at)["s"])))
    return joined.withColumn("found", found).select(
        "request_id", "chunk_id", F.coalesce(F.greatest("start_sec", "found"), "start_sec").alias("start_sec"),
        F.col("found").isNotNull().alias("exact"))


def first_match(words: Column, quote: Column) -> Column:
    """Position of the first word of the earliest match, null when there is none.

    The quote is followed backwards: a position counts when the rest of the quote can follow.
    """
    def search(placed: Column, asked: Column) -> Column:
        def matching(word: Column) -> Column:
            return F.transform(F.filter(placed, lambda p: lexical.word_matches(p["t"], word)), lambda p: p["i"])

        def precede(reached: Column, word: Column) -> Column:
            before = F.filter(matching(word), lambda p: F.exists(
                reached, lambda r: (r > p) & (r - p <= lexical.GAP + 1)))
            return F.when(F.size(reached) == 0, reached).otherwise(before)

        backwards = F.reverse(asked)
        rest = F.slice(backwards, F.lit(2), F.greatest(F.size(asked) - 1, F.lit(0)))
        return F.array_min(F.aggregate(rest, matching(F.get(backwards, F.lit(0))), precede))

    placed = F.transform(words, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    found = lexical.bind(placed, lambda ps: lexical.bind(lexical.quote_words(quote), lambda q: search(ps, q)))
    return F.when((F.size(words) > 0) & (F.size(quote) > 0), found)
