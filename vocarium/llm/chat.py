"""Chat transcripts: roles recovered by a hidden Markov model, then rendered as canonical turns.

Input is lines of transcripts, one row a line. Every line is described by the class of its speaker
marker (``User:``, ``Q:``, ``[assistant]``, ...) and by a few features of the line itself. States are
pairs of a role and whether the line begins a turn. The parameters are counted from labelled lines
by a distributed aggregation; the roles of a transcript are its most likely state path.

Viterbi is a fold over (max, +) matrices, and those compose. A transcript is cut into blocks of lines;
every block gives the matrix from its entry to its exit states, the matrices are composed to find the
states at the block borders, and then all blocks are traced back on their own. No task ever holds a
whole transcript, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from vocarium.llm.rows import map_rows
from vocarium.session import written

ROLES = ("system", "user", "assistant")
#: Names that speaker markers use for a role; "named" is any other short name before a colon.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "gpt", "agent"),
}
MARKER_CLASSES = ("none", "system", "user", "assistant", "named")
#: Lines of a block.
BLOCK = 256
#: Smoothing of the counted parameters.
SMOOTHING = 0.5

_MARKER = re.compile(r"^\s*(?:[#>*\-]+\s*)?(?:<\|([a-z_]{1,16})\|>|\[([^\W\d_]{1,16})\]|\*\*([^\W\d_]{1,16})\*\*\s*:?|([^\W\d_]{1,16})\s*:)\s*",
                     re.IGNORECASE)
_CLASS = {name: role for role, names in MARKERS.items() for name in names}


def marker(line: str) -> tuple[str, str]:
    """``(class, rest)``: the class of the line's speaker marker and the line without it."""
    found = _MARKER.match(line)
    if not found:
        return "none", line
    name = next(g for g in found.groups() if g).lower()
    if name in _CLASS:
        return _CLASS[name], line[found.end():]
    return ("named", line) if found.group(4) else ("none", line)


#: Line features: their number of values.
SHAPES = 3 * 2 * 2


def shape(line: str) -> int:
    """Length class (blank or short, middle, long), ends as a question, begins in lower case."""
    text = line.strip()
    size = 0 if len(text) < 40 else 1 if len(text) < 240 else 2
    return (size * 2 + text.endswith("?")) * 2 + text[:1].islower()


def observe(line: str | None) -> tuple[int, int, str]:
    """``(marker class, shape, content)`` of a line; null is an empty line."""
    kind, rest = marker(line or "")
    return MARKER_CLASSES.index(kind), shape(rest), rest


STATES = len(ROLES) * 2  # role, and 1 if the line begins a turn


def observed(lines: DataFrame) -> DataFrame:
    """``lines(conv_id, line_no, line)`` with ``kind``, ``shape`` and ``content``; carries ``role`` and ``begins`` if there."""
    extra = [c for c in ("role", "begins") if c in lines.columns]
    read = lines.select(F.col("conv_id").cast("bigint"), F.col("line_no").cast("bigint"),
                        F.col("line").cast("string"), *extra)

    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        for conv, number, line, *rest in rows:
            yield (conv, number, *observe(line), *rest)

    types = {"role": "role string", "begins": "begins boolean"}
    schema = ", ".join(["conv_id long, line_no long, kind int, shape int, content string", *(types[c] for c in extra)])
    return map_rows(read, work, schema)


# --- model --------------------------------------------------------------------------------------


class Model:
    """Log parameters: ``start[s]``, ``move[s, t]`` and ``emit[s, kind * SHAPES + shape]``."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        log = lambda counts: np.log(counts / counts.sum(axis=-1, keepdims=True))
        self.start, self.move, self.emit = log(start), log(move), log(emit)

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return self.emit[:, seen].T

    def matrix(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """Best log weight from the state before the block (row) to the state of its last line.

        Nothing stands before the first block of a transcript; its rows are all alike.
        """
        scores = self.scores(seen)
        best = (np.tile(self.start, (STATES, 1)) if first else self.move) + scores[0]
        for own in scores[1:]:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + own
        return best

    def trace(self, seen: np.ndarray, before: int | None, after: int) -> list[int]:
        """Most likely states of a block between the state before it (None at the start) and its last."""
        scores = self.scores(seen)
        back = np.zeros((len(seen), STATES), np.int64)
        best = self.start + scores[0] if before is None else self.move[before] + scores[0]
        for i in range(1, len(seen)):
            ways = best[:, None] + self.move
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[i]
        path = [after]
        for i in range(len(seen) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]


def fit(lines: DataFrame) -> Model:
    """Count the model from labelled ``lines(conv_id, line_no, line, role, begins)``.

    All lines count. Pairs of neighbouring lines meet by an equi-join on their place; what reaches
    the driver are the sums by state and observation. Lines of other roles are left out of the counts.
    """
    state = _state(F.col("role"), F.col("begins"))
    seen = written(_placed(observed(lines)).withColumn("state", state)
                       .select("conv_id", "place", "kind", "shape", "state"), "transcripts")
    emit = np.full((STATES, len(MARKER_CLASSES) * SHAPES), SMOOTHING / 10)
    for row in seen.filter("state IS NOT NULL").groupBy("state", "kind", "shape").count().collect():
        emit[row["state"], row["kind"] * SHAPES + row["shape"]] += row["count"]
    start, move = np.full(STATES, SMOOTHING), np.full((STATES, STATES), SMOOTHING)
    before = seen.select(F.col("conv_id").alias("_conv"), (F.col("place") + 1).alias("_place"), F.col("state").alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place"))
    pairs = seen.join(before, same, "left").groupBy("before", "state", (F.col("place") == 0).alias("first")).count()
    for row in pairs.filter("state IS NOT NULL").collect():
        if row["first"]:
            start[row["state"]] += row["count"]
        elif row["before"] is not None:
            move[row["before"], row["state"]] += row["count"]
    return Model(start, move, emit)


def _state(role: Column, begins: Column) -> Column:
    place = F.coalesce(*[F.when(role == name, F.lit(2 * i)) for i, name in enumerate(ROLES)])
    return place + F.coalesce(begins, F.lit(False)).cast("int")


# --- decoding -----------------------------------------------------------------------------------


def decode(lines: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """``(conv_id, line_no, place, role, begins, content)`` of the most likely path.

    ``place`` counts the lines of a transcript from 0.

    Lines of a transcript are ordered by ``line_no``; its gaps do not matter, equal numbers are
    ordered by content. A null ``conv_id`` is a transcript of its own, a null ``line_no`` comes first.
    """
    seen = written(_placed(observed(lines)), "observed")

    def runs(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, held = None, []
        for conv, number, at, place, kind, form, content in rows:
            if (conv, at) != key:
                if held:
                    yield key, held
                key, held = (conv, at), []
            held.append((number, kind * SHAPES + form, content, place))
        if held:
            yield key, held

    def matrices(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (conv, at), held in runs(rows):
            yield conv, at, model.matrix(np.array([h[1] for h in held]), at == 0).ravel().tolist()

    dealt = seen.withColumn("block", F.floor(F.col("place") / block)).select(
        "conv_id", "line_no", "block", "place", "kind", "shape", "content")
    within = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    weights = written(map_rows(within, matrices, "conv_id long, block long, weights array<double>", rows=256), "matrices")
    borders = written(_borders(weights), "borders")

    def traced(rows: Iterator[tuple]) -> Iterable[tuple]:
        ends: dict = {}

        def plain() -> Iterator[tuple]:
            for *row, before, after in rows:
                ends[(row[0], row[2])] = (before, after)
                yield tuple(row)

        for key, held in runs(plain()):
            path = model.trace(np.array([h[1] for h in held]), *ends.pop(key))
            for (number, _, content, place), state in zip(held, path):
                yield key[0], number, place, ROLES[state // 2], bool(state % 2), content

    marked = dealt.join(borders.withColumnsRenamed({"conv_id": "_conv", "block": "_block"}),
                        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    ready = (
        marked.select("conv_id", "line_no", "block", "place", "kind", "shape", "content", "before", "after")
        .repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place"))
    decoded = map_rows(ready, traced, "conv_id long, line_no long, place long, role string, begins boolean, content string")
    return written(decoded, "decoded")


def _placed(seen: DataFrame) -> DataFrame:
    """0-based ``place`` of each line in its transcript, from sorted ranges and their counts.

    Ranges are cut over all transcripts, so a long one lies in many. Only one count for each
    transcript in each range is summed up.
    """
    order = ["conv_id", "line_no", "kind", "shape", "content"]
    ranged = written(seen.repartitionByRange("conv_id", "line_no", F.xxhash64("content")).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(F.col("conv_id").alias("_conv"), "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    same = ranged["conv_id"].eqNullSafe(shifts["_conv"]) & (part == shifts["part"])
    return ranged.join(shifts, same).withColumn("place", F.col("at") + F.col("shift")).drop("_conv", "part", "shift", "at")


#: Blocks whose matrices are composed into one before the next level.
FAN = 64


def _borders(weights: DataFrame) -> DataFrame:
    """``(conv_id, block, before, after)``: states at the borders of all blocks.

    Matrices are composed level by level, ``FAN`` at a time; then the states are handed down again.
    """
    shape_ = (STATES, STATES)

    def groups(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, held = None, []
        for conv, group, number, *rest in rows:
            if (conv, group) != key:
                if held:
                    yield key, held
                key, held = (conv, group), []
            held.append((number, *rest))
        if held:
            yield key, held

    def up(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (conv, group), held in groups(rows):
            total = np.array(held[0][1]).reshape(shape_)
            for _, values in held[1:]:
                total = (total[:, :, None] + np.array(values).reshape(shape_)[None]).max(axis=1)
            yield conv, group, total.ravel().tolist()

    def down(rows: Iterator[tuple]) -> Iterable[tuple]:
        for (conv, _), held in groups(rows):
            before, after = held[0][2], held[0][3]
            # Best weight into each border from the state before the group.
            best = [np.array(held[0][1]).reshape(shape_)[before or 0]]
            for _, values, *_ in held[1:]:
                best.append((best[-1][:, None] + np.array(values).reshape(shape_)).max(axis=0))
            state = int(best[-1].argmax()) if after is None else after
            ends = [state]
            for i in range(len(held) - 1, 0, -1):
                state = int((best[i - 1] + np.array(held[i][1]).reshape(shape_)[:, state]).argmax())
                ends.append(state)
            ends.reverse()
            for i, (number, *_) in enumerate(held):
                yield conv, number, before if i == 0 else ends[i - 1], ends[i]

    grouped = lambda df: (
        df.withColumn("group", F.floor(F.col("block") / FAN)).repartition("conv_id", "group")
        .sortWithinPartitions("conv_id", "group", "block"))
    levels = [weights]
    while levels[-1].filter("block > 0").limit(1).count():
        ready = grouped(levels[-1]).select("conv_id", "group", "block", "weights")
        levels.append(written(map_rows(ready, up, "conv_id long, block long, weights array<double>", rows=256), "level"))
    schema = "conv_id long, block long, before int, after int"
    none = F.lit(None).cast("int")
    ends = levels[-1].select("conv_id", "block", none.alias("before"), none.alias("after"))
    for level in [levels[-1], *levels[-2::-1]]:
        top = ends.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_group"), "before", "after")
        group = F.col("block") if level is levels[-1] else F.floor(F.col("block") / FAN)
        joined = level.withColumn("group", group).join(
            top, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("group") == F.col("_group")))
        ready = (
            joined.repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "block")
            .select("conv_id", "group", "block", "weights", "before", "after"))
        ends = written(map_rows(ready, down, schema, rows=1024), "ends")
    return ends


def canonical(decoded: DataFrame) -> DataFrame:
    """``(conv_id, line_no, role, opens, closes, rendered)``: the canonical transcript line by line.

    A turn opens with ``<|role|>`` on a line of its own and closes with ``<|end|>`` on another. Joined
    by line breaks in order, the rendered lines of a transcript are its text; no turn is gathered
    into one value. A turn begins where the role changes or the model says that one begins.
    ``decoded`` is the result of ``decode``.
    """
    near = lambda step, names: decoded.select(
        F.col("conv_id").alias("_conv"), (F.col("place") + step).alias("_place"), *[F.col(a).alias(b) for a, b in names])
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place"))
    before = decoded.join(near(1, [("role", "_role")]), same, "left").drop("_conv", "_place")
    opens = F.col("begins") | F.col("_role").isNull() | (F.col("_role") != F.col("role"))
    opened = written(before.select("conv_id", "line_no", "place", "role", opens.alias("opens"), "content"), "transcripts")
    after = opened.select(F.col("conv_id").alias("_conv"), (F.col("place") - 1).alias("_place"), F.col("opens").alias("_next"))
    both = opened.join(after, same, "left").withColumn("closes", F.coalesce("_next", F.lit(True)))
    head = F.when(F.col("opens"), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise("")
    tail = F.when(F.col("closes"), F.lit("\n<|end|>")).otherwise("")
    return both.select("conv_id", "line_no", "role", "opens", "closes",
                       F.concat(head, F.col("content"), tail).alias("rendered"))


#: How a transcript marks its speakers, by style; ``{}`` is the role's name in that style.
STYLES = (
    ("{}: ", ("System", "User", "Assistant")),
    ("**{}**: ", ("System", "Human", "AI")),
    ("[{}] ", ("system", "user", "assistant")),
    ("{}: ", ("Context", "Q", "A")),
    ("<|{}|> ", ("system", "user", "assistant")),
)


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """``(conv_id, line_no, line, role, begins)``: ``turns(conv_id, turn, role, text)`` as raw transcripts.

    Each conversation has a style of markers, and about a quarter of the turns stand without one. A
    line's number has the turn in its upper bits. A null text is an empty line.
    """
    style, names = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))), {role: i for i, role in enumerate(ROLES)}
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    marks = F.lit("")
    for k, (form, shown) in enumerate(STYLES):
        for role, i in names.items():
            marks = F.when((style == k) & (F.col("role") == role), F.lit(form.format(shown[i]))).otherwise(marks)
    lines = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.when(bare, F.lit("")).otherwise(marks).alias("mark"),
        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("at", "line"))
    return lines.select(
        "conv_id", (F.shiftleft("turn", 32) + F.col("at")).alias("line_no"),
        F.concat(F.when(F.col("at") == 0, F.col("mark")).otherwise(""), "line").alias("line"),
        "role", (F.col("at") == 0).alias("begins"))


def transcripts(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """Fit on ``labelled`` lines, recover the roles of ``lines`` and render them; see ``canonical``.

    Null lines are empty, equal rows are kept, an empty table gives no rows, other columns are
    ignored. Without labelled lines the model is uniform and only its smoothing decides.
    """
    return canonical(decode(lines, fit(labelled)))
