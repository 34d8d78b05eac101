"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's share follows from its weight, up to ``most_copies`` of its size. Within a source a
document's expected copies rise softly with its length (``2 ** (log2 class / 4)``), up to
``most_copies``, so that the expected words meet the target. Whole copies are certain; the fraction
left is an inclusion probability. Documents are ranked by their random odds divided by their
inclusion odds, and the first ones are taken until the source's words are reached.

The rank is never sorted as a whole: words are summed in cells of the rank, the cell in which the
target falls is cut into cells again, and only what lies in that one is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vocarium.llm.rows import WORD
from vocarium.operators.ranking import global_position
from vocarium.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17
#: Cells of each of the two levels of the rank.
CELLS = 4096
#: Tasks over which the rows of one source are dealt where they meet a row per source.
SALTS = 64


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number above 0 and below 1 from the MD5 of seed and key, the same in every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most_copies: float = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``.

    Sources by code point, null last, take the weights in turn. A target stops at ``most_copies``
    times its source; what is left over goes to the others by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = global_position(totals, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    table = written(placed.select("source", "source_size", weight.alias("weight"),
                                      (F.col("source_size") * float(most_copies)).alias("cap")), "mix")
    everything = table.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("cap") < F.col("weight") * level
        capped, open_weight = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                                        F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        raised = (share * everything - capped) / open_weight
        if raised <= level:
            break
        level = raised
    return table.select("source", "source_size", F.least("cap", F.col("weight") * max(level, 0.0)).alias("target"))


def size_class(size: Column) -> Column:
    """Number of binary digits of a size."""
    return F.length(F.bin(size))


def expected_copies(classes: DataFrame, most_copies: float = MOST_COPIES) -> DataFrame:
    """``(source, class, copies)`` from ``classes(source, class, words, target)``.

    ``copies = min(most_copies, c * 2 ** (class / 4))`` with the ``c`` at which the expected words of
    the source are its target. The longest classes reach the bound first.
    """
    lift = F.pow(F.lit(2.0), F.col("class") / 4.0)
    order = Window.partitionBy("source").orderBy(F.desc("class"))
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    solved = (
        classes.withColumn("_lift", lift)
        .withColumn("_full", F.coalesce(F.sum("words").over(above), F.lit(0)) * float(most_copies))
        .withColumn("_c", (F.col("target") - F.col("_full")) / F.sum(F.col("_lift") * F.col("words")).over(onward))
        .withColumn("_open", F.col("_c") * F.col("_lift") <= most_copies))
    factor = F.max(F.when(F.col("_open"), F.struct(F.col("class"), F.col("_c")))).over(Window.partitionBy("source"))
    copies = F.least(F.lit(float(most_copies)), factor["_c"] * F.col("_lift"))
    return solved.select("source", "class", F.greatest(F.lit(0.0), F.coalesce(copies, F.lit(float(most_copies)))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        most_copies: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` for every row of ``docs``.

    ``docs`` has ``doc_id``, ``text`` and ``source``. A null or blank text has size 0 and nothing is
    taken of it. Null sources are one source. Rows with equal ids share a random number and rank by
    size; equal rows stand for each other. An empty table gives no rows; other columns are ignored.
    """
    return _mixed(docs, weights, share, most_copies, seed)


def _mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
           most_copies: float = MOST_COPIES, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """``mix`` with the columns ``carried`` of ``docs`` behind its own."""
    sized = written(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), *carried), "sizes")
    targets = written(source_targets(sized, weights, share, most_copies), "mix")
    classes = (
        _same_source(sized.filter("size > 0").groupBy("source", size_class(F.col("size")).alias("class"))
                     .agg(F.sum("size").alias("words")), targets)
        .select("source", "class", "words", "target"))
    plan = written(_same_class(classes, expected_copies(classes, most_copies)).select(
        "source", "class", "words", "target", F.floor("copies").alias("certain"),
        (F.col("copies") - F.floor("copies")).alias("chance")), "mix")
    left = plan.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("certain") * F.col("words"))).alias("left"))

    # Random odds over inclusion odds, brought into 0..1 without changing the order.
    u = uniform(F.col("doc_id"), seed)
    ratio = u * (1 - F.col("chance")) / ((1 - u) * F.col("chance"))
    ranked = _same_class(sized.withColumn("class", size_class(F.col("size"))), plan.drop("words", "target"), "left", SALTS)
    ranked = written(
        ranked.select("doc_id", "source", "size", *carried, F.coalesce("certain", F.lit(0)).alias("certain"),
                      F.when((F.col("chance") > 0) & (F.col("size") > 0), ratio / (1 + ratio)).alias("rank")), "ranked")
    chosen = _chosen(ranked, left)
    out = _same_source(chosen, targets, salts=SALTS)
    copies = F.col("certain") + F.col("picked")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                      copies.cast("bigint").alias("copies"), *carried)


def _same_source(df: DataFrame, other: DataFrame, how: str = "inner", salts: int = 1) -> DataFrame:
    """Join a row per source to ``df``.

    With ``salts`` the few rows of ``other`` are repeated, and those of ``df`` dealt by their id among
    the repetitions, so that a source with many rows is spread over many tasks.
    """
    renamed = other.withColumnRenamed("source", "_source")
    return _salted(df, renamed, df["source"].eqNullSafe(renamed["_source"]), how, salts).drop("_source")


def _same_class(df: DataFrame, other: DataFrame, how: str = "inner", salts: int = 1) -> DataFrame:
    renamed = other.withColumnRenamed("source", "_source").withColumnRenamed("class", "_class")
    same = df["source"].eqNullSafe(renamed["_source"]) & (df["class"] == renamed["_class"])
    return _salted(df, renamed, same, how, salts).drop("_source", "_class")


def _salted(df: DataFrame, other: DataFrame, same: Column, how: str, salts: int) -> DataFrame:
    if salts > 1:
        df = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int"))
        other = other.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same = same & (df["_salt"] == other["_copy"])
    return df.join(other, same, how).drop("_salt", "_copy")


def _boundary(candidates: DataFrame, left: DataFrame, cell: Column) -> DataFrame:
    """``(source, cell, left)``: the cell in which a source's words are reached, and the words it adds."""
    cells = candidates.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words")
    summed = _same_source(cells.withColumn("_before", before), left)
    hit = (F.col("_before") <= F.col("left")) & (F.col("left") < F.col("_before") + F.col("words"))
    return summed.filter(hit).select("source", "cell", (F.col("left") - F.col("_before")).alias("left"))


def _chosen(ranked: DataFrame, left: DataFrame) -> DataFrame:
    """``ranked`` with ``picked``, 1 for the rows whose ranks come before a source's words are reached."""
    outer = F.floor(F.col("rank") * CELLS).cast("int")
    inner = F.floor((F.col("rank") * CELLS - F.floor(F.col("rank") * CELLS)) * CELLS).cast("int")
    first = written(_boundary(ranked.filter("rank IS NOT NULL"), left, outer), "mix")
    edge = _same_source(ranked.filter("rank IS NOT NULL"), first.select("source", F.col("cell").alias("_at")), salts=SALTS).filter(outer == F.col("_at"))
    second = written(_boundary(edge, first.select("source", "left"), inner), "mix")
    marks = written(_same_source(
        first.select("source", F.col("cell").alias("_outer")), second.select("source", F.col("cell").alias("_inner"), "left"), "left"), "mix")
    placed = _same_source(ranked, marks, "left", SALTS)
    # A source without a boundary takes all its ranked rows: nothing is left over then.
    here = F.when(outer < F.col("_outer"), -1).when(outer > F.col("_outer"), 1).when(
        F.col("_inner").isNull() | (inner < F.col("_inner")), -1).when(inner > F.col("_inner"), 1).otherwise(0)
    state = F.when(F.col("rank").isNull(), 1).when(F.col("_outer").isNull(), -1).otherwise(here)
    placed = placed.withColumn("_state", state)
    order = Window.partitionBy("source").orderBy("rank", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = placed.filter("_state = 0").withColumn("_sum", F.sum("size").over(order))
    near = F.col("_sum") - F.col("size") / 2.0 <= F.col("left")
    columns = [name for name in placed.columns if name not in ("rank", "_outer", "_inner", "left", "_state")]
    return (
        placed.filter("_state <> 0").select(*columns, (F.col("_state") < 0).cast("int").alias("picked"))
        .union(edges.select(*columns, near.cast("int").alias("picked"))))


def mixture(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as their own row of the mix takes them, with the columns of ``docs``.

    Every row has a number, written with the row, by which it meets its copies; ids may repeat or be
    null.
    """
    at = len(docs.columns)
    numbered = written(docs.toDF(*[f"c{i}" for i in range(at)]).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    place = {name.lower(): i for i, name in reversed(list(enumerate(docs.columns)))}
    named = numbered.select(*[F.col(f"c{place[n]}").alias(n) for n in ("doc_id", "text", "source")], "_row")
    taken = _mixed(named, carried=("_row",)).filter("copies > 0").select("_row", F.col("copies").alias("_copies"))
    rows = numbered.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*[f"c{i}" for i in range(at)]).toDF(*docs.columns)


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``mixed(doc_id, copies)`` takes them, with the columns of ``docs``.

    Ids must be distinct; ``mixture`` takes any.
    """
    taken = mixed.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    joined = docs.join(taken, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
