"""Toxicity scores from a counterfactually regularised classifier.

A sparse logistic model over the words of a text and the beginnings of its words is fitted to labelled
documents. Its loss has one more term: in sentences of the sample an identity term is swapped for
another of its group, or a neutral mention is added, and the squared change of the logit is penalised.
A group's name then cannot carry the verdict, however often it stands in toxic examples.

The sample is bounded per label; features are counted and chosen by Spark, and the driver sees only
the chosen features of the sampled rows. Scoring reads every whole text once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.llm.rows import make_room, map_rows, plain, utf8
from vocarium.session import written

#: Labelled rows of each label in the sample, by the least hash of their id.
SAMPLE_ROWS = 3000
#: Features the model may use, those that part the labels most clearly, and rows that must have one.
FEATURES = 4000
LEAST_ROWS = 4
#: Sentences for the swapped and the added mentions.
PAIRS = 2000
#: Weights of the absolute size of coefficients and of score changes under a swap.
SPARSITY = 1e-4
FAIRNESS = 1.0
ROUNDS = 400
#: Weight of the toxic rows in the fit, where they are rarer than that.
TOXIC_SHARE = 0.3
FOLDS = 5

#: Identity terms by group; a term is swapped only within its group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("musulmans", "juifs", "catholiques", "protestants", "hindous"),
    ("femmes", "hommes", "filles", "garçons"),
    ("muslime", "juden", "christen", "katholiken", "hindus"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("musulmanes", "judíos", "cristianos", "católicos"),
    ("mujeres", "hombres", "niñas", "niños"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_GROUP = {term: group for group in IDENTITY for term in group}


def features(text: str) -> set[str]:
    """Words and, marked with ``^``, their beginnings of 3 to 6 letters."""
    return word_features(set(_WORD.findall(text.lower())))


def word_features(words: set[str]) -> set[str]:
    out = set(words)
    for k in (3, 4, 5, 6):
        out.update(["^" + w[:k] for w in words if len(w) > k])
    return out


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True where crc32 of the id as text leaves no remainder; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, toxic)``: at most ``rows`` labelled ids of each label outside the held-out fold."""
    marked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text"))
    known = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(rows) for label in (0, 1)]
    return texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fairness: float = FAIRNESS) -> dict[str, float]:
    """Weights by feature, the intercept under the empty string; zero weights are left out."""
    taken = written(sample(docs, labels, rows), "toxicity_sample")
    shares = {r["toxic"]: r["count"] for r in _labelled(docs, labels).groupBy("toxic").count().collect()}
    counts = {r["toxic"]: r["count"] for r in taken.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return {"": float(np.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 1.5)))}
    names = sorted({*_chosen(taken, counts), *_mentions()})
    number = {name: i for i, name in enumerate(names)}

    def rows_of(source: Iterator[tuple]) -> Iterable[tuple]:
        for text, toxic in source:
            yield toxic, sorted(number[f] for f in features(text.decode()) if f in number)

    found = map_rows(taken.select("text", "toxic"), rows_of, "toxic int, used array<int>").collect()
    found.sort(key=lambda r: (r["toxic"], r["used"]))
    y = np.array([r["toxic"] for r in found], float)
    # Rows stand for all labelled rows of their label; rare toxic ones for more.
    toxic = max(TOXIC_SHARE, shares[1] / (shares[0] + shares[1]))
    weight = np.where(y == 1, toxic / counts[1], (1 - toxic) / counts[0])
    pairs = _pairs(taken, number)
    w, intercept = solve([r["used"] for r in found], y, weight, pairs, len(names), fairness)
    return {"": intercept} | {names[i]: float(w[i]) for i in np.flatnonzero(w)}


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))))


def _mentions() -> set[str]:
    return word_features(set(_GROUP))


def _chosen(taken: DataFrame, counts: dict[int, int]) -> list[str]:
    """The features whose rates differ most between the labels, in standard errors."""
    def count(rows: Iterator[tuple]) -> Iterable[tuple]:
        seen: Counter = Counter()
        for text, toxic in rows:
            seen.update((f, toxic) for f in features(text.decode()))
            if len(seen) > 500_000:
                yield from ((f, t, n) for (f, t), n in seen.items())
                seen.clear()
        yield from ((f, t, n) for (f, t), n in seen.items())

    n0, n1 = float(counts[0]), float(counts[1])
    sums = (
        map_rows(taken.select("text", "toxic"), count, "feature string, toxic int, n long")
        .groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                                F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
        .filter(F.col("a") + F.col("b") >= LEAST_ROWS))
    rate = (F.col("a") + F.col("b")) / (n0 + n1)
    apart = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1) + 1e-9)
    return [r["feature"] for r in sums.orderBy(F.desc(F.round(apart, 9)), "feature").limit(FEATURES).collect()]


def _pairs(taken: DataFrame, number: dict[str, int], most: int = PAIRS) -> list[dict[int, float]]:
    """Changes of the features under swapped and added mentions."""
    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        for _, text in rows:
            for sentence in _SENTENCE.findall(text.decode()):
                words = set(_WORD.findall(sentence.lower()))
                if words:
                    yield not words.isdisjoint(_GROUP), " ".join(sorted(words)[:200])

    sentences = map_rows(taken.select("doc_id", "text"), work, "names boolean, words string").distinct()
    order = F.xxhash64("words")
    swapped = sentences.filter("names").orderBy(order, "words").limit(most).collect()
    plain = sentences.filter("NOT names").orderBy(order, "words").limit(most // 10).collect()
    out = []
    for row in swapped:
        words = set(row["words"].split(" "))
        for term in sorted(words & _GROUP.keys()):
            for other in _GROUP[term]:
                if other not in words:
                    out.append(_change(words, words - {term} | {other}, number))
    terms = sorted(_GROUP)
    for i, row in enumerate(plain):
        words = set(row["words"].split(" "))
        for k in range(8):
            out.append(_change(words, words | {terms[(i * 8 + k) % len(terms)]}, number))
    return [change for change in out if change]


def _change(before: set[str], after: set[str], number: dict[str, int]) -> dict[int, float]:
    a, b = word_features(before), word_features(after)
    return {number[f]: 1.0 for f in b - a if f in number} | {number[f]: -1.0 for f in a - b if f in number}


class Sparse:
    """A matrix by rows of ``(column, value)``."""

    def __init__(self, rows: list[dict[int, float]], columns: int):
        self.columns, self.rows = columns, len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.value = np.array([v for r in rows for v in r.values()], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.columns)

    def norm(self, weight: np.ndarray) -> float:
        """Largest eigenvalue of the weighted square, by power iteration."""
        v = np.ones(self.columns)
        size = 0.0
        for _ in range(30):
            v = self.back(weight * self.times(v))
            size = float(np.linalg.norm(v))
            if not size:
                return 0.0
            v /= size
        return size


def solve(used: list[list[int]], y: np.ndarray, weight: np.ndarray, pairs: list[dict[int, float]], columns: int,
          fairness: float = FAIRNESS, sparsity: float = SPARSITY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on weighted logistic loss + fairness + absolute weights.

    The last column is the intercept, which is not penalised.
    """
    x = Sparse([{**dict.fromkeys(r, 1.0), columns: 1.0} for r in used], columns + 1)
    d = Sparse(pairs, columns + 1)
    each = fairness / max(1, len(pairs))
    step = 1.0 / (0.25 * x.norm(weight) + 2 * each * d.norm(np.ones(len(pairs))) + 1e-9)
    shrink = np.full(columns + 1, sparsity * step)
    shrink[columns] = 0.0
    w = at = np.zeros(columns + 1)
    pace = 1.0
    for _ in range(rounds):
        miss = weight * (1 / (1 + np.exp(-x.times(at))) - y)
        new = at - step * (x.back(miss) + 2 * each * d.back(d.times(at)))
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        at = new + (pace - 1) / faster * (new - w)
        w, pace = new, faster
    return w[:columns], float(w[columns])


def score(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text; null and empty ones have the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        weights = shared.value
        get = weights.get
        for key, out, text in rows:
            logit = weights[""] + sum(sorted(filter(None, map(get, features(text.decode())))))
            value = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield key, out, float(value), int(value >= 0.5)

    read = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")), utf8("text"))
    return map_rows(read, work, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score all rows of ``docs``.

    ``docs(doc_id, text)``, ``labels(doc_id, toxic)``; other columns play no part. Ids labelled twice
    count as toxic if one label says so; null labels are left out. Without both labels the model is
    the intercept alone. Repeated rows are scored each, empty tables give no rows.
    """
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with their columns."""
    columns, place = docs.columns, docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def work(batches):
        make_room(__name__)
        weights = model.value
        get = weights.get
        for batch in batches:
            texts = batch.column(place).to_pylist()
            keep = [weights[""] + sum(sorted(filter(None, map(get, features(t or ""))))) < 0 for t in texts]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=columns)

    return plain(docs).mapInArrow(work, docs.schema)
