"""Marked text and snippets.

Quotes are followed over the numbered words of a text, in Arrow-batched functions over hits, of which
a query has a bounded number. Word marking stays in the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vocarium.functions import text as tx
from vocarium.operators.lexical import bind

#: Other words that may stand between two words of a quote.
GAP = 10

_TOKEN = re.compile(r"[^\W_]+")


def _stem(word: str) -> tuple[str, bool]:
    """The part that a form of the word begins with, and whether only a spelling may differ after it.

    Three letters are kept whole, four and five lose their last one, six two, longer words three.
    """
    drop = (0, 1, 1, 2)[max(0, len(word) - 3)] if len(word) <= 6 else 3
    return word[:len(word) - drop], len(word) <= 3


class _Quote:
    """A quote as stems; finds its words among the numbered words of a text."""

    def __init__(self, phrase: str):
        self.stems = [_stem(word) for word in _TOKEN.findall(phrase.lower())]

    def _places(self, words: list[str | None]) -> list[list[int]]:
        """For each stem the numbers of the words that are forms of it."""
        def form(word: str | None, stem: str, exact: bool) -> bool:
            return word is not None and word.startswith(stem) and not (exact and word[len(stem):].strip("ёе"))

        return [[i for i, word in enumerate(words) if form(word, *stem)] for stem in self.stems]

    def matches(self, text: str) -> list[list[tuple[int, int]]]:
        """Spans of the words of each match, from left to right; matches do not overlap.

        From the end of the quote backwards only those places are kept from which the rest can
        still follow, so that going forward the nearest next place is always a right one.
        """
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        alone = [text[a - 1:a] != "_" and text[b:b + 1] != "_" for a, b in tokens]
        places = self._places([text[a:b].lower() if free else None for (a, b), free in zip(tokens, alone)])
        for k in range(len(places) - 2, -1, -1):
            later = places[k + 1]
            places[k] = [p for p in places[k] if (at := bisect_right(later, p)) < len(later) and later[at] - p <= GAP + 1]
        found: list[list[tuple[int, int]]] = []
        last = -1
        for first in places[0] if places else ():
            if first > last:
                path = [first]
                for later in places[1:]:
                    path.append(later[bisect_right(later, path[-1])])
                last = path[-1]
                found.append([tokens[i] for i in path])
        return found


def _mark(text: str, phrase: str) -> str:
    edges = [edge for match in _Quote(phrase).matches(text) for span in match for edge in span]
    pieces = [text[a:b] for a, b in zip([0, *edges], [*edges, len(text)])]
    return "".join(f"<mark>{piece}</mark>" if i % 2 else piece for i, piece in enumerate(pieces))


@F.pandas_udf(T.StringType())
def quote_highlight(text: pd.Series, phrase: pd.Series) -> pd.Series:
    """Mark the words of a quote, not what lies between them."""
    return pd.Series([None if t is None else _mark(t, p or "") for t, p in zip(text, phrase)], dtype=object)


def _best_span(text: str, phrase: str) -> tuple[int, int, float]:
    """Shortest match, the first of equally short ones, and how near its length is to eight letters a word."""
    quote = _Quote(phrase)
    found = [(match[-1][1] - match[0][0], match[0][0]) for match in quote.matches(text)]
    if not found:
        return 0, len(text), 0.0
    size, start = min(found)
    ideal = 8 * len(quote.stems)
    return start, start + size, min(1.0, ideal / size) ** 2


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                      T.StructField("precision", T.DoubleType())])


@F.pandas_udf(_SPAN)
def best_match_span(text: pd.Series, phrase: pd.Series) -> pd.DataFrame:
    """Shortest match of a quote, and how close its length is to that of its words."""
    return pd.DataFrame([_best_span(t or "", p or "") for t, p in zip(text, phrase)],
                        columns=["start", "end", "precision"])


def _snippet(text: str, phrase: str, window: int) -> str:
    """Text around the best match; what is cut off ends at a space, if there is one in the window."""
    start, end, precision = _best_span(text, phrase)
    if not precision:
        return text[:2 * window] + "..."
    head, tail = text[:start], text[end:]
    if len(head) > window:
        near = head[-window:] if window else ""
        head = "..." + (near.split(" ", 1)[1] if " " in near else near)
    if len(tail) > window:
        near = tail[:window]
        tail = (near.rsplit(" ", 1)[0] if " " in near else near) + "..."
    return head + text[start:end] + tail


def crop_snippet(text: Column, phrase: Column, window: int = 250) -> Column:
    """Text around the best match, cut at spaces; the first 500 characters when nothing matches."""
    @F.pandas_udf(T.StringType())
    def crop(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([_snippet(t or "", p or "", window) for t, p in zip(texts, phrases)], dtype=object)

    return crop(text, phrase)


def vocabulary_lemmas(texts: DataFrame, column: str, lemmas: DataFrame | None = None) -> DataFrame:
    """``(token, lemma)`` of the distinct words of a text column; the word root where no lemma is known."""
    words = texts.select(F.explode(F.array_distinct(tx.tokens(F.col(column)))).alias("token")).distinct()
    root = tx.word_root(F.col("token"))
    if lemmas is None:
        return words.withColumn("lemma", root)
    return words.join(lemmas, "token", "left").withColumn("lemma", F.coalesce("lemma", root))


def word_highlight(text: Column, query: Column) -> Column:
    """Mark words whose form or root is asked for; words of the query under three letters are ignored.

    The text is cut into words and what lies between, and put together again.
    """
    asked = F.filter(tx.tokens(tx.clean_query(query)), lambda w: F.length(w) >= 3)
    forms = F.array_union(asked, F.transform(asked, tx.word_root))
    words = F.regexp_extract_all(text, F.lit(tx.WORD), F.lit(0))
    between = F.split(text, tx.WORD)

    def piece(gap: Column, word: Column, known: Column) -> Column:
        low = F.lower(word)
        hit = F.array_contains(known, low) | F.array_contains(known, tx.word_root(low))
        return F.concat(gap, F.when(word.isNull(), "").when(
            hit, F.concat(F.lit("<mark>"), word, F.lit("</mark>"))).otherwise(word))

    return bind(forms, lambda known: F.array_join(F.zip_with(between, words, lambda g, w: piece(g, w, known)), ""))


def highlight_choice(text: Column, query: Column, match_type: Column, stored: Column) -> Column:
    """Stored marking if there is one, else by kind of match."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(match_type == "quote", quote_highlight(text, query)).otherwise(
        word_highlight(text, query)))
