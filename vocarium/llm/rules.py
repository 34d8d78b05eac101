"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit per failed
rule. A policy is a mask of the bits that reject a document, under a version; a change of policy needs
no text again. Ablations ask what each rule of a policy alone rejects, and come from the counts of
the distinct bit patterns, of which there are few.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.llm.rows import map_rows, texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    name: str
    fails: str


#: A rule's place is its bit. New rules go to the end, so old ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * (word_chars + 1)"),
    Rule("dup_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)

#: Policies by version: names of the rules that reject.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "dup_lines", "short_words", "long_words"),
}
LATEST = 2


def mask_of(names: Iterable[str]) -> int:
    places = {rule.name: i for i, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in names)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def measure(text: bytes) -> tuple[int, ...]:
    """The values of ``MEASURES`` for a whole text in UTF-8."""
    words = text.split()
    if not words:
        return 0, 0, int(_SYMBOL[np.frombuffer(text, np.uint8)].sum()), 0, 0, 0
    a = np.frombuffer(text, np.uint8)
    chars = int((((a & 0xC0) != 0x80) & ~_SPACE[a]).sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), chars, int(_SYMBOL[a].sum()), len(lines), len(lines) - len(set(lines)),
            repeated_words(words))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of words that is found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, window):  # numbers of the windows so far, then one word more
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[k:n + k]
    _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[group] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k:n + k] |= twice
    return int(covered.sum())


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, measures..., fail_bits)`` for every row of ``docs(doc_id, text)``.

    Whole texts are measured; a null text has no words. Every input row gives a row, also repeated
    ones and those without an id; other columns are ignored; an empty table gives an empty ledger.
    """
    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        for key, text in rows:
            yield key, *measure(text)

    schema = ", ".join(["doc_id long", *(f"{name} long" for name in MEASURES)])
    return map_rows(texts(docs), work, schema).withColumn("fail_bits", fail_bits())


def fail_bits() -> Column:
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES)]
    return sum(bits[1:], bits[0]).cast("long")


def failed(mask: int, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask)) != 0


def apply_policy(book: DataFrame, version: int = LATEST, policies: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """``book`` with ``policy`` and ``kept``: no rule of the policy has failed."""
    mask = mask_of((policies or POLICIES)[version])
    return book.withColumn("policy", F.lit(version)).withColumn("kept", ~failed(mask))


def ablations(book: DataFrame, version: int = LATEST, policies: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """``(rule, fails, sole, kept_without)`` for every rule of a policy.

    ``fails`` counts documents that break the rule, ``sole`` those that no other rule of the policy
    rejects, ``kept_without`` what the policy keeps when the rule is left out.
    """
    names = (policies or POLICIES)[version]
    mask = mask_of(names)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("docs"))
    per_rule = patterns.select("bits", "docs", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(mask_of([name])).cast("long").alias("bit")) for name in names])).alias("r"))
    own, total = F.col("bits").bitwiseAND(F.col("r.bit")), F.coalesce(F.sum("docs"), F.lit(0))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("docs"))), F.lit(0))
    return per_rule.groupBy(F.col("r.rule").alias("rule")).agg(
        count(own != 0).alias("fails"), count(F.col("bits") == F.col("r.bit")).alias("sole"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"), total.alias("docs"))


def oracle(version: int = LATEST) -> str:
    """The registered query in DuckDB: measures by lists of words, then the rules as they stand."""
    bits = " + ".join(f"CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES))
    return f"""
WITH read AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM read),
placed AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
windows AS (SELECT n, place, count(*) OVER (PARTITION BY n, word, w2, w3) AS times FROM (
  SELECT n, place, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM placed WINDOW p AS (PARTITION BY n ORDER BY place)) WHERE w3 IS NOT NULL),
repeated AS (SELECT n, count(DISTINCT place + i)::BIGINT AS n_repeat_words FROM windows, (SELECT unnest(range({WINDOW})) AS i) WHERE times > 1 GROUP BY n),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN repeated USING (n)),
book AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM measured)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask_of(POLICIES[1])}) <> 0 AS base_failed, (fail_bits & {mask_of(POLICIES[version])}) = 0 AS kept, fail_bits FROM book"""
