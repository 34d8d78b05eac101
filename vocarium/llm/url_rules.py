"""URL rules as one bit-parallel automaton.

A rule is a glob over the canonical URL: a dot, the host in lower case, and the path. All rules lie side
by side in one row of bits, a bit for the start and one for each character of each rule. A step of the
automaton takes the next byte of the URL and moves all rules at once:

    D = ((D << 1) & FOLLOW[byte]) | (D & STAY[byte])

``FOLLOW`` has the bits whose character the byte is, ``STAY`` those a wildcard holds on. The row of bits
spans as many 64-bit words as the rules need. The steps of a batch of URLs run as one array operation for
each position, over the URLs that are still that long.

In a glob ``*`` stands for any run without ``/``, ``**`` for any run, ``?`` for one character but ``/``;
a backslash takes the next character as it is.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vocarium.llm.rows import make_room, plain

#: Bits of an automaton at most; its tables take 64 bytes for each.
MOST_BITS = 1 << 20

#: Bytes of the state of the URLs that move together, at most (one URL at least).
STATE_BYTES = 4 << 20


class Rule(NamedTuple):
    """A glob and its verdict. Among the rules that fit a URL the lowest ``tier`` decides, then the longest ``name``;
    of equally long ones a blocking rule, then the first by code point."""

    name: str
    glob: str
    verdict: str
    tier: int = 0


def escaped(text: str) -> str:
    return "".join(f"\\{c}" if c in "\\*?" else c for c in text)


def site(host: str, path: str, verdict: str, tier: int = 0) -> Rule:
    """A rule for a host with all its subdomains, and paths that start with ``path``."""
    return Rule(f"{host}{path}", f"*.{escaped(host)}{escaped(path)}**", verdict, tier)


def anywhere(word: str, verdict: str, tier: int = 1) -> Rule:
    """A rule for a word anywhere in the URL."""
    return Rule(word, f"**{escaped(word)}**", verdict, tier)


#: Rules of the registered query: sites first, then words of hosts and paths that no site rule judges.
SITES = (
    site("net", "/", "block"),
    site("example.net", "/en/", "allow"),
    site("example.com", "/de/", "block"),
    site("org", "/fr/", "allow"),
)
WORDS = tuple(anywhere(word, "block") for word in (
    "cheap-pills", "casino", "viagra", "porn", "xxx", "/cgi-bin/", "/wp-login", "/login", "/cart/", "/checkout/"))
DEFAULT = "allow"

_ANY, _RUN, _ONE = "**", "*", "?"


def tokens(glob: str) -> Iterator[tuple[str, bool]]:
    """Characters and wildcards of a glob, with whether each is a wildcard."""
    at = 0
    while at < len(glob):
        if glob[at] == "\\" and at + 1 < len(glob):
            yield glob[at + 1], False
            at += 2
        elif glob.startswith(_ANY, at):
            yield _ANY, True
            at += 2
        else:
            yield glob[at], glob[at] in (_RUN, _ONE)
            at += 1


class Automaton(NamedTuple):
    follow: np.ndarray  # [256, words]
    stay: np.ndarray  # [256, words]
    start: np.ndarray  # [words]
    ends: list[int]  # last bit of each rule, the most important rule first


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    """Rules by importance, each once."""
    return sorted(set(rules), key=lambda r: (r.tier, -len(r.name), r.verdict != "block", r.name, r.glob))


def compile_rules(rules: list[Rule]) -> Automaton:
    """Masks of the rules in their order."""
    steps: list[tuple[int, int, str]] = []  # bit, byte or wildcard, kind
    starts, ends, bit = [], [], 0
    for rule in rules:
        starts.append(bit)
        for token, wild in tokens(rule.glob):
            if wild and token != _ONE:
                steps.append((bit, 0, token))  # the bit before the wildcard holds on
            elif wild:
                bit += 1
                steps.append((bit, 0, _ONE))
            else:
                for byte in token.encode():
                    bit += 1
                    steps.append((bit, byte, "byte"))
        ends.append(bit)
        bit += 1
    if bit > MOST_BITS:
        raise ValueError(f"{bit} bits of rules, more than {MOST_BITS}")
    words = max(1, -(-bit // 64))
    follow, stay, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
    bytes_, slash, later = np.arange(256), ord("/"), slice(0x80, 0xC0)
    for at, byte, kind in steps:
        word, mask = at >> 6, np.uint64(1 << (at & 63))
        if kind == "byte":
            follow[byte, word] |= mask
        elif kind == _ONE:  # a character's first byte; its later bytes hold on
            follow[:, word] |= mask
            follow[slash, word] &= ~mask
            follow[later, word] &= ~mask
            stay[later, word] |= mask
        else:
            stay[bytes_ != slash if kind == _RUN else bytes_ >= 0, word] |= mask
    for at in starts:
        start[at >> 6] |= np.uint64(1 << (at & 63))
    return Automaton(follow, stay, start, ends)


def matches(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the first rule that fits each of the byte strings ``data[offsets[i]:offsets[i + 1]]``, -1 where none does."""
    n, words = len(offsets) - 1, len(automaton.start)
    if not automaton.ends:
        return np.full(n, -1)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    found = np.full(n, -1)
    rows = max(1, STATE_BYTES // (8 * words))
    for at in range(0, n, rows):
        chosen = order[at:at + rows]
        found[chosen] = _first(_run(automaton, data, offsets[chosen], lengths[chosen]), automaton.ends)
    return found


def _run(automaton: Automaton, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bits after the last byte; ``lengths`` fall."""
    state = np.repeat(automaton.start[None, :], len(begins), 0)
    one, top = np.uint64(1), np.uint64(63)
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for place, live in enumerate(alive.tolist()):
        byte = data[begins[:live] + place]
        now = state[:live]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        moved &= automaton.follow[byte]
        now &= automaton.stay[byte]
        now |= moved
    return state


def _first(state: np.ndarray, ends: list[int]) -> np.ndarray:
    found = np.full(len(state), -1)
    for number in range(len(ends) - 1, -1, -1):
        hit = (state[:, ends[number] >> 6] >> np.uint64(ends[number] & 63)) & np.uint64(1) != 0
        found[hit] = number
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z in lower case, and path of a URL; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = DEFAULT, key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, host, path, name, tier, verdict)`` for every row of ``pages``.

    ``name`` and ``tier`` are those of the rule that decides (see ``Rule``), null where none fits; then
    ``default`` is the verdict. Whole URLs are read, of any length. A null URL and one without ``://`` have
    an empty host and path, to which most rules do not fit. Repeated rows and rows without a key are judged
    like others; other columns play no part; an empty table gives an empty one, no rules the default.
    """
    ranked = ordered(rules)
    automaton = compile_rules(ranked)
    host, path = host_and_path(F.col(url).cast("string"))
    asked = pages.select(F.col(key).cast("bigint").alias(key), host.alias("host"), path.alias("path"))
    asked = plain(asked.withColumn("canonical", F.concat(F.lit("."), "host", "path").cast("binary")))
    schema = f"{key} long, host string, path string, name string, tier int, verdict string"
    arrow = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        names, tiers = [*(r.name for r in ranked), None], [*(r.tier for r in ranked), None]
        verdicts = [*(r.verdict for r in ranked), default]
        for batch in batches:
            if not batch.num_rows:
                continue
            urls = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset:urls.offset + len(urls) + 1]
            found = matches(automaton, np.frombuffer(urls.buffers()[2], np.uint8), offsets).tolist()
            decided = [pa.array([values[i] for i in found], kind) for values, kind in (
                (names, pa.string()), (tiers, pa.int32()), (verdicts, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *decided], schema=arrow)

    return asked.mapInArrow(run, schema)


def like(rule: Rule) -> str:
    """The rule as a regular expression over the canonical URL, for checks."""
    special = {_ANY: "(?s:.*)", _RUN: "[^/]*", _ONE: "[^/]"}
    return "^" + "".join(special[t] if wild else t if t.isalnum() else f"\\x{{{ord(t):X}}}" for t, wild in tokens(rule.glob)) + "$"


def oracle(rules: Iterable[Rule], default: str = DEFAULT) -> str:
    """The registered query in DuckDB, the rules as a table of regular expressions."""
    rows = ", ".join(f"({i}, '{r.name}', {r.tier}, '{r.verdict}', '{like(r)}')" for i, r in enumerate(ordered(rules)))
    return f"""
WITH rules(place, name, tier, verdict, pattern) AS (VALUES {rows}),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
first AS (
  SELECT p.n, min_by(r.name, r.place) AS name, min_by(r.tier, r.place) AS tier, min_by(r.verdict, r.place) AS verdict
  FROM parts p JOIN rules r ON regexp_matches(concat('.', p.host, p.path), r.pattern) GROUP BY p.n)
SELECT p.page_id, p.host, p.path, CASE WHEN f.tier = 0 THEN f.name END AS rule, coalesce(f.verdict, '{default}') AS verdict
FROM parts p LEFT JOIN first f USING (n)"""
