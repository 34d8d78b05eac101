"""Main text of web pages by differencing pages with near URLs.

A page is read as lines: its blocks of text in page order, with character references decoded. Pages of
a host are put in the order of their paths, copies as one, and each is paired with the neighbour whose
path shares the longest beginning and which is no near copy. The lines of the two are aligned by their
longest common subsequence, and what both have is template, not article.

Markup says some of it beforehand. Lines inside menus, forms, adverts, comments and the like are
dropped even where the neighbour lacks them, and so is what stands outside the article where a page
marks one. Paragraphs and headings of a marked article stay even where the neighbour has them too,
because pages quote and copy each other, unless names cast doubt on them. All other lines are decided
by the alignment.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vocarium.llm.rows import map_rows
from vocarium.operators.ranking import global_position
from vocarium.session import work_path, written

# Elements and names that mark what is not the article, in natural order.
SKIPPED = frozenset((
    "head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "canvas", "iframe", "object", "button",
    "select", "option", "textarea", "dialog", "menu", "video", "audio", "map", "math"))
CUES = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus", "gdpr", "login", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "paywall", "popup", "promo",
    "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "tracking",
    "widget", "widgets"))
#: Cues that name things of articles as well; they leave lines to the alignment.
DISPUTED = frozenset((
    "banner", "discussion", "disclaimer", "notice", "notification", "recommended", "related", "replies", "reply", "respond",
    "responses", "search", "skip", "teaser", "tracking"))
#: Elements whose names say nothing against what they hold.
UNCUED = frozenset(("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"))
#: Cues that count only outside the article.
OUTER_CUES = frozenset(("header", "masthead", "footer", "foot", "topbar", "copyright"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul"))
PROSE = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "dt", "td", "th", "figcaption", "caption"))
CONTAINERS = frozenset(("article", "main"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements that end where the next of the named ones begins.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"),
             "option": ("option",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|xmp|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
_MARKED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")

#: What is known of a line: dropped by its markup, open to the alignment, kept as prose of the article.
DROPPED, OPEN, KEPT = 0, 1, 2

#: Neighbours on each side; share of the open characters from which a neighbour that has them is a copy.
REACH = 3
NEAR_COPY = 0.95
_NO_DIGITS = dict.fromkeys(map(ord, "0123456789"))


def _verdict(tag: str, rest: str, inside: bool) -> int:
    """``DROPPED`` if an element is no part of the article, whatever it holds; ``OPEN`` if its names cast doubt on it.

    A cue counts as a whole class or id of an element that is not prose. As a part of a longer name, on
    prose, or if disputed, it leaves the lines to the alignment.
    """
    if tag in SKIPPED or tag == "header" and not inside:
        return DROPPED
    out = KEPT
    if not rest or rest.isspace():
        return out
    for found in _MARKED.finditer(rest):
        name, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if name in ("class", "id"):
            if tag in UNCUED:
                continue
            cues = CUES if inside else CUES | OUTER_CUES
            whole = cues.intersection(value.split()) - DISPUTED
            if whole and tag not in PROSE:
                return DROPPED
            if not cues.isdisjoint(_NAME.findall(value)):
                out = OPEN
        elif name == "role" and value in ROLES or name == "hidden" and value != "until-found":
            return DROPPED
        elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return DROPPED
    return out


def lines_of(page: str) -> list[tuple[str, int]]:
    """``(line, verdict)`` for each block with text, in page order."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, skipped, in a container, in prose, in doubt
    held: list[str] = []
    found_container = False
    skipped = inside = prose = doubt = False

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, DROPPED if skipped else KEPT if inside and prose and not doubt else OPEN, inside))

    def pop_to(depth: int) -> None:
        nonlocal skipped, inside, prose, doubt
        del stack[depth:]
        skipped, inside, prose, doubt = stack[-1][1:] if stack else (False, False, False, False)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            held.append(page[at:token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            close()
        if token["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if not block and stack[depth][0] in BLOCKS:
                    break
            continue
        if tag in VOID or token["rest"].endswith("/") and not block:
            continue
        if block and stack:
            for depth in range(len(stack) - 1, -1, -1):
                open_tag = stack[depth][0]
                if open_tag == "p" or tag in CLOSED_BY.get(open_tag, ()):
                    pop_to(depth)
                    break
                if open_tag in BLOCKS:
                    break
        verdict = _verdict(tag, token["rest"], inside)
        skip = skipped or verdict == DROPPED
        inside = inside or tag in CONTAINERS and not skip
        found_container = found_container or inside and not skip
        skipped, prose, doubt = skip, prose or tag in PROSE, doubt or verdict == OPEN
        stack.append((tag, skipped, inside, prose, doubt))
    if at < len(page):
        held.append(page[at:])
    close()
    if found_container:
        return [(text, verdict if within else DROPPED) for text, verdict, within in out]
    return [(text, verdict) for text, verdict, _ in out]


# --- alignment ----------------------------------------------------------------------------------


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every beginning of ``b``; bits of whole numbers."""
    places: dict[int, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        hit = places.get(line)
        if hit:
            u = row & hit
            row = (row + u | row - u) & full
    bits = np.frombuffer((~row & full).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little")[:len(b)], dtype=np.int64)])


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``; memory as the two sequences.

    Divide and conquer: the middle of ``a`` is met by the place in ``b`` where both halves together
    are longest.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            out.append(k - 1)
            k, m = k - 1, m - 1
        if i >= k or j >= m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        middle = (i + k) // 2
        first = _lengths(a[i:middle], b[j:m])
        last = _lengths(a[middle:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(np.argmax(first + last))
        todo += [(i, middle, j, cut), (middle, k, cut, m)]
    return sorted(out)


def line_hash(line: str) -> int:
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def join_lines(lines: list[str], verdicts: list[int], hashes: list[int], neighbours: list[list[int]]) -> str:
    """Kept and unshared lines in page order; of the neighbours the first that is no near copy is aligned."""
    gone: set[int] = set()
    width = [len(line) if v == OPEN else 0 for line, v in zip(lines, verdicts)]
    for neighbour in neighbours if OPEN in verdicts else ():
        found = shared(hashes, neighbour)
        if sum(width[i] for i in found) < NEAR_COPY * sum(width):
            gone = set(found)
            break
    return "\n".join(line for i, (line, v) in enumerate(zip(lines, verdicts)) if v == KEPT or v == OPEN and i not in gone)


# --- Spark --------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def page_lines(pages: DataFrame) -> DataFrame:
    """``(row, page_id, url, host, path, open, content, lines, verdicts, hashes)``.

    Lines that markup drops are kept as hashes only; ``content`` is a hash of all lines without digits.
    """
    read = pages.select(
        F.monotonically_increasing_id(), F.col("page_id").cast("bigint"), F.col("url").cast("string"),
        host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string")),
        F.coalesce(F.col("html").cast("string"), F.lit("")))

    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        for *keys, page in rows:
            found = lines_of(page)
            undecided = any(v == OPEN for _, v in found)
            content = "\n".join(line for line, _ in found).translate(_NO_DIGITS)
            yield (*keys, undecided, line_hash(content), [line if v else "" for line, v in found], [v for _, v in found], [line_hash(line) for line, _ in found])

    schema = ("row long, page_id long, url string, host string, path string, open boolean, content long, "
              "lines array<string>, verdicts array<int>, hashes array<long>")
    return map_rows(read, work, schema, rows=256)


def partners(pages: DataFrame) -> DataFrame:
    """``(row, partners)``: for ``pages(row, page_id, host, path, content)`` pages of the host with near paths, nearest first.

    Pages of a host with equal content are one page, at the first of their paths. These are numbered
    in the order of host, path and id by ranges, so a host of any size is spread over many tasks, and
    ``REACH`` on each side meet by their number. Of two equally near ones the earlier is taken. Pages
    without a host and those without other content in their host have no partner.
    """
    hosted = pages.filter("host <> ''")
    first = F.min(F.struct("path", "page_id", "row")).alias("first")
    alone = hosted.groupBy("host", "content").agg(first).select("host", "content", "first.*")
    placed = written(global_position(alone, ["host", "path", "page_id", "row"]), "places")
    steps = F.explode(F.array(*[F.lit(k) for k in range(-REACH, REACH + 1) if k])).alias("step")
    other = placed.select("host", F.col("path").alias("other_path"), F.col("row").alias("other"), "position", steps).withColumn(
        "position", F.col("position") - F.col("step"))
    met = placed.join(other, ["host", "position"]).groupBy("host", "content", "path").agg(
        F.collect_list(F.struct("step", "other_path", "other")).alias("others"))

    def order(rows: Iterator[tuple]) -> Iterable[tuple]:
        for host, content, path, others in rows:
            ways = [(-len(os.path.commonprefix([path, o["other_path"]])), abs(o["step"]), o["step"], o["other"]) for o in others]
            yield host, content, [way[-1] for way in sorted(ways)]

    near = map_rows(met.select("host", "content", "path", "others"), order, "host string, content long, partners array<long>")
    return hosted.select("row", "host", "content").join(near, ["host", "content"]).select("row", "partners")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    Whole pages are read; null and empty ones have empty text. Repeated rows are pages of their own.
    Copies on one host do not pair with each other; a page whose neighbours are all near copies keeps
    its open lines. Null ids and URLs are allowed, other columns ignored, an empty table gives no rows.
    """
    path = work_path(pages.sparkSession, "page_lines")
    page_lines(pages).write.option("compression", "zstd").parquet(path)
    read = pages.sparkSession.read.parquet(path)
    # Only pages with lines that markup leaves open are moved to meet their neighbour's lines.
    waiting = read.filter("open")
    pairs = partners(read.select("row", "page_id", "host", "path", "content")).join(waiting.select("row"), "row").select(
        "row", F.posexplode("partners").alias("place", "partner"))
    theirs = (
        pairs.join(read.select(F.col("row").alias("partner"), "hashes"), "partner")
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "hashes")))["hashes"].alias("neighbours")))
    columns = ["page_id", "url", "lines", "verdicts", "hashes", "neighbours"]
    decided = read.filter("NOT open").withColumn("neighbours", F.lit(None).cast("array<array<bigint>>")).select(*columns)
    ready = decided.union(waiting.join(theirs, "row", "left").select(*columns))

    def work(rows: Iterator[tuple]) -> Iterable[tuple]:
        for key, url, lines, verdicts, hashes, neighbours in rows:
            text = join_lines(lines, verdicts, hashes, neighbours or [])
            yield key, url, text, len(text)

    return map_rows(ready, work, "page_id long, url string, text string, n_chars long", rows=256)
