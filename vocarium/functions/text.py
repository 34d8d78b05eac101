"""Text, title and query expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: One word: a run of letters and digits in any script.
WORD = r"[\p{L}\p{N}]+"

#: The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

#: File suffixes that count as media.
MEDIA_SUFFIXES = ("mp4", "mkv", "mov", "avi", "webm", "flv", "3gp", "mpeg", "mpg", "m4v")

#: Domain terms whose root is capitalised and whose suffix is lower-cased.
DOMAIN_TERMS = (
    (r"мастер([ауеы]|ом|ам|ами|ах)?", "Мастер"),
    (r"дисциплин([аыеу]|ой|ою)?", "Дисциплин"),
    (r"просветлени([еяюи]|ем)?", "Просветлени"),
    (r"истин([аыеу]|ой|ою)?", "Истин"),
)

QUERY_FILTER = r"(?U)(?:video_id|v):\S+"

QUERY_MAX_CHARS = 256


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def tokens(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_root(word: Column) -> Column:
    """Language-neutral root: the longer the word, the more of its ending is dropped."""
    size = F.length(word)
    keep = F.when(size <= 3, size).when(size <= 5, size - 1).when(size == 6, size - 2).otherwise(size - 3)
    return F.substring(word, F.lit(1), keep)


def roots(text: Column) -> Column:
    return F.transform(tokens(text), word_root)


def clean_query(query: Column) -> Column:
    """Query text without its ``v:`` / ``video_id:`` filter."""
    return strip(F.regexp_replace(query, QUERY_FILTER, ""))


def query_video_id(query: Column) -> Column:
    """Number of the first ``v:123`` / ``video_id:123`` in the query, else null."""
    found = F.regexp_extract(query, r"(?:video_id|v):(\d+)", 1)
    return F.nullif(found, F.lit("")).try_cast("bigint")


def sanitize_query(query: Column) -> Column:
    """First 256 characters without control characters other than line breaks."""
    return F.regexp_replace(F.substring(query, 1, QUERY_MAX_CHARS), r"[\p{C}\p{Z}&&[^\n\r ]]", "")


def phrase_query(query: Column, slop: int = 10) -> Column:
    """Proximity phrase ``"a b c"~slop`` of the words of a query; null when there are none."""
    words = tokens(query)
    return F.when(F.size(words) > 0, F.concat(F.lit('"'), F.array_join(words, " "), F.lit(f'"~{slop}')))


def title_date(title: Column) -> Column:
    """ISO text of a date leading a title: YYYY.MM.DD, DD.MM.YYYY or YY.MM.DD.

    Only the ranges 1-12 and 1-31 are checked, so the result stays text.
    """
    name = strip(title)

    def read(pattern: str, year: int, month: int, day: int, century: str) -> Column:
        pattern = pattern + r"(?U)\b"
        y, m, d = (F.regexp_extract(name, pattern, g) for g in (year, month, day))
        ok = name.rlike(pattern) & m.between("01", "12") & d.between("01", "31")
        return F.when(ok, F.concat(F.lit(century), y, F.lit("-"), m, F.lit("-"), d))

    return F.coalesce(
        read(r"^([0-9]{4})\.([0-9]{2})\.([0-9]{2})", 1, 2, 3, ""),
        read(r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})", 3, 2, 1, ""),
        read(r"^([0-9]{2})\.([0-9]{2})\.([0-9]{2})", 1, 2, 3, "20"),
    )


def is_4k(title: Column) -> Column:
    """``4K`` with a Latin or a Cyrillic K."""
    return F.coalesce(title.rlike("4[KК]"), F.lit(False))


def is_media(name: Column, mime_type: Column) -> Column:
    suffix = r"\.(" + "|".join(MEDIA_SUFFIXES) + ")$"
    return F.coalesce(mime_type.contains("video/"), F.lit(False)) | F.coalesce(
        F.lower(name).rlike(suffix), F.lit(False))


def matches_keyword(name: Column, keywords: Sequence[str]) -> Column:
    """Case-insensitive substring test against any keyword."""
    if not keywords:
        return F.lit(False)
    words = F.array(*[F.lit(k.upper()) for k in keywords])
    return F.coalesce(F.exists(words, lambda k: F.upper(name).contains(k)), F.lit(False))


def regexp_match(item: Column, pattern: str) -> Column:
    """Case-insensitive search; null input is false."""
    return F.coalesce(item.rlike("(?iu)" + pattern), F.lit(False))


def canonical_title(name: Column, markers: Sequence[str] = ("gallery", "галерея")) -> Column:
    """Key under which variants of one recording meet."""
    text = F.regexp_replace(F.lower(name), r"[._\-]+", " ")
    text = F.regexp_replace(text, r"(?U)\b(" + "|".join(markers) + r")\b", " ")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def has_marker(name: Column, markers: Sequence[str] = ("gallery", "галерея")) -> Column:
    """Marker test on the raw name, where ``_`` is a word character."""
    return F.coalesce(name.rlike(r"(?iU)\b(" + "|".join(markers) + r")\b"), F.lit(False))


def normalise_terms(text: Column, rules: Sequence[tuple[str, str]] = DOMAIN_TERMS) -> Column:
    """Apply term rules in order: whole words become root plus lower-cased suffix.

    ``regexp_replace`` cannot lower-case a group, so the text is cut at every match and
    joined again; rules without a match cost a single ``rlike``.
    """
    for pattern, base in rules:
        whole = r"(?iU)\b" + pattern + r"\b"
        pieces = F.split(text, whole)
        suffixes = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
        rebuilt = F.array_join(
            F.zip_with(pieces, suffixes, lambda piece, suffix: F.concat(
                piece, F.when(suffix.isNull(), "").otherwise(F.concat(F.lit(base), F.lower(suffix))))),
            "",
        )
        text = F.when(text.rlike(whole), rebuilt).otherwise(text)
    return text


def timestamp_label(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on."""
    total = seconds.cast("bigint")
    hours, minutes, secs = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, secs)).otherwise(
        F.format_string("%02d:%02d", minutes, secs))


def timestamped_link(url: Column, start_sec: Column) -> Column:
    mark = F.when(url.contains("?"), "&").otherwise("?")
    return F.concat(url, mark, F.lit("t="), start_sec.cast("bigint").cast("string"), F.lit("s"))


def embedding_prompt(text: Column, model: str, task: str) -> Column:
    """Model-family prefix by task; fixed wordings of the model families."""
    name, is_query = model.lower(), task == "RETRIEVAL_QUERY"
    if "qwen" in name:
        prefix = ("Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
                  if is_query else "")
    elif "e5" in name:
        prefix = "query: " if is_query else "passage: "
    elif "bge" in name:
        prefix = "Represent this sentence for searching relevant passages: " if is_query else ""
    else:
        prefix = ""
    return F.concat(F.lit(prefix), text)


def issue_video_id(message: Column) -> Column:
    """Video number named in an issue message, by the first of three wordings that fits."""
    patterns = (r"\(ID:(\d+)\)", r"Video (\d+):", r"(?i)video ID (\d+):")
    found = [F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found).try_cast("bigint")
