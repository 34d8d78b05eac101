"""Fusion, quotes, highlights, timings and the tail of the search on small examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vocarium.functions import text as tx
from vocarium.operators import filters, fusion, highlight, lexical, postings, quotes, search, vectors


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_rrf_order_and_types(spark):
    schema = "query_id BIGINT, chunk_id BIGINT, score DOUBLE, rank INT"
    dense = spark.createDataFrame([(1, 1, .9, 1), (1, 2, .8, 2)], schema)
    words = spark.createDataFrame([(1, 2, .95, 1), (1, 3, .7, 2)], schema)
    got = rows(fusion.rrf_merge(dense, words).orderBy(*fusion.fusion_order()), "chunk_id", "match_type", "combined")
    assert [g[:2] for g in got] == [(2, "hybrid"), (1, "semantic"), (3, "keyword")]
    assert [g[2] for g in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62])


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("out")).head()["out"]


def test_word_highlight_marks_inflected_forms(spark):
    out = one(spark, highlight.word_highlight(F.col("t"), F.col("q")),
              t="Быстрый бурый лис перепрыгнул через ленивую собаку.", q="лис собака")
    assert "<mark>лис</mark>" in out and "<mark>собаку</mark>" in out and out.count("<mark>") == 2


def test_quote_highlight_marks_only_the_words(spark):
    out = one(spark, highlight.quote_highlight("t", "q"), t="Быстрый совершенно посторонний бурый лис.", q="быстрый бурый")
    assert out == "<mark>Быстрый</mark> совершенно посторонний <mark>бурый</mark> лис."


def test_highlight_choice_prefers_stored(spark):
    pick = highlight.highlight_choice(F.col("t"), F.col("q"), F.col("k"), F.col("s"))
    assert one(spark, pick, t="a tale told", q="tale", k="quote", s="given") == "given"
    assert one(spark, pick, t="a tale told", q="tale", k="keyword", s="") == "a <mark>tale</mark> told"


def test_snippet_cuts_at_spaces(spark):
    text = "word " * 100 + "needle in hay " + "tail " * 100
    out = one(spark, highlight.crop_snippet(F.col("t"), F.col("q"), 30), t=text, q="needle hay")
    assert out.startswith("...word") and "needle in hay" in out and out.endswith("tail...")
    assert one(spark, highlight.crop_snippet(F.col("t"), F.col("q"), 30), t=text, q="absent") == text[:60] + "..."


LETTER, GAP = r"[^\W_]", r"[\W_]"


def quote_model(text, quote):
    parts = []
    for w in quote:
        n = len(w)
        kept = n if n <= 3 else n - 1 if n <= 5 else n - 2 if n == 6 else n - 3
        parts.append(rf"\b{w[:kept]}" + ("[ёе]*" if n <= 3 else LETTER + "*") + r"\b")
    return re.search(rf"(?:{GAP}+{LETTER}+){{0,10}}?{GAP}+".join(parts), text, re.I)


def test_quote_match_and_search_equal_the_pattern(spark):
    rnd = random.Random(5)
    vocabulary = ["все", "всё", "всее", "дом", "дома", "а", "ае", "aa", "tab", "table", "tables", "under_score", "der", "лису", "лисы"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    asked = [[rnd.choice([w for w in vocabulary if "_" not in w]) for _ in range(rnd.randint(1, 4))] for _ in range(25)]
    want = {(q, d) for q, quote in enumerate(asked) for d, text in enumerate(texts) if quote_model(text, quote)}
    points = spark.createDataFrame([(i, t, "", i, 0, False, False) for i, t in enumerate(texts)],
                                   "chunk_id BIGINT, text STRING, title STRING, video_id BIGINT, recorded_date INT, "
                                   "is_short BOOLEAN, is_4k BOOLEAN")
    queries = filters.with_parsed_query(spark.createDataFrame(
        [(i, " ".join(q), "quote", "all", None, None) for i, q in enumerate(asked)],
        "query_id BIGINT, text STRING, mode STRING, video_type STRING, date_from STRING, date_to STRING"))
    found = lexical.quote_search(queries, postings.write_index(points), 1000)
    assert set(rows(found, "query_id", "chunk_id")) == want and want


def test_quote_start(spark):
    words = spark.createDataFrame([(1, 0, "до", 10.0, 10.2), (1, 1, "первого", 10.3, 10.7), (1, 2, "совпадения", 10.8, 11.2)],
                                  "video_id BIGINT, pos INT, word STRING, start DOUBLE, end DOUBLE")
    chunks = spark.createDataFrame([(7, 1, 9.0, 12.0)], "id BIGINT, video_id BIGINT, start_sec DOUBLE, end_sec DOUBLE")
    asked = spark.createDataFrame([(1, 7, "первое совпадение"), (2, 7, "другое"), (3, 7, "v:5")],
                                  "request_id BIGINT, chunk_id BIGINT, text STRING")
    got = rows(quotes.resolve_quote_start(asked, chunks, words).orderBy("request_id"), "start_sec", "exact")
    assert got == [(10.3, True), (9.0, False), (9.0, False)]


@pytest.mark.parametrize("text, video, clean", [
    ("tv:5 news", 5, "t news"), ("v:abc word", None, "word"), ("video_id:12", 12, ""), ("plain", None, "plain")])
def test_video_filter_in_query(spark, text, video, clean):
    frame = spark.range(1).select(F.lit(text).alias("t"))
    got = frame.select(tx.query_video_id(F.col("t")), tx.clean_query(F.col("t"))).head()
    assert tuple(got) == (video, clean)


def test_date_filter_ignored_for_short_and_undated_passes_upper_bound(spark):
    points = spark.createDataFrame([(1, 0), (2, 20200101), (3, 20240101)], "chunk_id BIGINT, recorded_date INT")
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(filters.filter_date_range(points, None, "2021-01-01")) == [1, 2]
    assert ids(filters.filter_date_range(points, "2021-01-01", None)) == [3]
    assert ids(filters.filter_date_range(points, "2021-01-01", None, "short")) == [1, 2, 3]


def test_tail_order(spark):
    """Bucket duplicates go first, then the cap of three per video, then the limit."""
    hits = spark.createDataFrame(
        [(1, c, 5, c, s, 1.0 - c / 100, 1, None, 0.0, 0.0, "semantic") for c, s in
         [(1, 0.0), (2, 0.2), (3, 1.0), (4, 2.0), (5, 3.0)]] + [(1, 9, 6, 0, 0.0, 0.1, 9, None, 0.0, 0.0, "semantic")],
        "query_id BIGINT, chunk_id BIGINT, video_id BIGINT, chunk_index BIGINT, start_sec DOUBLE, combined DOUBLE, "
        "dense_rank INT, lexical_rank INT, semantic DOUBLE, lexical DOUBLE, match_type STRING")
    routed = spark.createDataFrame([(1, None, "x")], "query_id BIGINT, v_id BIGINT, clean STRING")
    got = search.present(hits, routed, 20).orderBy("result_rank")
    assert [r["chunk_id"] for r in got.collect()] == [1, 3, 4, 9]


def test_half_even_bucket_and_ties(spark):
    from vocarium.functions.identity import half_second

    frame = spark.createDataFrame([(0.25,), (0.75,), (1.25,)], "s DOUBLE")
    assert [r[0] for r in frame.select(half_second(F.col("s"))).collect()] == [0.0, 1.0, 1.0]


def test_knn_ties_and_filters(spark):
    points = spark.createDataFrame([(i, [1.0, 0.0], i % 2, 0, False, False) for i in range(50, 0, -1)] + [(99, [0.0, 0.0], 0, 0, False, False)],
                                   "chunk_id BIGINT, embedding ARRAY<FLOAT>, video_id BIGINT, recorded_date INT, is_short BOOLEAN, is_4k BOOLEAN")
    queries = filters.with_parsed_query(spark.createDataFrame(
        [(1, "x", "all", [2.0, 0.0]), (2, "v:1", "all", [2.0, 0.0])], "query_id BIGINT, text STRING, video_type STRING, embedding ARRAY<FLOAT>"
    ).withColumns({"date_from": F.lit(None).cast("string"), "date_to": F.lit(None).cast("string")}))
    got = vectors.knn_search(queries, points, 3, 2)
    assert sorted(rows(got, "query_id", "rank", "chunk_id")) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 3), (2, 3, 5)]


def test_knn_in_query_blocks_equals_one_block(spark, views, monkeypatch):
    from vocarium.plans.search_queries import bare_points, open_queries

    whole = sorted(rows(vectors.knn_search(open_queries(views), bare_points(views), 5, 64), "query_id", "chunk_id", "rank"))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 33)
    monkeypatch.setattr(vectors, "PRESCAN", 0.5)
    split = sorted(rows(vectors.knn_search(open_queries(views), bare_points(views), 5, 64), "query_id", "chunk_id", "rank"))
    assert split == whole and len(whole) == 200


def test_embedder_batches_and_errors(spark):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(123)] + [(500, "  ")], "chunk_id BIGINT, text STRING")

    def embedder(texts):
        assert len(texts) <= 50
        return [[float(t.split()[1]), 1.0] for t in texts]

    made = vectors.embed_chunks(chunks, embedder, 2).collect()
    assert len(made) == 123 and all(r["embedding"][0] == r["chunk_id"] for r in made)
    with pytest.raises(Exception, match="another number or length"):
        vectors.embed_chunks(chunks, lambda texts: [[1.0]] * len(texts), 2).collect()
