"""The written search index against plain scoring, with many small blocks and folders."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vocarium.functions import text as tx
from vocarium.operators import filters, lexical, postings

POINTS = "chunk_id BIGINT, text STRING, title STRING, video_id BIGINT, chunk_index INT, recorded_date INT, is_short BOOLEAN, is_4k BOOLEAN"


def asked(spark, texts, kinds=("all",)):
    rows = [(i, t, "lexical", kinds[i % len(kinds)], None, None) for i, t in enumerate(texts)]
    return filters.with_parsed_query(spark.createDataFrame(
        rows, "query_id BIGINT, text STRING, mode STRING, video_type STRING, date_from STRING, date_to STRING"))


def plain(docs, queries, k, every):
    """``docs``: (id, roots, is_short, is_4k); ``queries``: (id, distinct roots, kind)."""
    total, average = len(docs), sum(len(r) for _, r, _, _ in docs) / len(docs)
    df = Counter(root for _, roots, _, _ in docs for root in set(roots))
    out = {}
    for query, roots, kind in queries:
        found = []
        for doc, words, short, four in docs:
            tf = Counter(words)
            held = [r for r in roots if tf[r]]
            if not held or (every and len(held) < len(roots)) or {"short": not short, "long": short, "4k": not four}.get(kind, False):
                continue
            score = sum(math.log(1 + (total - df[r] + 0.5) / (df[r] + 0.5)) * tf[r] * 2.2 / (tf[r] + 1.2 * (0.25 + 0.75 * len(words) / average)) for r in held)
            found.append((-round(score, 9), doc))
        out[query] = [(doc, pytest.approx(-score, abs=1e-8)) for score, doc in sorted(found)[:k]]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "of", "der", "столица", "всё", "under_score", "tablets"] + [f"rare{i}" for i in range(40)]
    weights = [12, 9, 7, 5, 20, 6, 3, 4, 2, 3] + [0.4] * 40
    return [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 25))), "one title", draw.randint(0, 30), i % 9, 0,
             draw.random() < 0.3, draw.random() < 0.3) for i in range(600)]


@pytest.fixture(scope="module")
def small_index(spark, corpus):
    return postings.write_index(spark.createDataFrame(corpus, POINTS).repartition(5), block=8, folder_tokens=900)


TEXTS = ["alpha beta", "gamma", "of", "rare1 of", "rare2", "rare3 rare4", "unknown", "unknown alpha", "столица всё of", "alpha alpha beta gamma delta of", "title"]


@pytest.mark.parametrize("match", ["all", "any"])
def test_ranking_in_small_blocks_equals_plain_scores(spark, corpus, small_index, match, monkeypatch):
    kinds = ("all", "short", "long", "4k")
    assert small_index.folders > 3
    roots = {r["chunk_id"]: r["r"] for r in spark.createDataFrame(corpus, POINTS).select(
        "chunk_id", tx.roots(F.concat_ws(" ", "title", "text")).alias("r")).collect()}
    docs = [(c[0], roots[c[0]], c[6], c[7]) for c in corpus]
    queries = asked(spark, TEXTS * 3, kinds)
    wanted = [(r["query_id"], sorted(set(r["r"])), kinds[r["query_id"] % 4]) for r in queries.select("query_id", tx.roots(F.col("clean")).alias("r")).collect()]
    for size in (lexical.QUERY_BATCH, 7):
        monkeypatch.setattr(lexical, "QUERY_BATCH", size)
        got = {q: [] for q, _, _ in wanted}
        for r in lexical.bm25_search(queries, small_index, 10, match).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["chunk_id"], r["score"]))
        assert got == plain(docs, wanted, 10, match == "all")


def test_tops_bound_the_scores(small_index):
    rows = small_index.roots.select("top", F.arrays_zip("tf", "length").alias("e")).collect()
    assert rows and all(r["top"] == max(postings.term_part(e["tf"], e["length"], small_index.average) for e in r["e"]) for r in rows)


def test_quotes_follow_positions(spark, corpus, small_index):
    """Positions give what the match inside the text gives."""
    quotes = ["alpha beta", "of of of", "столицы все", "tablet", "tables rare1", "gamma under", "beta alpha gamma of", "всее", "rare5 rare6"]
    queries = asked(spark, quotes, ("all", "short"))
    got = {(r["query_id"], r["chunk_id"]) for r in lexical.quote_search(queries, small_index, 1000).collect()}
    points = spark.createDataFrame(corpus, POINTS).select("chunk_id", F.col("text").alias("said"), "is_short")
    want = points.crossJoin(queries.select("query_id", "clean", "q_short")).filter(
        lexical.quote_match(F.col("said"), tx.tokens(F.col("clean"))) & (F.col("q_short").isNull() | (F.col("q_short") == F.col("is_short"))))
    assert got == {(r["query_id"], r["chunk_id"]) for r in want.collect()} and len(got) > 100


def test_empty_index_and_odd_documents(spark):
    rows = [(1, None, None, None, None, None, None, None), (2, "", "", 1, 0, 0, False, False), (2, "word", "", 1, 0, 0, False, False), (2, "word", "", 1, 0, 0, False, False),
            (3, "_word word_ a_b", "", 1, 0, 0, False, False), (4, "word " * 20_000, "", 1, 0, 0, False, False)]
    index = postings.write_index(spark.createDataFrame(rows, POINTS))
    found = sorted(r["chunk_id"] for r in lexical.bm25_search(asked(spark, ["word"]), index).collect())
    assert found[:2] == [2, 2] and found[-1] == 4
    assert sorted(r["chunk_id"] for r in lexical.quote_search(asked(spark, ["word"]), index, 9).collect()) == [2, 2, 4]
    none = postings.write_index(spark.createDataFrame([], POINTS))
    assert lexical.bm25_search(asked(spark, ["word"]), none).count() == 0 and lexical.quote_search(asked(spark, ["word"]), none, 9).count() == 0
    assert lexical.bm25_search(asked(spark, []), index).count() == 0


def test_postings_repeat_no_filter_columns(small_index):
    for table, meta in ((small_index.roots, small_index.root_meta), (small_index.words, small_index.word_meta)):
        assert not set(postings.META) & set(table.columns)
        assert meta.select(F.explode("chunk_id")).count() == small_index.total


def test_build_postings_moves_texts_and_not_postings(spark):
    """Rows of one chunk count together, and the only exchange is that of the texts by chunk."""
    points = spark.createDataFrame([(1, "a", "bb cc bb"), (2, None, "cc"), (1, "a", "bb")], "chunk_id long, title string, text string")
    made = lexical.build_postings(points)
    got = {(r["chunk_id"], r["root"]): r["tf"] for r in made.collect()}
    assert got == {(1, "a"): 2, (1, "bb"): 3, (1, "cc"): 1, (2, "cc"): 1}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and ", root#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
