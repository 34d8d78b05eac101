"""Inverted lists and sparse vectors against exact search."""

import random

import numpy as np

from vocarium.operators import ivf, sparse, vectors
from vocarium.plans.search_queries import bare_points, open_queries


def hits(df):
    found = {}
    for row in df.collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["chunk_id"], row["score"]))
    return {q: sorted(own) for q, own in found.items()}


def test_lists_hold_every_vector_and_all_probes_are_exact(spark, views):
    points = bare_points(views)
    index = ivf.build_lists(points, 64)
    assert index.vectors.count() == points.count() and 1 < index.probes < len(index.centroids)
    assert index.vectors.select("list").distinct().count() <= len(index.centroids)
    exact = vectors.knn_search(open_queries(views), points, 10, 64)
    assert hits(ivf.knn_ivf(open_queries(views), index, 10, 64, len(index.centroids))) == hits(exact)
    found = vectors.recall(exact, ivf.knn_ivf(open_queries(views), index, 10, 64)).agg({"recall": "avg"}).first()[0]
    assert found >= 0.9


def test_few_vectors_and_filters(spark):
    schema = "chunk_id BIGINT, embedding ARRAY<FLOAT>, video_id BIGINT, recorded_date INT, is_short BOOLEAN, is_4k BOOLEAN"
    rows = [(i, [1.0, float(i)], i % 2, 0, False, False) for i in range(5)] + [(9, [0.0, 0.0], 0, 0, False, False), (10, [1.0], 0, 0, False, False), (11, None, 0, 0, False, False)]
    queries = spark.createDataFrame([(1, [1.0, 0.0], None, None, 0, 1, 1), (2, [0.0, 0.0], None, None, 0, 1, None)],
                                    "query_id BIGINT, embedding ARRAY<FLOAT>, q_short BOOLEAN, q_4k BOOLEAN, date_lo INT, date_hi INT, v_id BIGINT")
    index = ivf.build_lists(spark.createDataFrame(rows, schema), 2)
    assert index.vectors.count() == 5
    assert [c for _, c, _ in hits(ivf.knn_ivf(queries, index, 3, 2, 99))[1]] == [1, 3]
    none = ivf.build_lists(spark.createDataFrame([], schema), 2)
    assert ivf.knn_ivf(queries, none, 3, 2).count() == 0


def test_probes_follow_the_sample():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    sample = np.concatenate([c + 0.05 * draw.normal(size=(50, 16)) for c in centres])
    sample = draw.permutation(sample / np.linalg.norm(sample, axis=1, keepdims=True))
    spread = draw.normal(size=(2000, 16))
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    near, far = (ivf.probes_for(s, ivf.train(s, 60), 0.95) for s in (sample, spread))
    assert near <= 6 < far


def test_sparse_search_equals_all_products(spark):
    draw = random.Random(6)
    vector = lambda: (ids := draw.choices(range(60), [9] + [1] * 59, k=draw.randint(0, 12)), [draw.choice([-2.0, 0.5, 1.0, 3.25]) for _ in ids])
    stored = [(i, *vector()) for i in range(500)] + [(7, [0, 0], [1.0, 2.0]), (900, None, None), (901, [], [])]
    queries = [(i, *vector()) for i in range(40)] + [(50, [1000], [1.0]), (51, None, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} BIGINT, indices ARRAY<BIGINT>, values ARRAY<DOUBLE>")
    index = sparse.sparse_index(frame(stored, "id").repartition(4), block=8)
    assert index.select("block").distinct().count() > 50
    got = hits(sparse.sparse_search(frame(queries, "query_id"), index, 5, block=8))
    want = {}
    for query, ids, values in queries:
        scored = []
        for doc, slots, own in stored:
            if set(ids or ()) & set(slots or ()):
                scored.append((-round(sum(a * b for i, a in zip(ids, values) for j, b in zip(slots, own) if i == j), 9), doc))
        if scored:
            want[query] = [(rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:5], 1)]
    assert got == want


def test_probes_find_neighbours_of_vectors_that_were_no_seeds():
    draw = np.random.default_rng(4)
    unit = draw.normal(size=(8300, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sample, asked = unit[:8000], unit[8000:]
    centroids = ivf.train(sample, 300)
    probes = ivf.probes_for(sample, centroids, 0.95)
    near = np.argsort(-(asked @ sample.T), axis=1)[:, :10]
    probed = ivf.ranked_lists(asked, centroids, probes)
    of = ivf.ranked_lists(sample, centroids, 1)[:, 0]
    assert np.mean((of[near][:, :, None] == probed[:, None, :]).any(2)) >= 0.93


def test_sparse_dot_gives_every_pair_with_a_common_slot(spark):
    stored = [(i, [i % 3, 5, 5], [1.0, 2.0, -1.0]) for i in range(60)] + [(70, [8], [1.0]), (71, None, None)]
    queries = [(1, [5], [2.0]), (2, [0, 1], [1.0, 3.0]), (3, [99], [1.0]), (4, None, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} BIGINT, indices ARRAY<BIGINT>, values ARRAY<DOUBLE>")
    index = sparse.sparse_index(frame(stored, "id").repartition(3), block=8)
    got = sorted(map(tuple, sparse.sparse_dot(frame(queries, "query_id"), index, block=8).collect()))
    want = [(1, i, 2.0) for i in range(60)] + [(2, i, 1.0 + 2.0 * (i % 3)) for i in range(60) if i % 3 < 2]
    assert got == sorted(want)
    assert sparse.sparse_dot(frame([], "query_id"), index, block=8).count() == 0
