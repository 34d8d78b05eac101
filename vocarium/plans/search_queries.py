"""Search: the flagship and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocarium.functions import identity, text as tx
from vocarium.operators import chunking, filters, fusion, ivf, lexical, points as point_ops, ranking, search, vectors
from vocarium.plans.registry import query
from vocarium.plans.views import DUCK, SPARK, root_sql, tokens_sql

DIMENSION, LIMIT = 64, 20

_PASSES = """(q.q_short IS NULL OR p.is_short = q.q_short) AND (q.q_4k IS NULL OR p.is_4k = q.q_4k)
    AND p.recorded_date BETWEEN q.date_lo AND q.date_hi AND (q.v_id IS NULL OR p.video_id = q.v_id)"""

_COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9)"

DUCK["dense_hits"] = f"""
SELECT q.query_id, p.chunk_id, {_COSINE} AS score,
       row_number() OVER (PARTITION BY q.query_id ORDER BY {_COSINE} DESC, p.chunk_id) AS rank
FROM {{routed}} q JOIN {{index}} p ON p.embedding IS NOT NULL AND {_PASSES}
WHERE q.branch = 'ranked' AND q.mode IN ('semantic', 'hybrid')
QUALIFY rank <= 100
"""


def bm25_sql(condition: str, match_all: bool = True) -> str:
    return f"""
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM (
  SELECT q.query_id, t.chunk_id, count(*) AS hits, any_value(q.n) AS asked,
         round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.len / s.avg_len))), 9)
           AS score
  FROM (SELECT query_id, unnest(r) AS root, len(r) AS n, q_short, q_4k, date_lo, date_hi, v_id
        FROM (SELECT *, list_distinct(list_transform({tokens_sql("left(clean, 256)")}, lambda w: {root_sql("w")})) AS r
              FROM {{routed}} WHERE {condition})) q
  JOIN (SELECT chunk_id, root, count(*) AS tf, any_value(len) AS len
        FROM (SELECT chunk_id, unnest(roots) AS root, len(roots) AS len FROM {{index}}) GROUP BY chunk_id, root) t
    ON t.root = q.root
  JOIN (SELECT root, count(*) AS df FROM (SELECT unnest(list_distinct(roots)) AS root FROM {{index}}) GROUP BY root) d
    ON d.root = q.root
  JOIN {{index}} p ON p.chunk_id = t.chunk_id
  CROSS JOIN (SELECT count(*) AS n, avg(len(roots)) AS avg_len FROM {{index}}) s
  WHERE {_PASSES}
  GROUP BY q.query_id, t.chunk_id)
WHERE {"hits = asked" if match_all else "TRUE"}
QUALIFY rank <= 100
"""


_LEXICAL = "branch = 'ranked' AND mode IN ('lexical', 'hybrid') AND clean <> ''"
DUCK["lexical_hits"] = bm25_sql(_LEXICAL)

_W = r"[\p{{L}}\p{{N}}]"
_NW = r"[^\p{{L}}\p{{N}}]"
_EDGE = r"[^\p{{L}}\p{{N}}_]"
DUCK["quote_hits"] = f"""
SELECT q.query_id, p.chunk_id, 100.0::DOUBLE AS score,
       row_number() OVER (PARTITION BY q.query_id ORDER BY p.chunk_id) AS rank
FROM (SELECT *, '(?i)(?:^|{_EDGE})' || array_to_string(list_transform({tokens_sql("clean")}, lambda w:
        CASE WHEN length(w) <= 3 THEN w || '[ёе]*' ELSE {root_sql("w")} || '{_W}*' END),
        '(?:{_NW}+{_W}+){{{{0,10}}}}?{_NW}+') || '(?:$|{_EDGE})' AS pattern
      FROM {{routed}} WHERE branch = 'quote') q
JOIN {{index}} p ON {_PASSES} AND CASE WHEN len(list_filter({tokens_sql("q.clean")}, lambda w:
  NOT contains(lower(p.text), {root_sql("w")}))) = 0 THEN regexp_matches(p.text, q.pattern) ELSE FALSE END
QUALIFY rank <= 60
"""

DUCK["filter_hits"] = f"""
SELECT q.query_id, p.chunk_id, 1.0::DOUBLE AS score,
       row_number() OVER (PARTITION BY q.query_id ORDER BY p.video_id, p.chunk_index) AS rank
FROM {{routed}} q JOIN {{index}} p ON {_PASSES}
WHERE q.branch = 'filter'
QUALIFY rank <= 20
"""

DUCK["fused"] = """
SELECT COALESCE(d.query_id, l.query_id) AS query_id, COALESCE(d.chunk_id, l.chunk_id) AS chunk_id,
       COALESCE(1.0::DOUBLE / (60 + d.rank), 0) + COALESCE(1.0::DOUBLE / (60 + l.rank), 0) AS combined,
       COALESCE(d.score, 0) AS semantic, COALESCE(l.score, 0) AS lexical,
       CASE WHEN l.rank IS NULL THEN 'semantic' WHEN d.rank IS NULL THEN 'keyword' ELSE 'hybrid' END AS match_type,
       d.rank AS dense_rank, l.rank AS lexical_rank
FROM {dense_hits} d FULL JOIN {lexical_hits} l ON d.query_id = l.query_id AND d.chunk_id = l.chunk_id
"""

DUCK["candidates"] = """
SELECT * FROM {fused}
UNION ALL SELECT query_id, chunk_id, score, 0, 0, 'quote', NULL, rank FROM {quote_hits}
UNION ALL SELECT query_id, chunk_id, score, 0, 0, 'filter', NULL, rank FROM {filter_hits}
"""

_ORDER = "combined DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id"


def tail_sql(source: str) -> str:
    return f"""
SELECT query_id, result_rank, hit_id AS chunk_id, video_id, chunk_index, title, source_file_id, source_url, start_ts, end_ts,
       recorded_date, is_short, is_4k, is_flagged, match_type, round(combined, 9) AS combined_score,
       round(semantic, 6) AS semantic_score, round(lexical, 6) AS lexical_score, text
FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
          CASE WHEN COALESCE(v_id, 0) <> 0 AND clean = '' THEN chunk_index END NULLS FIRST, place) AS result_rank
 FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER.replace("chunk_id", "hit_id")}) AS place
  FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY {_ORDER.replace("chunk_id", "hit_id")}) AS in_video
   FROM (
    SELECT h.query_id, h.chunk_id AS hit_id, h.combined, h.semantic, h.lexical, h.match_type, h.dense_rank,
           h.lexical_rank, q.v_id, q.clean, p.video_id, p.chunk_index, p.start_sec, p.text, p.is_short, p.is_4k,
           COALESCE(v.title, p.title, 'Unknown Video') AS title,
           COALESCE(v.source_file_id, p.source_file_id) AS source_file_id,
           COALESCE(p.source_url, concat('https://drive.google.com/file/d/', v.source_file_id, '/view')) AS source_url,
           CASE WHEN p.recorded_date <> 0 THEN concat(left(p.recorded_date::VARCHAR, 4), '-',
                substr(p.recorded_date::VARCHAR, 5, 2), '-', right(p.recorded_date::VARCHAR, 2)) END AS recorded_date,
           h.chunk_id IN (SELECT chunk_id FROM {{flags}}) AS is_flagged,
           {clock_sql("p.start_sec")} AS start_ts, {clock_sql("p.end_sec")} AS end_ts,
           row_number() OVER (PARTITION BY h.query_id, p.video_id, round_even(p.start_sec * 2, 0) / 2 ORDER BY {_ORDER.replace("chunk_id", "h.chunk_id")}) AS in_bucket
    FROM {source} h JOIN {{routed}} q ON q.query_id = h.query_id JOIN {{index}} p ON p.chunk_id = h.chunk_id
    LEFT JOIN {{videos}} v ON v.id = p.video_id)
   WHERE in_bucket = 1)
  WHERE in_video <= 3 OR v_id IS NOT NULL)
 WHERE place <= 20)
"""


def clock_sql(seconds: str) -> str:
    total = f"CAST(floor({seconds}) AS BIGINT)"
    return (f"CASE WHEN {total} >= 3600 THEN lpad(({total} // 3600)::VARCHAR, CAST(greatest(2, length(({total} // 3600)::VARCHAR)) AS INT), '0') || ':' ELSE '' END || "
            f"lpad(({total} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({total} % 60)::VARCHAR, 2, '0')")


def shown(hits):
    """Result columns in a stable shape."""
    return hits.select(
        "query_id", "result_rank", "chunk_id", "video_id", "chunk_index", "title", "source_file_id", "source_url",
        "start_ts", "end_ts", "recorded_date", "is_short", "is_4k", "is_flagged", "match_type",
        F.round("combined", 9).alias("combined_score"), F.round("semantic", 6).alias("semantic_score"),
        F.round("lexical", 6).alias("lexical_score"), "text")


@query("hybrid_search", tail_sql("{candidates}"))
def hybrid_search(v):
    return shown(search.hybrid_search(v["queries"], v["search_index"], v["videos"], v["flags"], dimension=DIMENSION, limit=LIMIT))


@query("semantic_search", tail_sql("{fused}").replace("{fused}", """(
    SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS combined, score AS semantic, 0 AS lexical,
           'semantic' AS match_type, rank AS dense_rank, NULL AS lexical_rank FROM {dense_hits}
    WHERE query_id IN (SELECT query_id FROM {routed} WHERE mode = 'semantic'))"""))
def semantic_search(v):
    asked = v["queries"].filter("mode = 'semantic'")
    hits = search.hybrid_search(asked, v["search_index"], v["videos"], v["flags"], dimension=DIMENSION, limit=LIMIT)
    return shown(hits.filter("match_type = 'semantic'"))


@query("lexical_search", tail_sql("{fused}").replace("{fused}", """(
    SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS combined, 0 AS semantic, score AS lexical,
           'keyword' AS match_type, NULL AS dense_rank, rank AS lexical_rank FROM {lexical_hits}
    WHERE query_id IN (SELECT query_id FROM {routed} WHERE mode = 'lexical'))"""))
def lexical_search(v):
    asked = v["queries"].filter("mode = 'lexical'")
    hits = search.hybrid_search(asked, v["search_index"], v["videos"], v["flags"], dimension=DIMENSION, limit=LIMIT)
    return shown(hits.filter("match_type = 'keyword'"))


@query("bm25_search", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {lexical_hits}")
def bm25_search(v):
    asked = v["routed"].filter(_LEXICAL)
    return lexical.bm25_search(asked, v["search_index"], 100).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_any", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (" + bm25_sql(_LEXICAL, False) + ")")
def bm25_any(v):
    asked = v["routed"].filter(_LEXICAL)
    return lexical.bm25_search(asked, v["search_index"], 100, "any").select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("build_postings", """
SELECT chunk_id, root, count(*) AS tf, any_value(length) AS length
FROM (SELECT chunk_id, unnest(roots) AS root, len(roots) AS length FROM {index}) GROUP BY chunk_id, root""")
def build_postings(v):
    return lexical.build_postings(v["points"])


@query("quote_search", "SELECT query_id, chunk_id, score, rank FROM {quote_hits}")
def quote_search(v):
    return lexical.quote_search(v["routed"].filter("branch = 'quote'"), v["search_index"], 60)


@query("knn_search", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {dense_hits}")
def knn_search(v):
    asked = v["routed"].filter("branch = 'ranked' AND mode IN ('semantic', 'hybrid')")
    return vectors.knn_search(asked, v["index"], 100, DIMENSION).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("knn_cross", f"""
SELECT q.query_id, p.chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score,
       row_number() OVER (PARTITION BY q.query_id ORDER BY {_COSINE} DESC, p.chunk_id) AS rank
FROM {{queries}} q CROSS JOIN {{vectors}} p QUALIFY rank <= 10""")
def knn_cross(v):
    return vectors.knn_search(open_queries(v), bare_points(v), 10, DIMENSION).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def open_queries(v):
    """Queries stripped of their filters."""
    return filters.with_parsed_query(v["queries"].withColumns({
        "text": F.lit("x"), "video_type": F.lit("all"), "date_from": F.lit(None).cast("string"),
        "date_to": F.lit(None).cast("string")}))


def bare_points(v):
    """Vectors with neutral filter columns."""
    return v["vectors"].withColumns({"video_id": F.lit(0).cast("bigint"), "recorded_date": F.lit(0),
                                     "is_short": F.lit(False), "is_4k": F.lit(False)})


SPARK["vector_lists"] = lambda v: ivf.build_lists(bare_points(v), DIMENSION)

DUCK["sign_hits"] = f"""
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM (SELECT q.query_id, p.chunk_id, {_COSINE} AS score,
             row_number() OVER (PARTITION BY q.query_id ORDER BY list_sum(list_transform(range(1, 65),
               lambda i: CASE WHEN (q.embedding[i] > 0) <> (p.embedding[i] > 0) THEN 1 ELSE 0 END)), p.chunk_id) AS coarse
      FROM {{queries}} q CROSS JOIN {{vectors}} p QUALIFY coarse <= 100)
QUALIFY rank <= 10
"""


@query("knn_sign_bits", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {sign_hits}")
def knn_sign_bits(v):
    return vectors.knn_sign_bits(open_queries(v), bare_points(v), 10, DIMENSION).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_BAND = "list_transform(range(0, 64, 8), lambda b: list_transform(range(1, 9), lambda i: {x}[b + i] > 0))"
DUCK["lsh_hits"] = f"""
SELECT q.query_id, p.chunk_id, {_COSINE} AS score,
       row_number() OVER (PARTITION BY q.query_id ORDER BY {_COSINE} DESC, p.chunk_id) AS rank
FROM (SELECT *, {_BAND.format(x="embedding")} AS bands FROM {{queries}}) q
JOIN (SELECT *, {_BAND.format(x="embedding")} AS bands FROM {{vectors}}) p
  ON len(list_filter(range(1, 9), lambda b: q.bands[b] = p.bands[b])) > 0
QUALIFY rank <= 10
"""


@query("knn_lsh", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {lsh_hits}")
def knn_lsh(v):
    return vectors.knn_lsh(open_queries(v), bare_points(v), 10, DIMENSION).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


DUCK["exact_hits"] = f"""
SELECT q.query_id, p.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {_COSINE} DESC, p.chunk_id) AS rank
FROM {{queries}} q CROSS JOIN {{vectors}} p QUALIFY rank <= 10
"""


@query("knn_recall", """
SELECT e.query_id, round(count(s.chunk_id) / count(*), 6) AS recall
FROM {exact_hits} e LEFT JOIN {sign_hits} s ON s.query_id = e.query_id AND s.chunk_id = e.chunk_id GROUP BY e.query_id""")
def knn_recall(v):
    exact = vectors.knn_search(open_queries(v), bare_points(v), 10, DIMENSION)
    rough = vectors.knn_sign_bits(open_queries(v), bare_points(v), 10, DIMENSION)
    return vectors.recall(exact, rough).select("query_id", F.round("recall", 6).alias("recall"))


@query("ivf_recall", """
SELECT (SELECT count(*) FROM {vectors}) AS stored, (SELECT count(*) FROM {queries}) AS asked, TRUE AS reached""")
def ivf_recall(v):
    """Every vector is in a list, and the probed lists hold at least nine of ten true neighbours."""
    lists = v["vector_lists"]
    found = vectors.recall(vectors.knn_search(open_queries(v), bare_points(v), 10, DIMENSION), ivf.knn_ivf(open_queries(v), lists, 10, DIMENSION))
    stored = lists.vectors.agg(F.count("*").alias("stored"))
    return found.agg(F.count("*").alias("asked"), (F.avg("recall") >= 0.9).alias("reached")).crossJoin(stored).select("stored", "asked", "reached")


@query("knn_ivf")
def knn_ivf(v):
    return ivf.knn_ivf(open_queries(v), v["vector_lists"], 10, DIMENSION).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("rrf_rank", "SELECT query_id, chunk_id, rank FROM {lexical_hits} WHERE rank <= 100")
def rrf_rank(v):
    scored = lexical.bm25_search(v["routed"].filter(_LEXICAL), v["search_index"], 200).drop("rank")
    return ranking.top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], 100).select(
        "query_id", "chunk_id", "rank")


_FUSED_OUT = ("SELECT query_id, chunk_id, round(combined, 9) AS combined, match_type, round(semantic, 6) AS semantic, "
              "round(lexical, 6) AS lexical FROM {fused}")


def _fused(v):
    return search.ranked_candidates(v["routed"], v["search_index"], DIMENSION).select(
        "query_id", "chunk_id", F.round("combined", 9).alias("combined"), "match_type",
        F.round("semantic", 6).alias("semantic"), F.round("lexical", 6).alias("lexical"))


@query("rrf_merge", _FUSED_OUT)
def rrf_merge(v):
    return _fused(v)


@query("rrf_full_outer", "SELECT query_id, match_type, count(*) AS n, round(sum(combined), 6) AS total FROM {fused} "
                         "GROUP BY query_id, match_type")
def rrf_full_outer(v):
    return search.ranked_candidates(v["routed"], v["search_index"], DIMENSION).groupBy("query_id", "match_type").agg(
        F.count("*").alias("n"), F.round(F.sum("combined"), 6).alias("total"))


@query("branch_union", "SELECT query_id, chunk_id FROM {dense_hits} UNION SELECT query_id, chunk_id FROM {lexical_hits}")
def branch_union(v):
    return search.ranked_candidates(v["routed"], v["search_index"], DIMENSION).select("query_id", "chunk_id")


@query("topk_hits", f"SELECT query_id, chunk_id, round(combined, 9) AS combined, row_number() OVER (PARTITION BY query_id "
                    f"ORDER BY {_ORDER}) AS rank FROM {{fused}} QUALIFY rank <= 20")
def topk_hits(v):
    fused = search.ranked_candidates(v["routed"], v["search_index"], DIMENSION)
    return ranking.top_k(fused, ["query_id"], fusion.fusion_order(), LIMIT).select(
        "query_id", "chunk_id", F.round("combined", 9).alias("combined"), "rank")


@query("filter_only_search", "SELECT query_id, chunk_id, 'filter' AS match_type, score, rank FROM {filter_hits}")
def filter_only_search(v):
    found = filters.filter_only_matches(v["routed"].filter("branch = 'filter'"), v["index"])
    return ranking.top_k(found, ["query_id"], [F.asc("video_id"), F.asc("chunk_index")], LIMIT).select(
        "query_id", "chunk_id", F.lit("filter").alias("match_type"), F.lit(1.0).alias("score"), "rank")


@query("resort_by_index", """
SELECT query_id, chunk_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY chunk_index) AS place
FROM (SELECT q.query_id, p.chunk_id, p.chunk_index FROM {routed} q JOIN {index} p ON p.video_id = q.v_id
      WHERE q.clean = '' AND q.v_id <> 0) QUALIFY place <= 20""")
def resort_by_index(v):
    asked = v["routed"].filter("clean = '' AND v_id <> 0").select("query_id", "v_id")
    found = v["index"].join(asked, F.col("video_id") == F.col("v_id"))
    return ranking.top_k(found, ["query_id"], [F.asc("chunk_index")], LIMIT, "place").select(
        "query_id", "chunk_id", "chunk_index", "place")


@query("filter_query_video_id", "SELECT query_id, v_id, clean FROM {routed}")
def filter_query_video_id(v):
    return filters.with_parsed_query(v["queries"]).select("query_id", "v_id", "clean")


@query("point_payload", """
SELECT chunk_id, video_id, chunk_index, start_sec, end_sec, text, title, source_file_id, source_url, recorded_date,
       is_short, is_4k, TRUE AS is_primary FROM {points}""")
def point_payload(v):
    return v["points"].drop("embedding").withColumn("is_primary", F.lit(True))


@query("filter_video_type", "SELECT chunk_id, is_4k FROM {points} WHERE NOT is_short")
def filter_video_type(v):
    return filters.filter_video_type(v["points"], "long").select("chunk_id", "is_4k")


@query("filter_date_range", "SELECT chunk_id, recorded_date FROM {points} WHERE recorded_date <= 20200630")
def filter_date_range(v):
    return filters.filter_date_range(v["points"], None, "2020-06-30").select("chunk_id", "recorded_date")


@query("filter_scan", "SELECT chunk_id, video_id, chunk_index FROM {points} WHERE is_4k ORDER BY video_id, chunk_index LIMIT 50")
def filter_scan(v):
    return filters.scroll(v["points"], F.col("is_4k"), ["video_id", "chunk_index"], 50).select(
        "chunk_id", "video_id", "chunk_index")


@query("hydrate_hits", """
SELECT h.query_id, h.chunk_id, p.video_id, v.title, v.source_file_id FROM {lexical_hits} h JOIN {index} p USING (chunk_id)
LEFT JOIN {videos} v ON v.id = p.video_id""")
def hydrate_hits(v):
    hits = lexical.bm25_search(v["routed"].filter(_LEXICAL), v["search_index"], 100).select("query_id", "chunk_id")
    return search.hydrate(hits, v["index"], v["videos"], v["flags"]).select(
        "query_id", "chunk_id", "video_id", "title", "source_file_id")


@query("dedupe_time_bucket", """
SELECT chunk_id, video_id, round_even(start_sec * 2, 0) / 2 AS bucket FROM {points}
QUALIFY row_number() OVER (PARTITION BY video_id, round_even(start_sec * 2, 0) / 2 ORDER BY chunk_id) = 1""")
def dedupe_time_bucket(v):
    hits = v["points"].withColumn("query_id", F.lit(0))
    return search.dedupe_time_bucket(hits, [F.asc("chunk_id")]).select(
        "chunk_id", "video_id", identity.half_second(F.col("start_sec")).alias("bucket"))


@query("diversify", """
SELECT chunk_id, video_id FROM {points} QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY chunk_index DESC) <= 3""")
def diversify(v):
    hits = v["points"].withColumns({"query_id": F.lit(0), "v_id": F.lit(None).cast("bigint")})
    return search.diversify(hits, [F.desc("chunk_index")]).select("chunk_id", "video_id")


@query("chunk_utterances", "SELECT video_id, chunk_index, start_sec, end_sec, text FROM {derived_chunks}")
def chunk_utterances(v):
    return v["derived_chunks"]


_SINGLE = """SELECT video_id, 0 AS chunk_index, min_by(start, pos) AS start_sec, max_by("end", pos) AS end_sec,
       string_agg(text, ' ' ORDER BY pos) AS text FROM {utterances} {where} GROUP BY video_id"""


@query("single_chunk", _SINGLE.replace("{where}", ""))
def single_chunk(v):
    return chunking.single_chunk(v["utterances"])


DUCK["rechunked"] = (
    "SELECT c.* FROM {derived_chunks} c JOIN {videos} v ON v.id = c.video_id WHERE v.original_id IS NULL AND NOT v.is_short "
    "UNION ALL " + _SINGLE.replace("{where}", "WHERE video_id IN (SELECT id FROM {videos} WHERE original_id IS NULL AND is_short)"))


@query("rechunk_all", "SELECT * FROM {rechunked}")
def rechunk_all(v):
    return chunking.rechunk_videos(v["videos"], v["utterances"])


# The stored set is an older chunking: coarser pauses, some rows lost.
DUCK["stored_chunks"] = """
SELECT video_id * 1000000 + chunk_index AS id, video_id, chunk_index, start_sec, end_sec,
       CASE WHEN (video_id + chunk_index) % 7 = 0 THEN concat(text, ' old') ELSE text END AS text
FROM {derived_chunks} WHERE (video_id * 3 + chunk_index) % 5 <> 0
UNION ALL SELECT video_id * 1000000 + 900, video_id, 900, start_sec, end_sec, text FROM {derived_chunks} WHERE chunk_index = 1
"""


def stored_chunks(v):
    base = v["derived_chunks"].withColumn("id", F.col("video_id") * 1000000 + F.col("chunk_index"))
    old = F.when((F.col("video_id") + F.col("chunk_index")) % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    kept = base.filter((F.col("video_id") * 3 + F.col("chunk_index")) % 5 != 0).withColumn("text", old)
    gone = base.filter("chunk_index = 1").withColumns({
        "id": F.col("video_id") * 1000000 + 900, "chunk_index": F.lit(900)})
    return kept.unionByName(gone)


_HASH = """sha256(concat('{{"end_sec":', {p}end_sec, ',"start_sec":', {p}start_sec, ',"text":',
    to_json(trim({p}text, E' \\t\\n\\r')), '}}'))"""


@query("chunk_diff", """
SELECT COALESCE(n.video_id, s.video_id) AS video_id, COALESCE(n.chunk_index, s.chunk_index) AS chunk_index, s.id AS chunk_id,
       CASE WHEN s.id IS NULL THEN 'insert' WHEN n.video_id IS NULL THEN 'delete'
            WHEN n.text = s.text AND n.start_sec = s.start_sec AND n.end_sec = s.end_sec THEN 'unchanged' ELSE 'update' END AS action,
       CASE WHEN n.video_id IS NULL THEN 'delete' ELSE 'upsert' END AS event_type
FROM {derived_chunks} n FULL JOIN {stored_chunks} s ON n.video_id = s.video_id AND n.chunk_index = s.chunk_index""")
def chunk_diff(v):
    new = chunking.with_identity(v["derived_chunks"], v["videos"])
    old = chunking.with_identity(stored_chunks(v), v["videos"])
    return chunking.chunk_diff(new, old, 1).drop("event_key")


@query("toggle_short", """
SELECT c.video_id, c.chunk_index, c.text FROM {derived_chunks} c JOIN {videos} v ON v.id = c.video_id
WHERE v.is_short AND v.original_id IS NULL
UNION ALL SELECT video_id, chunk_index, text FROM (""" + _SINGLE.replace(
    "{where}", "WHERE video_id IN (SELECT id FROM {videos} WHERE NOT is_short AND original_id IS NULL)") + ")")
def toggle_short(v):
    flipped = v["videos"].withColumn("is_short", ~F.col("is_short"))
    return chunking.rechunk_videos(flipped, v["utterances"]).select("video_id", "chunk_index", "text")


@query("quote_match", f"""
SELECT query_id, chunk_id FROM {{quote_hits}}""")
def quote_match(v):
    asked = v["routed"].filter("branch = 'quote'")
    hits = lexical.quote_search(asked, v["search_index"], 60).select("query_id", "chunk_id")
    text = v["index"].select("chunk_id", "text").join(hits, "chunk_id")
    checked = text.join(asked.select("query_id", "clean"), "query_id")
    return checked.filter(lexical.quote_match(F.col("text"), tx.tokens(F.col("clean")))).select("query_id", "chunk_id")


@query("result_projection", """
SELECT p.chunk_id, COALESCE(nullif(v.title, ''), p.title, 'Unknown Video') AS title,
       COALESCE(p.source_url, concat('https://drive.google.com/file/d/', v.source_file_id, '/view')) AS source_url
FROM {points} p LEFT JOIN {videos} v ON v.id = p.video_id""")
def result_projection(v):
    meta = v["videos"].select(F.col("id").alias("video_id"), F.col("title").alias("video_title"),
                              F.col("source_file_id").alias("video_file_id"))
    return point_ops.result_projection(v["points"].join(meta, "video_id", "left")).select(
        "chunk_id", "title", "source_url")


@query("nonblank_chunks", "SELECT chunk_id FROM {points} WHERE length(trim(text)) > 1")
def nonblank_chunks(v):
    return filters.nonblank_chunks(v["points"]).select("chunk_id")


@query("hashed_embedding", f"""
SELECT chunk_id, slot, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS FLOAT) AS DOUBLE), 5) AS weight
FROM (SELECT chunk_id, CAST(('0x' || left(md5(w), 7)) AS BIGINT) % 64 AS slot, count(*) AS n
      FROM (SELECT chunk_id, unnest({tokens_sql("text")}) AS w FROM {{points}}) GROUP BY chunk_id, slot)""")
def embed_chunks(v):
    vectors_ = vectors.embed_chunks(v["points"].select("chunk_id", "text"), dimension=DIMENSION)
    return vectors_.select("chunk_id", F.posexplode("embedding").alias("slot", "w")).filter("w > 0").select(
        "chunk_id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("w").cast("double"), 5).alias("weight"))
