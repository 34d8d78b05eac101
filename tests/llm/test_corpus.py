"""Operators over the whole corpus, and the pipeline, against brute force and on odd inputs."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vocarium.llm import decontamination, mixing, simhash

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies string, root string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", "clash") for i, t, s in rows], DOCS)


# --- SimHash ---


def plain_fingerprint(text, n=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Root position of every position, over all links."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == {k: (simhash.signed(p), rows[r][0]) for (k, _), p, r in zip(rows, prints, roots)}


def test_links_within_dense_groups(spark):
    draw = random.Random(5)
    values = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(150):
            value = centre
            for bit in draw.sample(range(64), draw.randint(0, 5)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values | {draw.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components(values)
    groups = lambda labels: {frozenset(k for k, _ in g) for _, g in itertools.groupby(
        sorted(labels.items(), key=lambda x: x[1]), key=lambda x: x[1])}
    own = {simhash.signed(v): roots.get(simhash.signed(v), simhash.signed(v)) for v in values}
    assert groups(own) == groups({simhash.signed(v): w for v, w in zip(values, want)})


def test_shards_hold_every_link():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in draw.choice(64, 3, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    same = [x == y for x, y in zip(simhash.shard_keys(a), simhash.shard_keys(b))]
    assert np.any(same, axis=0).all()


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = simhash.components(edges).collect()
    assert len({r["root"] for r in roots if r["node"] <= 300}) == 1
    assert len(roots) == 303 and len({r["root"] for r in roots}) == 2


def test_odd_duplicates(spark):
    rows = [(3, "a b c d e f", "s"), (2, "A b C d e f", "s"), (2, "A b C d e f", "s"), (4, None, "s"), (5, "", "s"), (None, "  ", "s"),
            (None, "z y x w v u t", "s"), (2, "quite another text of some words", "s")]
    df = frame(spark, rows)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter([(3, 2), (2, 2), (2, 2), (4, 4), (5, 4), (None, 4), (None, None), (2, 2)])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 2, 4, None])
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_kept_documents_are_not_alike(spark):
    """Brute force over five-word shingle sets of the pages of a book and edited copies of them."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(draw.choices(words, k=draw.randint(3, 150))) for _ in range(60)]
    for text in texts[:40]:
        for _ in range(draw.randint(1, 12)):
            copy = text.split()
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    root = list(range(len(texts)))
    far = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            far += (plain_fingerprint(texts[a], 5) ^ plain_fingerprint(texts[b], 5)).bit_count() > 3
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    kept = simhash.keep_one(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), 5, similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and far > 50


def test_marks_rule_out_no_alike_sets():
    draw = np.random.default_rng(4)
    for size in (1, 7, 150, 2000):
        a = np.unique(draw.integers(0, 1 << 64, size, dtype=np.uint64))
        for changed in (0, 1, size // 9, size):
            b = np.unique(np.concatenate([a[changed:], draw.integers(0, 1 << 64, changed, dtype=np.uint64)]))
            differ = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(simhash.set_marks(a), simhash.set_marks(b)))
            assert differ <= len(np.setxor1d(a, b)) and (differ > 0) == (changed > 0)


def test_texts_of_a_common_passage_are_no_candidates(spark, monkeypatch):
    """Texts that share bands but are not alike: candidates do not grow with the square of their number."""
    draw = random.Random(9)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join(passage + [f"q{draw.randrange(10 ** 9)}" for _ in range(draw.randint(34, 40))]) for _ in range(300)]
    texts += [f"{t} end" for t in texts[:20]]
    asked, confirmed = [], simhash.confirmed

    def counted(pairs, sets, similarity):
        asked.append(pairs.distinct().count())
        return confirmed(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "confirmed", counted)
    kept = simhash.keep_one(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), 5, similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300)) and sum(asked) < 4 * len(texts)


# --- decontamination ---


def edits(a, b):
    """Fewest word edits between ``a`` and any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contaminated_equals_brute_force(spark, documents):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [(r["item_id"], decontamination.words_of(r["text"])) for r in benchmark.collect()]
    want = {}
    short = documents.filter("length(text) < 1500")
    for r in short.collect():
        words = decontamination.words_of(r["text"])
        for key, item in items:
            if len(set(item) & set(words)) >= 0.5 * len(set(item)):
                distance = edits(item, words)
                if distance <= decontamination.bound(len(item)):
                    want[r["doc_id"], key] = distance
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(short, benchmark).collect()}
    assert got == want and want


def test_edited_passages_are_found():
    draw = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(12, 60)))) for k in range(120)]
    matcher = decontamination.Matcher(items)
    texts = []
    for _, text in items:
        words = text.split()
        for _ in range(draw.randint(0, decontamination.bound(len(words)))):
            at = draw.randrange(len(words))
            words[at:at + 1] = draw.choice(([], ["new"], ["new", words[at]]))
        around = draw.choices(vocabulary, k=40)
        texts.append(" ".join(around + words + around))
    found = {(text, item) for text, item, *_ in matcher.match(texts)}
    assert sum((k, k) in found for k in range(len(items))) >= 0.95 * len(items)


def test_nearest_window():
    draw = random.Random(4)
    for _ in range(300):
        a, b = [draw.randint(1, 4) for _ in range(draw.randint(1, 8))], [draw.randint(0, 4) for _ in range(draw.randint(0, 15))]
        start, size, found = decontamination.nearest_window(np.array(a), np.array(b, int))
        assert found == edits(a, b)
        row = list(range(size + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b[start:start + size]):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert row[-1] == found


def test_odd_contamination(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    df = frame(spark, [(1, f"well {passage} indeed", "s"), (1, f"well {passage} indeed", "s"), (2, None, "s"), (3, "", "s"), (None, passage, "s"),
                       (4, "nothing of the kind", "s"), (5, "x " * 100_000 + passage, "s")])
    items = spark.createDataFrame([(7, passage, "c"), (8, None, "c"), (9, "", "c"), (None, "stone bridge", "c")], "item_id long, text string, doc_id string")
    got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(df, items).collect())
    assert got == Counter({(d, i, 0): n for d, n in ((1, 2), (None, 1), (5, 1)) for i in (7, None)})
    assert sorted(r["doc_id"] for r in decontamination.clean(df, items).collect()) == [2, 3, 4]
    # A clean row stays although another one with its id, or without one, goes.
    more = df.union(frame(spark, [(1, "clean words of an own", "s"), (None, "no id but clean", "s"), (None, None, "s")]))
    assert Counter(r["doc_id"] for r in decontamination.clean(more, items).collect()) == Counter([1, 2, 3, 4, None, None])
    assert decontamination.contaminated(df, items.limit(0)).count() == 0
    assert decontamination.clean(df.limit(0), items).columns == df.columns


# --- mixing ---


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, cap = mixing.SHARE * sum(sizes.values()), {s: 2.0 * sizes[s] for s in sizes}
    full = set()
    while True:
        rest = total - sum(cap[s] for s in full)
        room = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[r] for r in room) for s in room}
        over = {s for s in room if share[s] > cap[s]}
        if not over:
            return share | {s: cap[s] for s in full}
        full |= over


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken")
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["taken"]) for r in rows)


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document's copies average what its length class is to have."""
    df = frame(spark, [(i, " ".join(["w"] * (4 if i % 2 else 40)), "a") for i in range(40)])
    totals = Counter()
    for seed in range(12):
        for r in mixing.mix(df, share=1.0, seed=seed).collect():
            totals[r["size"]] += r["copies"]
    assert totals[40] > totals[4] and abs((40 * totals[40] + 4 * totals[4]) / 12 / 880 - 1) < 0.05


def test_odd_mix(spark):
    df = frame(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e f g", None), (4, "h " * 5000, "y"), (5, "i", "\U0001f600")])
    rows = mixing.mix(df).collect()
    assert len(rows) == 7 and sum(r["size"] for r in rows) == 3 + 3 + 4 + 5000 + 1
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0
    taken = mixing.repeated(df, mixing.mix(df).filter("doc_id = 4"))
    assert taken.columns == df.columns


# --- pipeline ---


def plain_kept(texts, similarity=0.8):
    """Smallest id of each component over all pairs of five-word shingle sets at least this similar."""
    sets = {}
    for key, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[key] = frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    root = {key: key for key in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if root[a] != root[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {key: low if r == high else r for key, r in root.items()}
    return set(root.values())


def test_pipeline(spark, documents):
    """Each stage against a plain version of its decision."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        before, ids = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in after.collect())
        if name != "token_files":
            assert after.columns == documents.columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 0").collect()
            assert sum(r["doc_id"] in ids for r in labels) >= 0.98 * len(labels)
        if name == "simhash":
            assert set(ids) == plain_kept({r["doc_id"]: r["text"] for r in docs.collect()})
        if name == "decontamination":
            found = decontamination.contaminated(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()
            assert set(ids) == set(before) - {r["doc_id"] for r in found}
        if name == "mix":
            assert set(ids) <= set(before) and max(ids.values()) <= 2
        if name == "token_files":
            assert ids == before
        docs = after


def test_mixed_rows_are_copies(documents):
    mixed = mixing.mix(documents)
    rows = Counter(r["doc_id"] for r in mixing.repeated(documents, mixed).select("doc_id").collect())
    assert rows == Counter({r["doc_id"]: r["copies"] for r in mixed.filter(F.col("copies") > 0).collect()})


def test_rows_with_one_id_are_mixed_apart(spark):
    rows = [(7, f"one two three {i}", "a") for i in range(6)] + [(None, f"four five {i}", "b") for i in range(5)] + [(None, "six seven", "b")] * 3
    df = frame(spark, rows + [(i, "eight nine ten", "c") for i in range(20, 30)])
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mixed(spark, df, FOLDER).collect())
    given = Counter(rows)
    want = sum(r["copies"] for r in mixing.mix(df).collect())
    assert sum(got.values()) == want and all(n <= 2 * given.get(k, 1) for k, n in got.items()) and set(got) <= set(map(tuple, df.select("doc_id", "text", "source").collect()))
    assert {k[0] for k in got} >= {7, None}
