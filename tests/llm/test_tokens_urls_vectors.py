"""URL rules, aligned tokens and centroid clusters against plain versions and on odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vocarium.llm import centroids, queries, token_alignment as ta, url_rules as ur

FOLDER = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(name) for name in (queries.TOKENIZER, queries.PIECES))


# --- URL rules ---


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


SITES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain_site(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://net/", "http://net", "http://a.NET/x", "http://xnet/", "http://a.net.x/", "http://a.net?q=1/", "HTTP://B.Example.NET/en/1#t",
    "http://example.net/EN/1", "http://a.example.com/de/x", "http://a.example.com/de", "http://a.org/fr/", "http://a.org/x.net/", "http://user@net/", "http://net:80/",
    "http://é.net/ü", "http://x://y.net/", "http://a.b/\n.net/", "http://cheap-pills.b/", "http://a.b/CASINO", "http://a.b/casino", "http://.net/", "x" * 200_000, "http://" + "a." * 100_000 + "net/" + "p" * 50_000,
]


def test_site_rules_and_words(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(ODD_URLS * 2)] + [(None, "http://net/", "", "")],
                                  "page_id long, url string, verdict string, canonical string")
    got = ur.judge(pages, ur.SITES + ur.WORDS).collect()
    assert len(got) == 2 * len(ODD_URLS) + 1
    for row in got:
        host, path = plain_parts(ODD_URLS[row["page_id"] % len(ODD_URLS)]) if row["page_id"] is not None else ("net", "/")
        assert (row["host"], row["path"]) == (host, path)
        rule = plain_site(host, path)
        blocked = any(r.name in host + path for r in ur.WORDS)
        assert (row["name"] if row["tier"] == 0 else None, row["verdict"]) == (rule or (None, "block" if blocked else "allow"))
    assert ur.judge(pages.limit(0), ur.SITES).count() == 0
    assert {r["verdict"] for r in ur.judge(pages, [], "block").collect()} == {"block"}


def test_automaton_equals_patterns():
    """Random globs over several words against regular expressions."""
    draw = random.Random(3)
    alphabet = ["a", "b", "/", ".", "é", "*", "**", "?", "\\*", "語"]
    rules = ur.ordered(ur.Rule(f"r{i}", "".join(draw.choices(alphabet, k=draw.randint(0, 9))), draw.choice(["block", "allow"]), draw.randint(0, 1)) for i in range(90))
    automaton = ur.compile_rules(rules)
    assert len(automaton.start) > 4
    patterns = [re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}[t] if wild else re.escape(t) for t, wild in ur.tokens(r.glob))) for r in rules]
    texts = ["".join(draw.choices(["a", "b", "/", ".", "é", "語", "*"], k=draw.randint(0, 12))) for _ in range(1500)] + ["", "a" * 3000]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = ur.matches(automaton, np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [next((i for i, p in enumerate(patterns) if p.fullmatch(t)), -1) for t in texts]
    assert got.tolist() == want and len(set(want)) > 10


def test_rules_are_ranked():
    ranked = ur.ordered([ur.anywhere("long word", "allow"), ur.site("a", "/", "allow"), ur.site("b", "/", "block"), ur.site("abc", "/", "allow"), ur.site("a", "/", "allow")])
    assert [r.name for r in ranked] == ["abc/", "b/", "a/", "long word"]
    with pytest.raises(ValueError):
        ur.compile_rules([ur.anywhere("x" * (ur.MOST_BITS + 1), "block")])


# --- aligned tokens ---


def plain_alignment(texts):
    """All columns but the id, from whole texts and decoded bytes alone."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet, entries = ta.byte_alphabet(), {i: e for e, i in tok.get_vocab(with_added_tokens=True).items()}

    def piece_bytes(i):
        p = sp.id_to_piece(i)
        m = re.fullmatch("<0x([0-9A-F]{2})>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        if not text:
            docs.append([])
            continue
        raw = (" " + text).encode()
        a = [(i, bytes(alphabet[c] for c in entries[i])) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece_bytes(i)) for i in sp.encode(text)]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            docs.append([])
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to_i, to_j = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(([x for x, _ in a[i:to_i]], [x for x, _ in b[j:to_j]]))
            i, j = to_i, to_j
        docs.append(groups)
    links = [Counter((x, y) for left, right in groups for x in left for y in right) for groups in docs]
    count = Counter(pair for own in links for pair in own)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for groups, own in zip(docs, links, strict=True):
        text = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

ODD_TEXTS = [
    None, "", " ", "  ", "   ", "\n", "\n\n", " \n ", "a", " a", "a ", "a  ", "a  b", "a   b  c ", "a\n b", "a \nb", "a\n\n b\n", "\ta\t b", "x\u00a0 y \u2003z", "▁x", "a ▁", "é€😀 日本語", "😀" * 50,
    "\x00龘 x", "<|endoftext|> <s> <unk> <0x41>", "don't we'll I'm", "1234567890 12 345", "====" * 40, "a" * 5000, " " * 3000 + "b", "wörd " * 400, "\u180e x\u200b y", "日本 語 " * 30,
    "\r\n x\r y;\r\n", "e\u0301 \u0301x", "﷽ \u202e abc", "\ufeffa b", "the the the", "the", "the of", "of of",
]


def check_alignment(spark, texts, monkeypatch=None):
    rows = [(i, t, "clash", "clash", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pairs string, place int").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.alignment(docs, A, B).collect()}
    want = plain_alignment(texts)
    assert {i: (texts[i], g) for i, g in got.items()} == {i: (t, w) for i, (t, w) in enumerate(zip(texts, want, strict=True))}


def test_alignment_of_odd_texts(spark):
    check_alignment(spark, ODD_TEXTS)


def test_alignment_of_random_texts(spark):
    draw = random.Random(11)
    bits = ["a", "Z", " ", "  ", "\n", "é", "日", "😀", "the", " of", "ing", "1", "\t", "▁", "\u00a0", "'s", "=", "\r"]
    check_alignment(spark, ["".join(draw.choices(bits, k=draw.randint(1, 40))) for _ in range(400)])


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = dict(zip([i for i, _ in rows], plain_alignment([t for _, t in rows]), strict=True))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.alignment(docs, A, B).collect()} == want


def test_alignment_in_many_blocks(monkeypatch):
    """Small blocks and runs cut documents apart and give the same pairs."""
    texts = [t or "" for t in ODD_TEXTS] * 3
    pair = ta.Pair(A, B)
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    whole = ta._Part(batch.column(1), pair)
    parts = [ta._Part(run.column(1), pair) for run in ta._runs(batch, 64)]
    assert len(parts) > 30
    assert [g for p in parts for g in p.groups.to_pylist()] == whole.groups.to_pylist()
    assert np.concatenate([p.pair for p in parts]).tolist() == whole.pair.tolist()
    assert np.concatenate([p.links for p in parts]).tolist() == whole.links.tolist()
    monkeypatch.setattr(ta, "UNITS", 5)
    assert ta._Part(batch.column(1), ta.Pair(A, B)).groups.to_pylist() == whole.groups.to_pylist()
    uncut = ta.Pair(A, B)
    uncut.cuts = False
    assert ta._Part(batch.column(1), uncut).groups.to_pylist() == whole.groups.to_pylist()


def test_alignment_repeats_nulls_and_emptiness(spark):
    docs = spark.createDataFrame([(7, "one two"), (7, "one two"), (None, "one two"), (None, None)], "doc_id long, text string")
    rows = ta.alignment(docs, A, B).collect()
    assert sorted((r["doc_id"] is None, r["n_links"], r["count_sum"]) for r in rows) == [(False, 2, 6), (False, 2, 6), (True, 0, 0), (True, 2, 6)]
    assert ta.alignment(docs.limit(0), A, B).count() == 0


def test_groups_and_spans(spark):
    docs = spark.createDataFrame([(1, "hello wörld"), (2, None)], "doc_id long, text string")
    groups = ta.token_groups(docs, A, B)
    assert {r["doc_id"]: r["groups"] == "" for r in groups.collect()} == {1: False, 2: True}
    rows = ta.spans(groups).orderBy("place").collect()
    tok = Tokenizer.from_file(A)
    assert [i for r in rows for i in r["a_ids"]] == tok.encode(" hello wörld").ids
    assert [i for r in rows for i in r["b_ids"]] == sentencepiece.SentencePieceProcessor(model_file=B).encode("hello wörld")


# --- centroids ---


def plain_clusters(rows, k=8, rounds=10, seed=3, dimension=64, scale=1024):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        after = []
        for i, c in enumerate(centres):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == i]
            after.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else c)
        centres = after
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for i, c, d in found), key=repr)


def clusters(df, **options):
    return sorted((tuple(r) for r in centroids.described(*centroids.cluster(df, **options)).collect()), key=repr)


def test_clusters(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert clusters(df.repartition(5)) == plain_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_clusters_of_odd_vectors(spark):
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.5, 0.25, 3.0, -0.001]) for _ in range(4)]) for i in range(40)]
    rows += [(3, [0.25] * 4), (3, [0.25] * 4), (None, [9.0, 9.0, 9.0, 9.0]), (50, None), (51, []), (52, [1.0] * 3), (53, [1.0, None, 1.0, 1.0]),
             (54, [1.0, float("nan"), 1.0, 1.0]), (55, [1.0, float("inf"), 1.0, 1.0]), (56, [1e5, -1e5, 0.0, -0.0])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, steps string, cluster int").repartition(4)
    for k in (1, 3, 60):
        assert clusters(df, k=k, dimension=4, rounds=4) == plain_clusters(rows, k=k, dimension=4, rounds=4)
    assert clusters(df.limit(0)) == []
    far = spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clusters(far, dimension=4)
