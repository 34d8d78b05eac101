"""Operators that read one text at a time, against plain versions and on odd inputs."""

import html
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from vocarium.llm import chat, html_text, language_model, licences, rules, token_files, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string"
ODD = [(1, None), (2, ""), (3, "One two.\nOne two.\n"), (3, "One two.\nOne two.\n"), (None, "no id"), (4, "\t\n  "),
       (5, "long words " * 30_000), (6, "é" * 10 + " x"), (2, "same id, other text")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash") for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# --- token files ---


def expected_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    start, out = 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_token_files_round_trip(documents):
    got = token_files.token_files(documents, TOKENIZER).orderBy("doc_id").collect()
    rows = documents.orderBy("doc_id").select("doc_id", "text").collect()
    assert [tuple(r) for r in got] == expected_tokens(rows)


def test_token_files_of_odd_rows(odd, none):
    got = sorted(map(tuple, token_files.token_files(odd, TOKENIZER).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i))
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((k, n, c) for k, _, n, c in expected_tokens(ODD))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert token_files.token_files(none, TOKENIZER).count() == 0


def test_pieces_encode_as_the_whole_text():
    draw, letters = random.Random(1), " \n\té'sx.,1A 　|×<>"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "it's 'x's don't ,, ..\n...\nA\n\nB\r\nC", "日本 語\n😀 😀\n"]
    encoder = token_files.Encoder(TOKENIZER, remembered=500)
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        got = encoder.encode([t.encode() for t in part])
        assert [g.tolist() for g in got] == [encoder._ids(t) for t in part]


def test_frames_are_independent_and_checked(spark, documents, tmp_path):
    token_files.write_token_files(documents, TOKENIZER, str(tmp_path / "t"), file_ids=5000)
    files = sorted((tmp_path / "t").glob("part-*"))
    assert len(files) > 3
    with files[0].open("rb") as file:
        reader = token_files.Reader.of_file(file)
        ids = np.frombuffer(reader.plain_bytes(1), "<u4")
    assert ids[-1] == 0
    whole = zstandard.ZstdDecompressor().stream_reader(files[0].read_bytes(), read_across_frames=True).read()
    assert len(whole) == int(reader.plain.sum())
    wanted = spark.createDataFrame([(5,), (77,), (None,)], "doc_id long")
    picked = token_files.read_token_files(spark, str(tmp_path / "t"), wanted).drop("ids").collect()
    every = {r["doc_id"]: r for r in token_files.read_token_files(spark, str(tmp_path / "t")).drop("ids").collect()}
    assert {r["doc_id"]: r for r in picked} == {k: every[k] for k in (5, 77)}
    content = bytearray(files[0].read_bytes())
    content[10] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader.of_bytes(bytes(content)).plain_bytes(0)


# --- quality rules ---


def plain_measures(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_ledger(documents, odd, none):
    for df in (documents, odd):
        want = Counter((r["doc_id"], *plain_measures(r["text"] or "")) for r in df.collect())
        got = rules.ledger(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(map(tuple, got)) == want
    assert rules.ledger(none).count() == 0


def test_policies_and_ablations(documents, none):
    book = rules.ledger(documents).cache()
    rows = rules.apply_policy(book).collect()
    mask = rules.mask_of(rules.POLICIES[rules.LATEST])
    assert all(r["kept"] == (r["fail_bits"] & mask == 0) for r in rows)
    assert rules.apply_policy(book, 1).filter("kept").count() >= sum(r["kept"] for r in rows)
    for r in rules.ablations(book).collect():
        bit = rules.mask_of([r["rule"]])
        bits = [x["fail_bits"] & mask for x in rows]
        assert (r["fails"], r["sole"], r["kept_without"]) == (
            sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    assert rules.ablations(rules.ledger(none)).count() == 0


# --- toxicity ---


def test_toxicity_held_out(spark, odd, none):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) > 0.97 * len(rows)
    assert sum(r["predicted"] for r in rows if r["toxic"]) > 0.85 * sum(r["toxic"] for r in rows)
    scored = toxicity.toxicity(odd, labels)
    assert scored.count() == len(ODD) and scored.filter("score IS NULL OR predicted <> 0").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    empty = labels.limit(0)
    assert toxicity.toxicity(odd, empty).filter("predicted = 0").count() == len(ODD)
    assert toxicity.drop_toxic(odd, empty).columns == odd.columns and toxicity.drop_toxic(odd, empty).count() == len(ODD)


def test_swapped_groups_score_alike(spark):
    """Toxic examples name one group only; the penalty keeps its name from carrying the verdict."""
    names = ["idiot", "scum", "moron"]
    rows = [(i, f"the muslim people here are {names[i % 3]} again", 1) if i % 2 else (i, "the people here are kind again", 0)
            for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = "my muslim neighbours bake bread"
    value = {}
    for fairness in (0.0, 5.0):
        model = toxicity.fit(docs, labels, fairness=fairness)
        value[fairness] = abs(sum(model.get(f, 0.0) for f in toxicity.features(neutral)))
    assert sum(model.get(f, 0.0) for f in toxicity.features("scum")) + model[""] > model.get("muslim", 0.0) + model[""]
    assert value[5.0] < 0.5 * value[0.0]


# --- pages ---


def test_main_text_of_odd_pages(spark):
    shared = "<div>Menu of the site</div>"
    pages = [(1, "https://a.org/x/1", f"<body>{shared}<div>first &amp; only</div>"), (2, "https://a.org/x/2", f"<body>{shared}<div>second</div>"),
             (3, None, None), (4, "no url", "<p>a<p>b <b>c"), (None, "https://b.org/", ""), (5, "https://c.org/z", "x < y"),
             (6, "https://a.org/far", "<article><p>kept</p><div class='ad'>no</div><aside>no</aside><p>also &lt;</p></article><p>out</p>"),
             (6, "https://a.org/far", "<article><p>kept</p><div class='ad'>no</div><aside>no</aside><p>also &lt;</p></article><p>out</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = html_text.main_text(df).collect()
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in rows)
    want = [(1, "first & only"), (2, "second"), (3, ""), (4, "a\nb c"), (None, ""), (5, "x < y"), (6, "kept\nalso <"), (6, "kept\nalso <")]
    assert got == Counter((k, t, len(t)) for k, t in want)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_keep_its_text(spark):
    page = "<body><div>Menu of the whole site</div><div>{} of the long article about trees</div><ul><li>{} point of it</ul><div>Seen {} times</div>"
    page = page.replace(" trees", ", trees" * 60)
    pages = [(i, f"https://a.org/t/1?page={i}", page.format("Text", "First", i)) for i in range(12)]
    pages += [(20, "https://a.org/print/1", page.format("Text", "First", "no")), (30, "https://a.org/t/2", page.format("Words", "Last", "7")),
              (40, "https://b.org/x", page.format("Only", "One", "3")), (41, "https://b.org/y", page.format("Only", "One", "3"))]
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    both = ["Text of the long article about" + ", trees" * 60, "First point of it"]
    assert all([line for line in got[i] if "Seen" not in line] == both and "Menu" not in got[i] for i in (*range(12), 20))
    assert got[30][:2] == ["Words of the long article about" + ", trees" * 60, "Last point of it"]
    assert len(got[40]) == len(got[41]) == 4


def test_cue_words_alone_drop_no_article():
    def lines(page):
        return {line: verdict for line, verdict in html_text.lines_of(page)}

    text = "<h2 id='related-work'>Related work</h2><section id='search-algorithms'><p>Trees are searched</p></section><p class='teaser'>In short</p>"
    for page in (f"<body class='has-sidebar'><article class='post comments-open'>{text}</article>", f"<main id='search'>{text}</main>"):
        assert lines(page) == {"Related work": html_text.KEPT, "Trees are searched": html_text.OPEN, "In short": html_text.OPEN}
    assert lines("<article><div class='ad'>Buy</div><p>Text</p><div class='box comments'><p>Me too</p></div></article>") == {
        "Buy": html_text.DROPPED, "Text": html_text.KEPT, "Me too": html_text.DROPPED}


def test_alignment_is_longest():
    draw = random.Random(0)
    for _ in range(300):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 25))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        found = html_text.shared(a, b)
        rest = iter(b)
        assert len(found) == best[-1, -1] and all(any(a[i] == y for y in rest) for i in found)


def test_main_text_of_the_table(spark):
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.main_text(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", source[r["page_id"]], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"<[a-z/!][^>]*\Z", "", body))
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in parts]
        assert r["text"] == "\n".join(b for b in blocks if b)


# --- licences ---


def test_new_words_are_not_searched_for_words():
    """Signs after a space are pieces of their own, and words go to the tokenizer without its pattern."""
    assert token_files.pieces(b"ab | cd #e") == [b"ab", b" |", b" cd", b" #e"]
    encoder = token_files.Encoder(TOKENIZER)
    texts = ["\u00e9t\u00e9 zzyx | Zzyx |abc  # \n| x\t|y", "zz'll \u00d7 zz\u00f7 '|' 12 |3 <|endoftext|>", ""]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    seen = []

    class Noted:
        def encode_batch_fast(self, given, **options):
            seen.extend(given)
            return words.encode_batch_fast(given, **options)

    words, encoder.words = encoder.words, Noted()
    assert [ids.tolist() for ids in encoder.encode([t.encode() for t in texts])] == want
    assert "\u0120zzyx" in seen[0].split("\u010a")


def test_short_pieces_with_zero_bytes():
    encoder = token_files.Encoder(TOKENIZER)
    docs = ["", "a", "a\0", "\0\0", "the\0 the", "word\nword", "", " abcdefgh abcdefghi", "\0"]
    whole = [encoder.tokenizer.encode(d, add_special_tokens=False).ids for d in docs]
    for _ in range(2):  # learned, then known
        assert [ids.tolist() for ids in encoder.encode([d.encode() for d in docs])] == whole
    assert [ids.tolist() for ids in encoder.encode([b""])] == [[]] and encoder.encode([]) == []


def test_fewer_strong_words_confirm_no_template():
    strong, least = set(licences.strong_words()), licences.least_strong()
    for text in (text for texts in licences.TEMPLATES.values() for text in texts):
        listed = licences.template_words(text)
        wanted = {(w,) for w in listed} | set(zip(listed, listed[1:]))
        for kept in strong.intersection(listed):
            held = [run for run in wanted if strong.intersection(run) <= {kept}]
            assert least == 2 and len(held) < licences.CONFIRMED * len(wanted)



def test_licence_scan(spark, none):
    lines = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
             "cc-by-nc": "Licensed under CC BY-NC 4.0.", None: "The committee met on a rainy day and went home."}
    docs = spark.createDataFrame(
        [(i, f"Some text.\n{line}\nMore text.", family) for i, (family, line) in enumerate(lines.items())] + [(9, None, "x"), (10, "", "x")],
        "doc_id long, text string, family string")
    more = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id") + 100, "text", F.lit("x"))
    found = licences.scan(docs.union(more)).filter("doc_id < 100").collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found} == {
        (i, 1, family) for i, family in enumerate(lines) if family}
    assert licences.scan(none).count() == 0


def test_every_background_paragraph_counts(spark):
    texts = [f"the terms of meeting {i} are in the annex\nno other words {i}\nReleased under the MIT License." for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "the terms")], "doc_id long, text string")
    found = licences.background(docs, ["the", "terms of", "no"]).collect()
    assert sum(r["n"] for r in found) == 12001
    assert {tuple(r["runs"]) for r in found} == {("terms of", "the"), ("no",), ("the",)} and {r["half"] for r in found} == {0, 1}


def test_wrapped_notices(spark):
    notices = {
        "mit": "MIT License\n\nCopyright (c) 2020 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
               "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including "
               "without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
        "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following "
               "conditions\n * are met:\n *\n * 1. Redistributions of source code must retain the above notice",
        "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as "
               "published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."}
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(notices.values())] + [(8, "Released under the MIT License.\n" * 3)], "doc_id long, text string")
    more = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id") + 100, "text")
    found = [(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs.union(more)).filter("doc_id < 100").collect()]
    assert sorted(found) == [(0, 4, "mit"), (1, 0, "bsd"), (2, 0, "gpl"), (8, 0, "mit"), (8, 1, "mit"), (8, 2, "mit")]


# --- language model ---


def test_language_model(documents, odd, none):
    rows = language_model.language_model(documents).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in documents.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in texts.items() if not fold(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            fold(r["doc_id"]), len(words), sum(counts[w] > 0 for w in words), total)
        assert r["score"] < 0
    scored = language_model.language_model(odd)
    assert scored.count() == len(ODD) and scored.filter("score IS NULL OR n_tokens < 1").count() == 0
    assert language_model.language_model(none).count() == 0


def test_network_gradients_and_probabilities():
    network = language_model.Network(7, hidden=3, classes=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    inputs, targets = np.array([[0, 1], [2, 3], [4, 0]]), np.array([[2, 3], [4, 5], [6, 1]])
    fresh, live = np.array([[True, True], [False, False], [False, True]]), np.ones((3, 2), bool)
    state = np.zeros((2, 3))

    def loss():
        states, _, _ = network.read(inputs, fresh, state)
        return -network.log_probabilities(states.reshape(-1, 3).astype(np.float64), targets.ravel())[0].mean()

    grads, _ = network.gradients(inputs, fresh, targets, live, state)
    for name in ("embed", "gate", "new", "classes", "words"):
        value = network.p[name]
        for place in list(np.ndindex(value.shape))[:: max(1, value.size // 12)]:
            old, step = value[place], 1e-3
            value[place] = old + step
            up = loss()
            value[place] = old - step
            down = loss()
            value[place] = old
            assert grads[name][place] == pytest.approx((up - down) / (2 * step), abs=2e-3)
    every = [float(np.exp(network.log_probabilities(np.full((1, 3), 0.3), np.array([t]))[0])[0]) for t in range(7)]
    assert sum(every) == pytest.approx(1, abs=1e-5)


def test_state_is_carried_over_windows():
    network = language_model.Network(9, hidden=4, classes=3)
    draw = np.random.default_rng(2)
    sequences = [draw.integers(0, 9, n) for n in (1, 50, 7, 33, 2, 2, 80)]

    def scores(lanes, window):
        state, out = np.zeros((lanes, 4), np.float32), np.zeros(len(sequences))
        for order, inputs, fresh, targets, live, owner in language_model.lanes_of(enumerate(sequences), lanes, window):
            states, state[order], _ = network.read(inputs, fresh, state[order])
            mask = live.ravel()
            logs = network.log_probabilities(states.reshape(-1, 4)[mask], targets.ravel()[mask])[0]
            np.add.at(out, owner.ravel()[mask], logs)
        return out

    assert np.allclose(scores(1, 200), scores(3, 5), atol=1e-4)


# --- transcripts ---


def plain_viterbi(model, seen):
    best, back = model.start + model.emit[:, seen[0]], []
    for o in seen[1:]:
        ways = best[:, None] + model.move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + model.emit[:, o]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], best.max()


def weight(model, seen, path):
    return model.start[path[0]] + model.emit[path[0], seen[0]] + sum(
        model.move[a, b] + model.emit[b, o] for a, b, o in zip(path, path[1:], seen[1:]))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_find_the_best_path(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "FAN", 2)
    raw = chat.raw_transcripts(spark.read.parquet(f"{FOLDER}/conversations.parquet")).cache()
    model = chat.fit(raw)
    rows = chat.decode(raw.select("conv_id", "line_no", "line"), model, block).collect()
    seen = {}
    for r in raw.orderBy("conv_id", "line_no").collect():
        kind, form, _ = chat.observe(r["line"])
        seen.setdefault(r["conv_id"], []).append(kind * chat.SHAPES + form)
    paths = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["place"])):
        paths.setdefault(r["conv_id"], []).append(2 * chat.ROLES.index(r["role"]) + r["begins"])
    assert {k: len(v) for k, v in paths.items()} == {k: len(v) for k, v in seen.items()}
    for k, own in seen.items():
        assert weight(model, own, paths[k]) == pytest.approx(plain_viterbi(model, own)[1])


def test_transcripts_recover_roles_and_render(spark):
    raw = chat.raw_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).cache()
    found = chat.transcripts(raw.select("conv_id", "line_no", "line"), raw.filter("conv_id % 5 <> 0"))
    rows = found.withColumnRenamed("role", "got").join(raw, ["conv_id", "line_no"]).filter("conv_id % 5 = 0").collect()
    assert sum(r["got"] == r["role"] for r in rows) > 0.85 * len(rows)
    text = "\n".join(r["rendered"] for r in sorted((r for r in rows if r["conv_id"] == 0), key=lambda r: r["line_no"]))
    assert text.startswith("<|") and text.endswith("<|end|>") and 2 * text.count("<|end|>") - 1 == text.count("|>\n")


def test_odd_transcripts(spark):
    lines = spark.createDataFrame([(1, 0, "User: hi", "x"), (1, 1, None, "x"), (None, 0, "A: yes", "x"), (1, 1, None, "x"), (2, None, "", "x")],
                                  "conv_id long, line_no long, line string, content string")
    labelled = lines.limit(0).selectExpr("conv_id", "line_no", "line", "'user' AS role", "true AS begins")
    got = chat.transcripts(lines, labelled)
    assert got.count() == 5 and got.filter("rendered IS NULL").count() == 0
    assert chat.transcripts(lines.limit(0), labelled).count() == 0
