"""Operators against brute force, and their defined results on nulls, empty and odd rows."""

import hashlib
import io
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from driftwatch.llm import components, jaccard, mixing, pieces, quality, repeats, rules, secrets, topk, urls, warc
from driftwatch.llm.queries import PIECE_MODEL, QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LONG = "lorem ipsum dolor sit amet " * 4000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _digest string, size string"


def frame(spark, rows):
    """Rows of (id, text) with columns whose names clash with those that operators add."""
    full = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None, "x", "y", "z") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def odd(spark):
    a = " ".join(f"w{i}" for i in range(60))
    return frame(spark, [(1, a), (2, a), (2, a), (3, None), (4, ""), (5, "   \n\t"), (None, a), (None, None), (6, LONG), (7, "two words"), (8, "Two WORDS"), (9, a + " end")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


# archives


def test_archives_hold_every_row(spark):
    body = "b" * 1500
    rows = [(1, "http://a/é\r\nx", body), (3, None, body), (2, "u", body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", body), (7, "u", ""), (7, "u", LONG), (7, "u", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archived(df, payloads=True).collect()), key=str)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, u, t in rows:
        raw = (t or "").encode()
        refers = 3 if t == body and i in (1, 2) else None
        want.append((i, u, "revisit" if refers else "response", len(raw), digest(t), refers, None if refers else bytearray(raw)))
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0xFFFFFFFF, 10])
def test_directory_with_and_without_zip64(limit):
    out = io.BytesIO()
    archive = warc.ZipWriter(out, zip64_from=limit)
    for name, data in (("a/x", b"hello"), ("b", b"world" * 9)):
        archive.begin(name)
        archive.add(data)
        archive.finish()
    archive.close()
    raw = out.getvalue()
    members = warc.directory(io.BytesIO(raw), len(raw))
    for name, data in (("a/x", b"hello"), ("b", b"world" * 9)):
        at = warc.data_offset(io.BytesIO(raw), members[name])
        assert raw[at : at + members[name].size] == data
        assert zipfile.ZipFile(io.BytesIO(raw)).read(name) == data
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no archive"), 10)


# quality


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = QUERIES["op2_quality"](spark, d).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (3, None), (None, 1)], "doc_id long, quality int")
    out = quality.classify(odd(spark), labels)
    scores = [r.score for r in out.collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    assert out.where("doc_id = 4").first().score == out.where("doc_id = 3").first().score
    assert quality.classify(odd(spark), labels.limit(0)).where("score = 0.5").count() == 12
    assert quality.classify(empty(spark), labels).count() == 0


# near duplicates


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        words = WORD.findall((t or "").encode().lower())
        n = len(words)
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, n - size + 1))} if n else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, sf_dir, size, percent):
    docs = documents(spark, sf_dir)
    base = [f"x{i}" for i in range(100)]
    chain = [(9000 + k, " ".join(base[:k] + [f"y{k}{j}" for j in range(k)] + base[k:])) for k in range(12)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(chain, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert by_id(jaccard.near_duplicates(docs, size, percent), "id", "n_shingles", "component_id") == brute_components(texts, size, percent)


def test_near_duplicates_of_odd_rows(spark):
    rows = [tuple(r) for r in jaccard.near_duplicates(odd(spark)).collect()]
    assert len(rows) == 12
    assert sorted(r[2] for r in rows if r[0] in (1, 2, 9)) == [1, 1, 1, 1]
    assert {r[2] for r in rows if r[0] in (3, 4, 5)} == {3, 4, 5}
    assert {r[2] for r in rows if r[0] in (7, 8)} == {7}
    assert {(r[1], r[2]) for r in rows if r[0] is None} == {(56, 1), (0, None)}
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = by_id(components.components(df), "node", "component")
    assert got == {**{i: (0,) for i in range(41)}, **{100 + i: (100,) for i in range(30)}}


# tokens


def test_tokens_equal_the_library(spark, sf_dir):
    texts = [r.text for r in documents(spark, sf_dir).collect()]
    texts += ["", " ", "  a  b", "a\n\nb\t c", "日本語 ▁ x", "x" * 700, "ab" * 400 + " é", "🙂🙂 \0 z", "a" * 129 + "   "]
    encoder = pieces.Encoder(pieces.read_model(PIECE_MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == library.encode(text)
        assert encoder.decode(raw) == library.decode(ids)


def test_unigram_tokens_take_the_best_path():
    vocabulary = {"▁": -2.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "ba": -2.0, "aba": -5.1, "bab": -3.9}
    model = pieces.Model(pieces.UNIGRAM, ["<unk>", *vocabulary], np.array([0.0, *vocabulary.values()]), np.array([False] + [True] * 8), [], 0, True)
    encoder = pieces.Encoder(model)

    def best(t):
        if not t:
            return 0.0
        return max(vocabulary[t[:k]] + best(t[k:]) for k in range(1, 4) if t[:k] in vocabulary and k <= len(t))

    for word in ("abab", "baab", "ababab", "bbaa", "a"):
        ids = np.frombuffer(encoder.encode([word])[0], "<i4")
        assert "".join(model.pieces[i] for i in ids) == "▁" + word
        assert model.scores[ids].sum() == pytest.approx(best("▁" + word))
    assert np.frombuffer(encoder.encode(["azza"])[0], "<i4").tolist() == [5, 0, 2]


def test_round_trips_of_odd_rows(spark):
    model = pieces.read_model(PIECE_MODEL)
    out = pieces.round_trips(odd(spark), model)
    assert out.where("round_trip").count() == 12 and out.where("n_tokens = 0").count() == 3
    assert pieces.encoded(empty(spark), model).count() == 0
    back = pieces.decoded(pieces.encoded(odd(spark), model).drop("text"), model)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd(spark).collect())


# repeated strings


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    shared = "".join(chr(97 + i * i % 26) for i in range(70))
    rows += [(5000 + k, f"{k}" * k + shared[k : 70 - k] + "#" * k) for k in range(14)] + [(6000, "é" * 90), (6001, "é" * 60 + "x"), (6002, "a" * 300), (6003, "b" + "a" * 99)]
    rows += [(6100, shared[:49]), (6101, shared[:50]), (6102, None), (6103, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.without_repeats(df)
    assert by_id(out, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())


def test_repeats_of_odd_rows(spark):
    out = [tuple(r) for r in repeats.without_repeats(odd(spark), texts=False).collect()]
    removed = sorted((r[0] or 0, r[2]) for r in out if r[2])
    size = len(" ".join(f"w{i}" for i in range(60)))
    assert len(out) == 12 and removed == [(2, size), (2, size), (9, size)]
    assert repeats.without_repeats(empty(spark)).count() == 0


# mixing and urls


def test_mixing_caps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, source_size long")
    got = by_id(mixing.source_targets(sizes), "source", "target")
    # weights: a 5, b 2, c 1, null 5; a, null and c are filled, and b takes the rest
    assert got == {"a": (30.0,), "c": (0.0,), None: (300.0,), "b": (pytest.approx(780.0),)}
    assert all(got[s][0] <= 3 * n + 1e-9 for s, n in (("a", 10), ("b", 1000), (None, 100), ("c", 0)))


def test_mixing_odd_rows(spark):
    out = mixing.mix_counts(odd(spark))
    assert out.count() == 12 and out.where("copies > 3 or copies < 0").count() == 0
    assert sorted(map(tuple, out.select("doc_id", "copies").collect()), key=str) == sorted(map(tuple, mixing.mix_counts(odd(spark)).select("doc_id", "copies").collect()), key=str)
    assert mixing.mixed_documents(odd(spark).drop("size")).columns == odd(spark).drop("size").columns
    assert mixing.mix_counts(empty(spark)).count() == 0


def test_url_rules_and_reputation(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x"), (2, "http://a.example.com/en/x?q"), (3, "https://a.com"), (4, "x://a.com/"), (5, "http://b.net/es/1#f"),
        (6, None), (7, "no scheme"), (8, ""), (9, "http://b.net/xx/"), (10, "http://notexample.com/en/"), (11, "http://x.org/en/://y.com/"),
    ]
    df = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id long, url string, host string, bound double")
    got = by_id(urls.judged_urls(df), "page_id", "host", "path", "rule", "verdict")
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3][:3] == ("a.com", "", None) and got[4] == ("a.com", "/", "com/", "allow")
    assert got[5] == ("b.net", "/es/1", "net/es/", "block") and got[9][2] is None
    assert got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None)
    assert got[10] == ("notexample.com", "/en/", "com/", "allow") and got[11][:2] == ("x.org", "/en/://y.com/")
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert urls.judged_urls(df.limit(0)).count() == 0


def test_bad_neighbourhood_is_blocked_and_unknown_hosts_are_not(spark):
    rows = [(i, f"http://h{i % 3}.net/es/{i}") for i in range(300)] + [(900, "http://h1.net/de/"), (901, "http://fresh.org/")]
    rows += [(1000 + i, f"http://g{i}.com/") for i in range(300)]
    got = by_id(urls.judged_urls(spark.createDataFrame(rows, "page_id long, url string")), "page_id", "verdict")
    assert got[900] == ("block",) and got[901] == ("allow",)


# quality rules


def test_base_counts_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark, sf_dir).collect()]
    rows += [(7001, "a b c d e f g h " * 3 + "\n\nx\nx\n x\n", "en"), (7002, None, None), (7003, "", "en"), (7004, "#| é\u3000ü $", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(rules.judged(df), "doc_id", *rules.BASE_COLUMNS, "base_failed")
    for i, text, _ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = {r for r, n in Counter(runs).items() if n > 1}
        covered = {k + j for k, r in enumerate(runs) if r in often for j in range(8)}
        n = len(words)
        want = (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)
        assert got[i] == want, i


def test_divergence_keeps_clean_and_drops_symbols(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = rules.judged(documents(spark, sf_dir)).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in rows if r.quality]
    assert np.mean(clean) > 0.98 and not all(r.kept for r in rows if not r.quality)
    p, q = np.array([[0.5, 0.5, 0], [0, 0, 1]]), np.array([0.5, 0.5, 0])
    assert rules.divergence(p, q).tolist() == [0.0, 1.0]


def test_rules_of_odd_rows(spark):
    out = rules.judged(odd(spark))
    assert out.count() == 12 and out.where("n_words = 0 and kept").count() == 0
    assert rules.judged(empty(spark)).count() == 0


# secrets


def test_secrets_are_found_and_cut(spark):
    import random

    draw = random.Random(3)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f'some words token = "{h}" and thinganthationered more 4785380592391139') for i, h in enumerate(hexes)]
    rows += [(100, "key AKIA" + "B7" * 8 + " end"), (101, None), (102, ""), (103, LONG), (None, 'token = "' + hexes[0] + '" ' + hexes[0])]
    got = secrets.scan(frame(spark, rows)).withColumn("text", secrets.redacted(F.col("text"), F.col("findings"))).collect()
    texts = {r.doc_id: r.text for r in got}
    assert all(h not in (t or "") for h in hexes for t in texts.values())
    assert all("thinganthationered" in texts[i] and "4785380592391139" in texts[i] for i in range(60))
    assert texts[101] is None and texts[102] == "" and texts[103] == LONG and texts[100] == "key [SECRET] end"
    assert secrets.scan(empty(spark)).count() == 0
    assert secrets.scan(frame(spark, [(1, "nothing here")])).select(F.size("findings")).first()[0] == 0


HEX = "3f786850e387550fdab836ed7e6dc881de23001b"
GHP = "ghp_" + "a1B2c3D4e5F6" * 3
FORMS = [
    ('password = "hunter2-9x!Q"', "hunter2-9x!Q"), (f"Authorization: Bearer {HEX}", HEX), (f"X-API-Key: {HEX}", HEX), (f'db_password = "{HEX}"', HEX),
    (f'access_token: "{HEX}"', HEX), (f'{{"access_token": "{HEX}", "n": 1}}', HEX), (f'export aws_secret_access_key = "{HEX}"', HEX), (f"git clone https://{GHP}@github.com/a/b", GHP),
    ("DB_PASSWORD=s3cr.t$9 next", "s3cr.t$9"), ('"clientSecret": "Zk4.9_xQ77"', "Zk4.9_xQ77"), (f"my_very_long_service_account_access_token_key: {HEX}", HEX),
    ('password: str = "p4ss w0rd, 77"', "p4ss w0rd, 77"), (f"curl /api/v1/users/login?access_token={HEX}&x", HEX), ('\\"pwd\\": \\"a.B-c7!d9\\"', "a.B-c7!d9"),
]


@pytest.mark.parametrize("both_labels", [True, False])
def test_every_form_of_secret_is_cut(spark, both_labels):
    rows = [(i, f"some words before\n{text}\nand after it") for i, (text, _) in enumerate(FORMS)]
    if both_labels:
        rows += [(100 + i, f"monkey: {'walking' * 3}{i} the tokens and keyboard = {i}, longwordswithoutanykey") for i in range(20)]
    got = secrets.scan(frame(spark, rows)).withColumn("text", secrets.redacted(F.col("text"), F.col("findings"))).collect()
    texts = {r.doc_id: r.text for r in got}
    for i, (_, value) in enumerate(FORMS):
        assert value not in texts[i] and "[SECRET]" in texts[i] and texts[i].startswith("some words before\n") and texts[i].endswith("\nand after it"), texts[i]
    assert all(texts[i] == t for i, t in rows if i >= 100)


# top-k


def brute_top(rows, query, own, k):
    scored = sorted((-sum(a * b for a, b in zip(q, query, strict=True)), i) for i, q in rows if i != own)
    return [(i, -s) for s, i in scored[:k]]


@pytest.mark.parametrize("block_rows", [1 << 16, 37])
def test_top_k_equals_brute_force(spark, block_rows):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(0, 0.2 if i % 3 else 3, 6)]) for i in range(1, 200)]
    rows += [(400, rows[5][1]), (401, rows[5][1]), (402, [0.0] * 6)]
    bad = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), block_rows=block_rows, lane_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    vectors = dict(whole)
    asked = [i for i, _ in rows if i % 20 == 0]
    assert set(got) == set(asked)
    assert all(got[i] == brute_top(whole, vectors[i], i, 20) for i in asked)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


# pipeline


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for docs, rows in ((odd(spark), True), (empty(spark), False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name.startswith("SentencePiece") or out.columns == docs.columns
            assert (out.count() > 0) is rows


def test_pipeline_decisions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    labels = by_id(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    ids = {r.doc_id for r in good.collect()}
    assert np.mean([(i in ids) == bool(q) for i, (q,) in labels.items()]) > 0.95
    single = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    want = brute_components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in want.values()})
    clean = {r.doc_id: r.text for r in corpus_pipeline.secrets_stage(spark, docs, sf_dir).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    changed = [i for i in before if before[i] != clean[i]]
    assert all("[SECRET]" in clean[i] for i in changed) and all("token =" not in before[i] or i in changed for i in before)
