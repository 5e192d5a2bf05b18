"""Packing, filter audit and periodic runs against brute force, and on odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwatch.llm import audit, packing, periods
from driftwatch.llm.queries import QUERIES, WORD_TOKENIZER, planted
from driftwatch.llm.words import chunks, words_of

CLASHING = "doc_id long, text string, lang string, id string, start string, ids string, n_words string, runs string, collapsed string, part string, mask string, n string, digest string, words string, first string, spot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, *["x"] * 13) for i, t, lang in rows], CLASHING)


def odd(spark):
    a = " ".join(f"w{i % 37}" for i in range(90))
    rows = [(1, a), (2, a), (2, a), (3, None), (4, ""), (5, " \n\t\x0b\x0c\r"), (None, a), (None, None), (6, "lorem ipsum dolor sit amet " * 4000), (7, "É <|endoftext|>x a b c\x1cd é"), (8, "ONE Two")]
    return frame(spark, [(i, t, None if i == 4 else "en") for i, t in rows])


# packing


def naive_best_fit(lengths, window):
    windows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [w for w in range(len(windows)) if room[w] >= lengths[i]]
        if fits:
            least = min(room[w] for w in fits)
            w = next(w for w in fits if room[w] == least)
        else:
            w = len(windows)
            windows.append([])
            room.append(window)
        windows[w].append(i)
        room[w] -= lengths[i]
    return sorted(room), sorted(len(x) for x in windows)


def test_best_fit_leaves_the_rooms_of_a_full_search():
    rng = random.Random(3)
    for window in (1, 7, 8, 64, 100):
        for _ in range(40):
            lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 80))]
            windows = packing.best_fit(lengths, window)
            assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
            rooms = sorted(window - sum(lengths[i] for i in w) for w in windows)
            want, _ = naive_best_fit(lengths, window)
            assert rooms == want


def test_sequences_hold_every_token_once_with_little_room():
    rng = random.Random(4)
    for window, room in ((16, 0), (64, 3), (2048, 32)):
        for n in (0, 1, 2, 30, 300):
            sizes = [rng.choice([0, 1, window, window + 1, rng.randint(1, 5 * window)]) for _ in range(n)]
            seen = defaultdict(list)
            for pieces in packing.laid_out(sizes, window, room):
                length = sum(p[2] for p in pieces)
                assert 0 < length <= window
                assert window - length <= room or length & (length - 1) == 0
                for doc, start, own in pieces:
                    seen[doc].append((start, own))
            for doc, size in enumerate(sizes):
                at = 0
                for start, own in sorted(seen[doc]):
                    assert start == at and own > 0
                    at += own
                assert at == size


def ids_of(texts):
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("group", [1, 500, 1 << 22])
def test_pieces_are_the_tokenizers_ids(spark, group):
    df = odd(spark).coalesce(2)
    rows = packing.packed(df, WORD_TOKENIZER, window=256, group_tokens=group).collect()
    assert rows and list(rows[0].asDict()) == ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    texts = df.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), x) for r, x in zip(texts, ids_of([r.text for r in texts])))
    whole = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        whole[(str(r.id), r.doc_tokens)].append((r.start, bytes(r.ids)))
    # ids differ only by their rows here, so copies of one id have the same pieces
    for (i, n), pieces in whole.items():
        options = [x for k, x in want if k == i and len(x) == 4 * n]
        assert options
        covered = np.zeros(n, int)
        for start, ids in pieces:
            assert any(ids == x[4 * start : 4 * start + len(ids)] for x in options)
            covered[start : start + len(ids) // 4] += 1
        assert (covered == len(options)).all()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    joined = packing.sequences(packing.packed(df, WORD_TOKENIZER, window=256, group_tokens=group)).collect()
    assert {r.sequence_id: len(r.ids) // 4 for r in joined} == {k: sum(x[1] for x in v) for k, v in by_sequence.items()}


def test_words_pass_through_both_generations():
    small = packing.WordIds(WORD_TOKENIZER, most=3)
    text = "the cat sat on the mat, the CAT sat! " * 5 + "x" * 200
    assert [small.encode(text) + np.array([1], "<u4").tobytes()] == ids_of([text])


def test_ids_of_every_kind_of_character():
    rng = random.Random(6)
    words = packing.WordIds(WORD_TOKENIZER, most=500)
    assert words.by_words
    plain = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x100)]]
    wild = [*map(chr, range(0x80, 0x180)), *"\x1c\x1d\x85\xa0\u0301\u0307\u2003\u2028\u3000ΑΣσςİıﬁ한글漢字🙂\u200b"]
    texts = ["".join(rng.choice(plain) for _ in range(60)) for _ in range(300)]
    texts += ["".join(rng.choice(plain + wild) for _ in range(40)) for _ in range(300)]
    texts += ["a<|endoftext|>B", "<|startoftext|>", "<|endoftext|", "don't we'LL I'M", "x\u0301 \u0301y", "1234abc56"]
    assert [words.encode(t) + np.array([1], "<u4").tobytes() for t in texts] == ids_of(texts)


def test_a_tokenizer_that_works_otherwise_gets_whole_texts():
    path = WORD_TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    words = packing.WordIds(path)
    assert not words.by_words
    assert words.encode("a  b\n c") == np.array(Tokenizer.from_file(path).encode("a  b\n c", add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_query_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], ids_of([r.text for r in docs])))
    rows = QUERIES["op11_packing"](spark, sf_dir).collect()
    held, length = defaultdict(int), defaultdict(int)
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) // 4
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        held[r.doc_id] += r.length
        length[r.sequence_id] += r.length
    assert {k: len(v) // 4 for k, v in want.items()} == held
    padding = sum(2048 - n for n in length.values() if n & (n - 1))
    assert padding <= 0.02 * sum(length.values())


def test_packing_of_nothing(spark):
    assert packing.packed(frame(spark, []), WORD_TOKENIZER).collect() == []


# filter audit


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, lang in docs:
        t = t or ""
        ws = t.encode().split()
        f = {c for c, bad in zip("ABCD", [len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t)]) if bad}
        if i is not None and i > first[t]:
            f.add("E")
        fails.append((lang or "", f, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {x[0] for x in fails}:
        for order in itertools.permutations("ABCDE"):
            alive = [x for x in fails if x[0] == part]
            whole = alive
            for step, c in enumerate(order, 1):
                gone = [x for x in alive if c in x[1]]
                alive = [x for x in alive if c not in x[1]]
                failing = sum(c in x[1] for x in whole)
                out[part, "".join(order), step] = [len(alive), len(gone), failing - len(gone), sum(x[1] == {c} for x in whole), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, c] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_the_filters_applied_in_turn(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = [rng.choice(["Ab", "c", "DD", "e$", "f", f"w{rng.randrange(500)}"]) for _ in range(rng.choice([0, 3, 99, 100, 130]))]
        rows.append((i if rng.random() < 0.9 else None, " ".join(words) if rng.random() < 0.95 else None, rng.choice(["en", "de", "", None])))
    rows += [rng.choice(rows) for _ in range(60)] + [(1000 + i, rows[3][1], rng.choice(["en", None])) for i in range(40)]
    rows += [(1, "other text", "fr")]
    labels = [(rng.randrange(500), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, n string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in audit.audited(frame(spark, rows), marks).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_odd_rows_and_of_nothing(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd(spark)
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in audit.audited(docs, marks).collect()}
    assert got == brute_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [])
    assert audit.audited(frame(spark, []), marks).collect() == []


# periodic runs


def brute_runs(ws, least=12):
    """Every maximal stretch that agrees with itself one period on; the least period of a stretch counts."""
    out = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def periodic_texts():
    rng = random.Random(5)
    fibonacci = ["a"], ["a", "b"]
    for _ in range(9):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    out = []
    for k in range(240):
        n = rng.randint(0, 150)
        ws = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(n)]
        if k % 4 == 1 and n:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        elif k % 4 == 2:
            block = [str(rng.randrange(30)) for _ in range(rng.randint(1, 9))]
            ws = ws[:20] + block * rng.randint(2, 12) + ws[20:40] + block * 3
        elif k % 4 == 3:
            ws = fibonacci[1][rng.randrange(20) : rng.randrange(30, 140)] if k % 8 == 3 else [str(bin(i).count("1") % 2) for i in range(n)]
        out.append(" \n".join(ws))
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 7, 12])
def test_runs_are_all_maximal_repetitions(least):
    texts = periodic_texts()
    got = [[] for _ in texts]
    for chunk in chunks(pa.array(texts), 20_000):
        for t, *run in zip(*(x.tolist() for x in periods.runs_of(chunk, words_of(chunk), least))):
            got[chunk.first + t].append(tuple(run))
    assert got == [brute_runs(t.split(), least) for t in texts]


def test_repeated_rows_of_long_texts_stay_cheap():
    rng = random.Random(1)
    passage = [f"v{rng.randrange(10**6)}" for _ in range(30_000)]
    text = " ".join(passage * 3 + ["end"] + ["x"] * 50_000)
    (chunk,) = chunks(pa.array([text]))
    _, start, length, period = periods.runs_of(chunk, words_of(chunk))
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == [(0, 90_000, 30_000), (90_001, 50_000, 1)]


def test_runs_of_odd_rows(spark):
    got = periods.periodic_runs(odd(spark))
    assert got.columns == [c for c in odd(spark).columns if c not in ("text", "n_words", "runs", "collapsed")] + ["n_words", "runs", "collapsed"]
    rows = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    want = []
    for i, t in odd(spark).select("doc_id", "text").collect():
        ws = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(ws) if len(ws) < 1000 else [(0, len(ws), 5)]
        want.append((i, len(ws), runs, collapsed(ws, runs)))
    assert rows == sorted(want, key=str)
    assert periods.periodic_runs(frame(spark, [])).collect() == []


def planted_words(i, text):
    ws = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(i).encode()), len(ws)
    if h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def test_runs_query_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    checked = 0
    for i, text in docs:
        ws = planted_words(i, text)
        if len(ws) > 1500:
            continue
        runs = brute_runs(ws)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[i] == (len(runs), *tail, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(ws, runs)))
        checked += 1
    assert checked > 100


def test_planting_takes_whole_texts(spark):
    rows = [(i, t) for i in range(60) for t in ("a b c d e f g h i j k l m n", "one", "", None)]
    got = sorted((r.doc_id, (r.text or "").split()) for r in planted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, planted_words(i, t)) for i, t in rows)
    assert planted(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).select(F.col("text")).collect()[0][0] == "a b"
