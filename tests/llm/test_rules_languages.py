"""Verdicts by a text's own language, however small it is, against a plain computation."""

import math
import random
from collections import Counter, defaultdict

import pytest

from driftwatch.llm import rules

ENGLISH = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all".split()
FINNISH = "ja on ei se että oli hän mutta niin kuin joka mitä tämä vain myös ovat olla sen minun kanssa".split()


def text(rng, words, n):
    return " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(words) + rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(2)
    rows = [(i, text(rng, ENGLISH, rng.randint(60, 160)), "en") for i in range(600)]
    rows += [(1000 + i, text(rng, FINNISH, 90), "fi") for i in range(3)]
    rows += [(2000, "#$ 12 %& 34 <> " * 40 + text(rng, ENGLISH, 30), "en"), (2001, text(rng, FINNISH, 100), "en"), (2002, "a few words", "xx"), (2003, " ".join(f"q{i}" for i in range(40)), "yy"), (2004, text(rng, ENGLISH, 80), None), (2005, None, "en"), (2006, "", "fi")]
    return rows


def char_class(c):
    if c in " \t\n\r\x0b\x0c":
        return "space"
    if "a" <= c <= "z" or ord(c) > 127:
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if c.isdigit():
        return "digit"
    return "stop" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else "other"


def jensen_shannon(p, q):
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, total / 2))


def shares(counter, common=None):
    n = max(sum(counter.values()), 1)
    if common is None:
        return {k: v / n for k, v in counter.items()}
    held = {k: counter[k] / n for k in common if counter[k]}
    return {**held, None: 1 - sum(held.values())}


def verdicts(rows, common_share):
    words, classes = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in rows:
        words[lang or ""].update((t or "").split())
        classes[lang or ""].update(map(char_class, t or ""))
    out = {}
    for i, t, lang in rows:
        own, lang = (t or "").split(), lang or ""
        windows = Counter(tuple(own[j : j + 8]) for j in range(len(own) - 7))
        covered = {j + k for j in range(len(own) - 7) if windows[tuple(own[j : j + 8])] > 1 for k in range(8)}
        failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
        total = sum(words[lang].values())
        far = False
        if len(own) >= rules.GUARD_WORDS and total >= rules.GUARD_WORDS:
            common = [w for w, n in words[lang].items() if n >= common_share * total]
            far = jensen_shannon(shares(Counter(map(char_class, t))), shares(classes[lang])) > rules.MOST_CLASS_DISTANCE
            far |= jensen_shannon(shares(Counter(own), common), shares(words[lang], common)) > rules.MOST_WORD_DISTANCE
        out[i] = (failed, not failed and not far)
    return out


@pytest.mark.parametrize("common_share", [0.001, 0.01, 0.9])
def test_verdicts_follow_from_the_own_language(spark, common_share):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judged(df, common_share=common_share).collect()}
    assert got == verdicts(rows, common_share)
    if common_share == 0.001:
        assert all(got[1000 + i][1] for i in range(3)), "a language of half a percent is kept"
        assert not got[2000][1] and not got[2001][1] and got[2004][1] and got[2003][1]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_LANGUAGES", 1)
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        rules.judged(df)
