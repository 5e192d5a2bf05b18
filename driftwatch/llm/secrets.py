"""Secret scan: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import json
import random
import re
import string
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept, least_keys

KEY_WORDS = ("token", "password", "passwd", "secret", "key", "apikey", "api_key", "auth", "authorization", "bearer", "credential", "pwd")
KNOWN_FORMATS = (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"xox[abp]-[0-9A-Za-z\-]{10,}", r"sk_live_[0-9A-Za-z]{24,}")
KNOWN = "(?=[Agxs])(?:" + "|".join(KNOWN_FORMATS) + ")"
# All three patterns have the groups word before, what stands between, and value. Words and gaps are
# possessive and start where a run starts: the time is linear in the text.
# What follows a word is looked at before its key words, since few words have an assignment after them.
# 1. What is assigned to a word that ends in a key word: a quoted run, or one without spaces, of 8 characters or more.
_WORD = r"""(?<![A-Za-z0-9_\-])([A-Za-z0-9_\-]++)(?=["'`\\)\]}]*+\s*+[=:]|(?<=[aA][rR][eE][rR])\s)(?<=(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z]))(?i:""" + "|".join(KEY_WORDS) + "))"
_ASSIGN = r"""["'`\\)\]}]*+\s*+(?::\s*+[A-Za-z][\w.\[\]|]{0,30}+\s++=|[=:]++>?+)\s*+(?:(?i:bearer|basic|token)\s++)?+"""
_GIVEN = (
    r"""(?<=\\")[^"\\\n]{8,}+(?=\\")|(?<=(?<!\\)")(?:[^"\\\n]|\\.){8,}+(?=")|(?<=')(?:[^'\\\n]|\\.){8,}+(?=')|(?<=`)[^`\n]{8,}+(?=`)"""
    r"""|[^\s"'`<>][^\s"<>]{6,}[^\s"'`<>.,;)\]}]"""
)
ASSIGNED = _WORD + r"((?:(?<=(?i:bearer))\s++|" + _ASSIGN + r""")(?:\\?["'`])?+)(""" + _GIVEN + r""")(?:\\?["'`])?+"""
# 2. A known format anywhere, also inside a run.
FORMAT = f"()()({KNOWN})"
# 3. Any other run of at least 16 characters that keys are made of, up to a known format.
RUN = r"(?<![A-Za-z0-9+/_\-])(?:([A-Za-z_]{1,24}+)([^A-Za-z0-9+/_\-]{1,8}+))?+([A-Za-z0-9+/_\-]{16,}+)"
# Frequent words and word parts of the languages in the documents.
DICTIONARY = (
    "the", "and", "that", "this", "with", "for", "was", "are", "have", "from", "you", "not", "tion", "ing", "ment", "able", "ness", "over", "under",
    "der", "die", "das", "und", "ein", "nicht", "ist", "von", "mit", "auf", "ung", "lich", "keit", "heit", "sch", "ver",
    "les", "des", "une", "est", "que", "pour", "dans", "avec", "qui", "eau", "eux", "elle",
    "los", "las", "una", "por", "para", "con", "del", "como", "ado", "ente", "cion", "mente",
    "file", "name", "path", "index", "data", "page", "user", "home", "version", "image", "http", "www", "html", "com", "org", "net",
    "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve",
)
REDACTED = "[SECRET]"
PASSWORD_WORD = "(password|passwd|secret|credential|pwd)$"
PLACEHOLDER = r"(?i)^(<.*>|\$\{.*|\{\{.*|%.*%|your[_-].*|.*(example|placeholder|changeme|xxxx).*)$"
REPEATED = r"^(.{1,4})\1{2,}+.{0,3}$"
WORDS = r"^[/.]?(?:[A-Za-z][a-z]*+|[0-9]{1,4}+)(?:[/_. \-]++(?:[A-Za-z][a-z]*+|[0-9]{1,4}+))++/?$"
SAMPLE_ROWS = 20_000
PLANTED = 100
PLANTED_FORMS = (
    'token = "VALUE"', "password = 'VALUE'", "api_key: VALUE", "Authorization: Bearer VALUE", "X-API-Key: VALUE",
    'db_password = "VALUE"', '"access_token": "VALUE",', "aws_secret_access_key=VALUE",
)
TREES, DEPTH, SEED = 20, 5, 7
THRESHOLD = 0.5
FEATURES = ("length", "transitions", "digits", "upper", "lower", "hex", "coverage", "slashes", "dashes", "key_word", "assigned", "quoted", "known_format", "password_word", "placeholder", "repeated")
# The features that decide which findings are judged at all (key_word, assigned, known_format) are not the forest's.
JUDGED_BY = tuple(i for i, n in enumerate(FEATURES) if n not in ("key_word", "assigned", "known_format"))


def candidates(text: Column) -> Column:
    """array<struct<value, word, between>> of a text's candidates; empty for null.

    Assigned values come first, then known formats in what they leave, then other runs, each in order.
    Words are in lower case with ``_`` where the case of a name changes (apiKey).
    """

    def found(where: Column, pattern: str) -> Column:
        whole = F.coalesce(F.regexp_extract_all(where, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
        part = lambda m, i: F.regexp_extract(m, f"^{pattern}$", i)
        word = lambda m: F.lower(F.regexp_replace(part(m, 1), "(?<=[a-z0-9])(?=[A-Z])", "_"))
        return F.transform(whole, lambda m: F.struct(part(m, 3).alias("value"), word(m).alias("word"), part(m, 2).alias("between")))

    others = F.regexp_replace(text, ASSIGNED, "\n")
    return F.concat(found(text, ASSIGNED), found(others, FORMAT), found(F.regexp_replace(others, KNOWN, "\n"), RUN))


def key_word(c: Column) -> Column:
    """The word before ends in a key word."""
    return c["word"].rlike("(^|[^a-z])(" + "|".join(KEY_WORDS) + ")$")


def assigned(c: Column) -> Column:
    """An ``=`` or ``:`` stands between, or the word is ``Bearer`` and a space follows."""
    return c["between"].rlike("[=:]") | (c["word"].rlike("(^|[^a-z])bearer$") & c["between"].rlike(r"^\s"))


def features(c: Column) -> Column:
    """The numbers of FEATURES for one candidate."""
    value, size = c["value"], F.length(c["value"])
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    uncovered = F.length(F.regexp_replace(F.lower(value), "(?:" + "|".join(DICTIONARY) + ")", ""))
    return F.array(
        size.cast("double"),
        share("[a-z](?=[A-Z0-9])|[0-9](?=[A-Za-z])|[A-Z](?=[0-9])"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        1 - uncovered / size,
        share("/"),
        share("[_-]"),
        flag(key_word(c)),
        flag(assigned(c)),
        flag(c["between"].rlike("[\"'`]")),
        flag(value.rlike(KNOWN)),
        flag(c["word"].rlike(PASSWORD_WORD)),
        flag(value.rlike(PLACEHOLDER)),
        flag(value.rlike(REPEATED)),
    )


def nominated(c: Column) -> Column:
    """A value with digits that is assigned to a key word."""
    return key_word(c) & assigned(c) & c["value"].rlike("[0-9]")


def ordinary(c: Column) -> Column:
    """Shapes of values that are no secrets: placeholders, repeated patterns, paths, dictionary words with numbers.

    Passwords may be words, so the last two do not count after a word for one.
    """
    f = features(c)
    words = c["value"].rlike(WORDS) & (c["value"].contains("/") | (f[FEATURES.index("coverage")] >= 0.5)) & ~c["word"].rlike(PASSWORD_WORD)
    return c["value"].rlike(PLACEHOLDER) | c["value"].rlike(REPEATED) | words


def labelled_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(value, word, between, label) of the candidates that have a label.

    1: holds a published key format, or is nominated by its key word and not of an ordinary shape; 0: an
    ordinary shape, nominated or not. Other candidates without a key word may be keys or not: no label.
    """
    found = docs.select(F.explode(candidates(F.col(text))).alias("c"))
    c = F.col("c")
    label = F.when(c["value"].rlike(KNOWN), 1.0).when(ordinary(c), 0.0).when(nominated(c), 1.0)
    return found.select("c.*", label.alias("label")).where("label is not null")


def planted_texts() -> list[tuple[str, float]]:
    """(text, label): fixed texts with one assigned value each, secret or not, so that a forest knows forms its corpus lacks.

    Their labels follow from how the value was made, not from a rule over its features.
    """
    draw = random.Random(SEED)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    alphabet = string.ascii_letters + string.digits
    out = []
    for i in range(PLANTED):
        values = (some("0123456789abcdef", 40), some(alphabet, 8 + i % 40), some(string.ascii_lowercase, 6) + some(string.digits, 1 + i % 4) + some("!?#%&*.@-", 1 + i % 3) + some(alphabet, 3), some(alphabet + "+/", 40))
        value = values[i % len(values)][:-1] + some(string.digits, 1)
        for form in PLANTED_FORMS:
            out.append((form.replace("VALUE", value), 1.0))
        word = lambda: draw.choice([w for w in DICTIONARY if len(w) > 3])
        number = str(i % 50)
        path = "/".join(word() for _ in range(2 + i % 3)) + f"/{word()}_{number}"
        plain = (path, f"/{path}/", f"{word()}-{word()}-{word()}-{number}", f"{word()}_{number}_{word()}_{word()}", some("ab01xyz", 2 + i % 2) * (4 + i % 3))
        empty = (f"<your-{word()}-{number}>", f"${{KEY_{number}_{word()}}}", f"your_{word()}_key_{number}", "xxxxxxxx" + number, f"example-{word()}-{number}")
        for form in PLANTED_FORMS:
            password = re.search("password", form)
            out.append((form.replace("VALUE", draw.choice(empty if password else plain + empty)), 0.0))
    return out


def planted(spark: SparkSession) -> DataFrame:
    """(value, word, between, label) of the planted texts."""
    rows = json.dumps([{"text": t, "label": y} for t, y in planted_texts()])
    texts = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<text: string, label: double>>")))
    return texts.select(F.explode(candidates(F.col("text"))).alias("c"), "label").select("c.*", "label")


def _tree_sql(lines: list[tuple[int, str]], names: Sequence[str]) -> str:
    """A printed tree as nested CASE expressions over the feature array ``f``."""
    depth, line = lines[0]
    if line.startswith("Predict:"):
        return str(float(line.split(":")[1]))
    feature, bound = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
    other = next(i for i in range(1, len(lines)) if lines[i][0] == depth)
    yes, no = _tree_sql(lines[1:other], names), _tree_sql(lines[other + 1 :], names)
    return yes if yes == no else f"CASE WHEN f[{JUDGED_BY[int(feature)]}] <= {float(bound)!r}D THEN {yes} ELSE {no} END"


def fit(findings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> str | None:
    """A random forest over labelled findings as a SQL expression over ``f``; None without any.

    At most ``sample_rows`` different findings, half of each label, those of least hash: the documented
    bound of what the forest is grown from. Repeated findings count once, so no frequent one fills it.
    The planted findings come on top.
    """
    key = F.xxhash64("value", "word", "between", F.lit(SEED)).alias("key")
    findings = kept(findings.distinct().select("*", key), "labelled-findings")
    half = sample_rows // 2
    totals = {r.label: r.n for r in findings.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [least_keys(findings.where(F.col("label") == label), n, half) for label, n in totals.items()]
    if not parts:
        return None
    both = reduce(DataFrame.unionByName, parts).drop("key").unionByName(planted(findings.sparkSession))
    sample = both.withColumn("f", features(F.struct("value", "word", "between")))
    sample = kept(sample.select("label", *[F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)]), "findings")
    rows = VectorAssembler(inputCols=[FEATURES[i] for i in JUDGED_BY], outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    trees: list[list[tuple[int, str]]] = []
    for line in forest.toDebugString.split("\n")[1:]:
        text = line.strip()
        if text.startswith("Tree "):
            trees.append([])
        elif text:
            trees[-1].append((len(line) - len(line.lstrip()), text))
    return "(" + " + ".join(_tree_sql(t, FEATURES) for t in trees) + f") / {len(trees)}D"


def scanned(docs: DataFrame, forest: str | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``findings``: array<struct<value, word, between, score, secret>> of every row's whole text.

    A row is judged on its own, without a shuffle. Known formats are secrets always; of
    the values with digits assigned to a key word those that the forest keeps (all without a forest). Null and empty texts have no findings; a
    column of that name is replaced.
    """
    docs = docs.drop("findings")
    with_features = docs.withColumn(
        "_c", F.transform(candidates(F.col(text)), lambda c: F.struct(c["value"], c["word"], c["between"], features(c).alias("f")))
    )
    own = re.sub(r"\bf\[", "c.f[", forest or "1.0D")
    score = f"CASE WHEN c.f[12] > 0 THEN 1.0D WHEN c.f[9] > 0 AND c.f[10] > 0 AND c.f[2] > 0 THEN {own} ELSE 0.0D END"
    found = F.expr(f"transform(_c, c -> struct(c.value AS value, c.word AS word, c.between AS between, {score} AS score))")
    judged = F.transform(found, lambda c: F.struct(c["value"], c["word"], c["between"], c["score"], (c["score"] >= threshold).alias("secret")))
    return with_features.withColumn("findings", judged).drop("_c")


def redacted(text: Column, found: Column) -> Column:
    """The text with every occurrence of its secrets replaced; longer secrets first."""
    secrets = F.transform(F.filter(found, lambda c: c["secret"]), lambda c: c["value"])
    ordered = F.array_sort(F.array_distinct(secrets), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, text, lambda t, s: F.replace(t, s, F.lit(REDACTED)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with their findings, by a forest grown from their own labelled findings."""
    return scanned(docs, fit(labelled_findings(docs, text)), text)
