"""How filters interact: what each removes in every order, from contingency tensors of their outcomes.

Spark counts documents by part and by which filters they fail. The counts of a part are a tensor of two
places an axis, one axis a filter; for every step of every order a contraction picks pass, fail or both
along each axis.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOL = "[#$%&*|]"
NAMELESS = 1024  # rows without a key are spread over so many places of the join with labels
PASS, FAIL, ANY = (1, 0), (0, 1), (1, 1)
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, words: Column) -> list[Column]:
    """Filters on one text and its words: too few words, too few distinct ones, capitals, symbols."""
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        100 * capitals > MOST_CAPITALS_PERCENT * F.char_length(text),
        text.rlike(SYMBOL),
    ]


def outcomes(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters they fail (bit i: filter i).

    The last filter fails a text that a smaller key has too. Rows that agree in key, text digest and
    part are counted together before anything is joined, so copies and hot parts stay small.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text"), F.col("words")))]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    judged = rows.select("id", "part", F.sha2("text", 256).alias("digest"), mask.alias("mask"))
    grouped = kept(judged.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = grouped.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copied = grouped.join(first, ["digest", "id"], "left")
    last = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(bits)).otherwise(0)
    copied = copied.select("id", "part", "n", (F.col("mask") + last).alias("mask"), F.pmod(F.hash("digest"), F.lit(NAMELESS)).alias("spot"))
    marks = labels.select(F.col(key).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("id is not null").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    spread = copied.withColumn("spot", F.when(F.col("id").isNull(), F.col("spot")).otherwise(0))
    marked = spread.join(marks.withColumn("spot", F.lit(0)), ["id", "spot"], "left")
    counted = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).cast("long").alias(c)
    return marked.groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), counted("good"), counted("toxic"))


def steps_of(filters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every step of every order, and per question the selector (step, axis, pass and fail) that answers it."""
    k = len(filters)
    names, chosen = [], {q: [] for q in ("kept", "removed", "failing", "unique")}
    for order in itertools.permutations(range(k)):
        for step, own in enumerate(order):
            before = order[:step]
            names.append(("".join(filters[i] for i in order), step + 1))
            chosen["kept"].append([PASS if i in before or i == own else ANY for i in range(k)])
            chosen["removed"].append([FAIL if i == own else PASS if i in before else ANY for i in range(k)])
            chosen["failing"].append([FAIL if i == own else ANY for i in range(k)])
            chosen["unique"].append([FAIL if i == own else PASS for i in range(k)])
    return names, {q: np.array(x, np.int64).reshape(-1, k, 2) for q, x in chosen.items()}


def contraction(tensor: np.ndarray, selector: np.ndarray) -> np.ndarray:
    """(measure, step) sums of a tensor (measure, one axis of two a filter) under each step's selector."""
    axes = "abcdefgh"[: tensor.ndim - 1]
    formula = "m" + axes + "," + ",".join("s" + a for a in axes) + "->ms"
    return np.einsum(formula, tensor, *[selector[:, i] for i in range(len(axes))], optimize=True)


def contracted(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, counts): 32 cells a part at most go in, 600 rows come out (for five filters)."""
    names, chosen = steps_of(filters)
    k = len(filters)
    own = np.array([filters.index(order[step - 1]) for order, step in names])

    def audit(part: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros((len(MEASURES), 1 << k), np.int64)
        np.add.at(flat, (slice(None), part["mask"].to_numpy(np.int64)), part[list(MEASURES)].to_numpy(np.int64).T)
        # bit i of the mask becomes axis i: a reshape puts the highest bit first
        tensor = flat.reshape((len(MEASURES), *[2] * k)).transpose(0, *range(k, 0, -1))
        found = {q: contraction(tensor, s) for q, s in chosen.items()}
        removed = found["removed"][0]
        totals = np.bincount(own, removed, minlength=k).astype(np.int64)
        return pd.DataFrame(
            {
                "part": part["part"].iloc[0],
                "filter_order": [n[0] for n in names],
                "step": np.array([n[1] for n in names], np.int32),
                "kept": found["kept"][0],
                "removed": removed,
                "redundant": found["failing"][0] - removed,
                "unique_fails": found["unique"][0],
                "good_lost": found["removed"][1],
                "toxic_lost": found["removed"][2],
                "shapley": totals[own],
            }
        )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return cells.groupBy("part").applyInPandas(audit, schema)


def audited(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters, and step, with document counts within the part.

    ``kept`` after the step, ``removed`` at it, ``redundant`` (failing its filter but removed earlier),
    ``unique_fails`` (failing its filter alone), ``good_lost`` and ``toxic_lost`` (removed with that
    label), ``shapley`` (removed by its filter, over all orders). A null part is the empty string, null
    texts are empty, rows with a null key have no smaller key and no label, repeated rows all count, and
    of repeated labels any mark counts. Other columns of both tables are not looked at. No documents
    give no rows; no labels give zeros. A text's words are held as one array, a few times its bytes.
    """
    return contracted(outcomes(docs, labels, key, text, part))
