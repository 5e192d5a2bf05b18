"""Ranked alerts under a fixed analyst budget.

The cut is exact at any size: the rank's key is found by counting around pivots, so neither a
global sort nor a driver-sized list is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.evaluate import IS_ATTACK, TRUTH, ratio
from driftwatch.operators.rank import PIVOTS, value_at
from driftwatch.session import stored

_KEY = ("unusable", "descending", "event_id")


def check_arguments(scored: DataFrame, budget_fraction: float) -> None:
    """Guard the fraction and the columns."""
    missing = sorted({"risk_score", "label"} - set(scored.columns))
    if not 0.0 < budget_fraction <= 1.0:
        raise ValueError("the budget is a share of the rows: above 0, at most 1")
    if missing:
        raise ValueError("the scored table lacks these columns: " + ", ".join(missing))


def check_budget(scored: DataFrame, budget_fraction: float) -> int:
    """Guard arguments and rows; returns the number of rows."""
    check_arguments(scored, budget_fraction)
    total = scored.count()
    if total == 0:
        raise ValueError("there are no rows to set a budget for")
    return total


def _ranked(scored: DataFrame) -> DataFrame:
    """Ascending key of the ranking: highest score first, then event id; NaN and null last."""
    unusable = "(risk_score IS NULL OR isnan(cast(risk_score AS double)))"
    return scored.selectExpr(
        "*",
        f"cast({unusable} AS int) AS unusable",
        f"IF({unusable}, 0D, -cast(risk_score AS double)) AS descending",
    )


def _in_top(ranked: DataFrame, k: int, total: int, pivots: int) -> Column:
    last = value_at(ranked, _KEY, k, total, pivots=pivots)
    cut = F.struct(*[F.lit(v).alias(c) for v, c in zip(last, _KEY)])
    return F.struct(*_KEY) <= cut


def top_alerts(scored: DataFrame, k: int, *, pivots: int = PIVOTS) -> DataFrame:
    """The k highest-ranked rows (score descending, then event id ascending), in no order.

    The rows are computed once, into a table that counting, the search for the cut and the result read:
    give only the columns that are wanted.
    """
    kept = stored(scored, "ranking")
    total = kept.count()
    if k >= total:
        return kept
    ranked = _ranked(kept)
    top = ranked.filter(_in_top(ranked, k, total, pivots))
    return top.drop("unusable", "descending")


def alert_budget(scored: DataFrame, budget_fraction: float = 0.01, *, pivots: int = PIVOTS) -> DataFrame:
    """One row: how many attacks the top fraction of events contains.

    The scores are computed once, into a table of three columns; counting, the search for the cut and
    the aggregate read that table.
    """
    check_arguments(scored, budget_fraction)
    kept = stored(scored.select("event_id", "risk_score", "label"), "budget")
    total = check_budget(kept, budget_fraction)
    k = max(1, math.ceil(total * budget_fraction))
    ranked = _ranked(kept)
    marked = ranked.select("*", _in_top(ranked, k, total, pivots).alias("in_top"))
    hit = f"in_top AND {IS_ATTACK}"
    found = marked.agg(
        F.expr(f"count_if({IS_ATTACK})").alias("total_attacks"),
        F.expr(f"count_if({hit})").alias("true_alerts"),
        F.expr(f"sort_array(collect_set(IF({hit}, {TRUTH}, NULL)))").alias("attack_types_surfaced"),
    )
    return found.selectExpr(
        f"{total}L AS total_events",
        "total_attacks",
        f"{float(budget_fraction)!r}D AS budget_fraction",
        f"{k}L AS alert_count",
        "true_alerts",
        f"{k}L - true_alerts AS false_alerts",
        f"true_alerts / {k}D AS precision_at_budget",
        f"{ratio('true_alerts', 'total_attacks')} AS attack_recall_at_budget",
        f"{ratio('false_alerts', f'{total} - total_attacks')} AS false_positive_rate",
        "attack_types_surfaced",
    )
