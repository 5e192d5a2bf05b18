"""The value at a rank of an ordering, exact at any size, by one path.

Rows are counted between a few pivots, the interval holding the rank is kept, and so on until
the rank falls on a pivot. Nothing larger than the pivots ever reaches one task or the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

PIVOTS = 64


def _literal(values: Row, keys: DataFrame) -> Column:
    types = keys.schema["key"].dataType
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, types)])


def value_at(
    df: DataFrame,
    columns: Sequence[str],
    rank: int,
    total: int,
    *,
    pivots: int = PIVOTS,
) -> Row:
    """Values of `columns` in the row at 1-based `rank`, in ascending order of the columns.

    Every round takes a few of the rows left as pivots and drops at least these, so it ends; a stored
    table as input spares computing the rows again in each.
    """
    if not 1 <= rank <= total:
        raise ValueError("rank out of range")
    left = df.select(F.struct(*columns).alias("key"))
    inside = total
    while True:
        # any pivots give the exact value; random rows halve best, also among heavy ties
        picked = left.orderBy(F.rand(inside)).limit(pivots).distinct().orderBy("key").collect()
        cuts = [_literal(r["key"], left) for r in picked]
        # even places are the open intervals between pivots, odd ones the ties of a pivot: no
        # interval keeps a pivot, so each round shrinks the input however heavy the ties are
        known = F.array(*cuts)
        lower = F.size(F.filter(known, lambda cut: cut < F.col("key")))
        place = lower * 2 + F.array_contains(known, F.col("key")).cast("int")
        groups = left.groupBy(place.alias("place")).count().orderBy("place").collect()
        for group in groups:
            if rank <= group["count"]:
                break
            rank -= group["count"]
        at, tied = divmod(group["place"], 2)
        if tied:
            return picked[at]["key"]
        if at > 0:
            left = left.filter(F.col("key") > cuts[at - 1])
        if at < len(cuts):
            left = left.filter(F.col("key") < cuts[at])
        inside = group["count"]


def quantile(df: DataFrame, column: str, q: float, total: int, **bounds: int) -> float:
    """Quantile with linear interpolation between the two neighbouring ranks."""
    position = q * (total - 1)
    lower = int(position)
    low = value_at(df, [column], lower + 1, total, **bounds)[0]
    if position == lower:
        return float(low)
    # the next rank holds the same value again or the least greater one
    upto, above = df.agg(
        F.count_if(F.col(column) <= low), F.min(F.when(F.col(column) > low, F.col(column)))
    ).first()
    high = low if upto >= lower + 2 else above
    return float(low) + (float(high) - float(low)) * (position - lower)
