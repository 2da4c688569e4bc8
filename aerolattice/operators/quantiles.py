"""Exact quantiles of a whole column, without a task that holds all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a round, and values that the driver takes at most to end with.
BINS, FEW = 4096, 10_000


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The value at ``share`` of the way through the sorted ``column``, between the two nearest by their distance.

    Nulls and NaN don't count; None where no value is left. Each round counts the values by bin, which tasks sum up before the
    shuffle, and goes on with the bin that holds the rank; equal values end it whatever their number. ``df`` is
    read once a round, two or three times in all, so it should be a table or be kept.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    place = share * (n - 1)
    rank = math.floor(place)
    left, inside, count = rank, values, n
    while count > FEW and low < high:
        width = (high - low) / BINS
        k = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        rows = sorted(inside.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        for row in rows:
            if left < row.n:
                break
            left -= row.n
        low, high, count = row.low, row.high, row.n
        inside = values.where(F.col("v").between(low, high))
    if low < high:
        own = sorted(r.v for r in inside.collect())
        at, after = own[left], own[left + 1] if left + 1 < len(own) else None
    else:
        at, after = low, low if left + 1 < count else None
    if place == rank:
        return at
    if after is None:
        after = values.where(F.col("v") > high).agg(F.min("v")).first()[0]
    return at + (place - rank) * (after - at)
