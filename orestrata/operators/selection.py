"""Exact order statistics of a column that no task sees whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_ranks(rows: DataFrame, column: str, ranks: list[int], bins: int = 4096) -> list[float]:
    """The values that stand at ``ranks`` (from 0) in the order of those that are neither null nor NaN.

    A pass counts the values of ``bins`` ranges between the ends; the next looks into the range that holds the rank alone, until it
    holds one value. Counts are summed before they are shuffled, so the number of values doesn't matter, nor how they are spread.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    out = []
    for rank in ranks:
        here, before = x, 0
        part = F.when(F.col("x") == float("-inf"), -1).when(F.col("x") == float("inf"), 1).otherwise(0)
        while True:
            held = here.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # ``bins`` rows at most
            for b in sorted(held, key=lambda r: r["lo"]):
                if rank < before + b["n"]:
                    break
                before += b["n"]
            lo, hi = b["lo"], b["hi"]
            if lo == hi:
                out.append(lo)
                break
            here = x.where(F.col("x").between(lo, hi))
            # Halves first, so that ends of any size don't overflow.
            part = F.least(F.lit(bins - 1), F.floor((F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins)).cast("int")
    return out


def median(rows: DataFrame, column: str) -> float | None:
    """The middle value, or the mean of the two; None if there is none."""
    n = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if n == 0:
        return None
    a, b = at_ranks(rows, column, [(n - 1) // 2, n // 2]) if n % 2 == 0 else at_ranks(rows, column, [n // 2]) * 2
    return float((a + b) / 2)
