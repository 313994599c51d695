"""Aggregate column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_of_sorted(values: Column, q: float) -> Column:
    """Linear percentile at ``q (n - 1)`` of a sorted array, zero when empty.

    For groups of bounded size; see ``plans.quantiles`` for others.
    """
    position = F.lit(q) * (F.size(values) - 1)
    below = F.get(values, F.floor(position).cast("int"))
    above = F.get(values, F.ceil(position).cast("int"))
    weight = position - F.floor(position)
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(
        below * (1.0 - weight) + above * weight
    )


def upper_median_of_sorted(values: Column) -> Column:
    """Element ``n // 2`` of a sorted array: the upper of the two middles."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def moments(value: Column) -> dict[str, Column]:
    """Everything of an error summary but the median, in mergeable aggregates."""
    zero = F.lit(0.0)
    return {
        "rmse": F.coalesce(F.sqrt(F.avg(value * value)), zero),
        "mean": F.coalesce(F.avg(value), zero),
        "stddev": F.coalesce(F.stddev_pop(value), zero),
        "max": F.coalesce(F.max(value), zero),
    }


def ratio(numerator: Column, denominator: Column) -> Column:
    """Guarded quotient: zero where the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))
