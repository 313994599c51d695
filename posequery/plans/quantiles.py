"""Exact quantiles that stay distributed when one group, or one value, holds most rows.

The built-in ``percentile`` merges a group's distinct values in one task.  Here rows become
distinct values with a count first, combined before they shuffle, so a value that fills a third
of the table is one row from then on.  Counts are summed in coarse buckets, only the buckets that
hold a wanted rank are looked at again in finer buckets, and only those value by value.
The bucket functions never decrease, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_PER_E_FOLD = 256
_OFFSET = 1 << 20
_FINE = 1 << 16


def _coarse(value: Column) -> Column:
    """Logarithmic bucket, 256 per factor of e, signed; at most about 750,000."""
    scaled = F.floor(F.log(F.abs(value)) * _PER_E_FOLD) + F.lit(_OFFSET)
    return (
        F.when(value > 0, scaled).when(value < 0, -scaled).otherwise(F.lit(0)).cast("long")
    )


def _fine(value: Column, coarse: Column) -> Column:
    """Linear bucket inside a coarse one, about 65,000 of them."""
    low = F.exp((F.abs(coarse) - F.lit(_OFFSET)) / F.lit(float(_PER_E_FOLD)))
    part = F.floor((F.abs(value) / low - 1.0) * float(_PER_E_FOLD * _FINE))
    return F.when(value > 0, part).when(value < 0, -part).otherwise(F.lit(0)).cast("long")


def _ranks(n: Column, fractions: Sequence[float]) -> Column:
    wanted = []
    for fraction in fractions:
        position = F.lit(float(fraction)) * (n - 1)
        wanted += [F.floor(position), F.ceil(position)]
    return F.array_distinct(F.array(*wanted))


def _holding(counted: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Buckets that hold a wanted rank, with the number of rows before each.

    ``counted`` carries ``_n`` (rows of the group), ``_base`` (rows before the
    enclosing bucket) and ``_count``.
    """
    running = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.sum("_count").over(running)
    return (
        counted.withColumn("_upto", upto)
        .withColumn("_before", F.col("_upto") - F.col("_count"))
        .where(
            F.exists(
                F.col("_ranks"),
                lambda r: (r >= F.col("_base") + F.col("_before"))
                & (r < F.col("_base") + F.col("_upto")),
            )
        )
        .withColumn("_base", F.col("_base") + F.col("_before"))
        .drop("_before", "_upto", "_count")
    )


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, _v, _w``: every finite value of each group once, with its number of rows."""
    number = F.col(value).cast("double")
    rows = df.select(*keys, number.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    return rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """One row per group with linearly interpolated quantiles at ``q * (n - 1)``.

    Null and non-finite values are left out.  ``quantiles`` maps output names to
    fractions.  The input is read once: its counted values are three times the same exchange.
    """
    keys = list(keys)
    fractions = list(quantiles.values())
    if any(not 0.0 <= q <= 1.0 for q in fractions):
        raise ValueError("quantile fractions must lie in [0, 1]")
    rows = counted_values(df, keys, value).withColumn("_b0", _coarse(F.col("_v")))

    whole = Window.partitionBy(*keys)
    level0 = (
        rows.groupBy(*keys, "_b0")
        .agg(F.sum("_w").alias("_count"))
        .withColumn("_n", F.sum("_count").over(whole))
        .withColumn("_ranks", _ranks(F.col("_n"), fractions))
        .withColumn("_base", F.lit(0).cast("long"))
    )
    target0 = _holding(level0, keys, ["_b0"])

    # Of a value's rows one is left, so the joins need no salt; the held buckets are few.
    inside0 = rows.join(target0, [*keys, "_b0"]).withColumn("_b1", _fine(F.col("_v"), F.col("_b0")))
    level1 = inside0.groupBy(*keys, "_b0", "_b1").agg(
        F.sum("_w").alias("_count"),
        F.first("_n").alias("_n"),
        F.first("_ranks").alias("_ranks"),
        F.first("_base").alias("_base"),
    )
    target1 = _holding(level1, [*keys, "_b0"], ["_b1"])

    level2 = (
        rows.withColumn("_b1", _fine(F.col("_v"), F.col("_b0")))
        .join(target1, [*keys, "_b0", "_b1"])
        .withColumnRenamed("_w", "_count")
    )
    running = (
        Window.partitionBy(*keys, "_b0", "_b1")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = level2.withColumn("_hi", F.col("_base") + F.sum("_count").over(running)).withColumn(
        "_lo", F.col("_hi") - F.col("_count")
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v")))

    aggregates = []
    for index, fraction in enumerate(fractions):
        position = F.lit(float(fraction)) * (F.col("_n") - 1)
        aggregates += [
            at_rank(F.floor(position)).alias(f"_low{index}"),
            at_rank(F.ceil(position)).alias(f"_high{index}"),
        ]
    picked = values.groupBy(*keys, "_n").agg(*aggregates)
    outputs = []
    for index, (name, fraction) in enumerate(quantiles.items()):
        position = F.lit(float(fraction)) * (F.col("_n") - 1)
        weight = position - F.floor(position)
        low, high = F.col(f"_low{index}"), F.col(f"_high{index}")
        outputs.append(
            F.when(weight == 0, low).otherwise(low * (1.0 - weight) + high * weight).alias(name)
        )
    return picked.select(*keys, *outputs)
