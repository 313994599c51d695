"""Numbers of rows in a global order, without a task that holds all rows or all of one group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posequery.session import cut


def in_ranges(rows: DataFrame, order: Sequence[str], ranges: int | None = None, part: str = "_part") -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and written, with the number of their range.

    Range numbers ascend with the order, nulls first; without ``ranges`` adaptive execution merges
    small ones.  ``rows`` should come from a written table, since finding the borders reads them
    once more.  Rows that are equal in ``order`` share a range; give it a last column that
    tells rows apart.
    """
    return cut(rows.repartitionByRange(*([ranges] if ranges else []), *order).withColumn(part, F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in ``order`` among the rows that are equal in ``within``.

    ``within`` must lead ``order``.  Rows are numbered per range; ranges of a group, a few numbers
    each, are summed over the groups' ranges.
    """
    parts = in_ranges(rows, order)
    group = [*within, "_part"]
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*group).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    renamed = before.select(*(F.col(c).alias(f"_of_{c}") for c in group), "_before")
    same = [own[c].eqNullSafe(renamed[f"_of_{c}"]) for c in within]
    joined = own.join(renamed, [own["_part"] == renamed["_of__part"], *same], "left")
    return joined.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))
