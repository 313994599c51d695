"""Ordered scans (lag, fill, running sum) that do not put a whole key in one task.

A plain ``Window.partitionBy(seq)`` sends a sequence to one task however long it
is.  Here a key is cut into chunks of the ordering column.  Rows are windowed per
``(key, chunk)``; one summary row per chunk is windowed per key and joined back.
A task therefore sees one chunk of rows, or one row per chunk, never a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """One output column of :func:`ordered_scan`.

    ``kind`` is one of

    * ``lag``: the value ``offset`` rows before, null where there is none;
    * ``last``: the latest non-null value up to and including the row;
    * ``last_before``: the latest non-null value strictly before the row;
    * ``sum``, ``max``: running aggregate including the row;
    * ``max_before``: running maximum strictly before the row.

    ``back`` turns this scan round, so that ``lag`` is lead and ``last`` is next.
    """

    kind: str
    value: Column
    offset: int = 1
    back: bool = False


def chunk_start(value: Column, width: int) -> Column:
    """Start of the chunk of ``width`` that holds ``value``; exact on longs."""
    return value - F.pmod(value, F.lit(width))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: int,
    reverse: bool = False,
    once: bool = False,
    **scans: Scan,
) -> DataFrame:
    """Add one column per scan, evaluated in ``order`` within ``keys``.

    ``order[0]`` must be integral; ``width`` chunks it.  ``order`` must be unique
    within a key.  ``reverse`` turns every scan round; scans of both directions share a pass.

    Rows and chunk summaries are two uses of ``df``.  By default the summaries read only their
    own columns and are combined before they shuffle.  With ``once``, for scans that read every
    column of ``df``, both come from one shuffle of the rows and ``df`` is computed once.
    """
    keys = list(keys)
    base = df.withColumn("_chunk", chunk_start(F.col(order[0]), width))
    place = [*keys, "_chunk"]
    if once:
        # A struct is never null, so the join below puts no filter under one of the two uses.
        # It takes the keys along, so that both uses read the same columns of the shuffle.
        base = base.withColumn("_place", F.struct(*place)).drop(*place).repartition("_place")
        base = base.select("*", *[F.col("_place")[c].alias(c) for c in keys])
        place = ["_place"]
    for name, scan in scans.items():
        base = base.withColumn(f"_in_{name}", scan.value)

    def windows(back: bool):
        turned = F.desc if back else F.asc
        local = Window.partitionBy(*place).orderBy(*[turned(c) for c in order])
        return local, Window.partitionBy(*keys).orderBy(turned("_chunk"))

    position = F.struct(*[F.col(c) for c in order])
    ends = base  # what chunk summaries are taken from
    local_columns: list[Column] = []
    summaries: list[Column] = []
    carries: list[Column] = []
    results: dict[str, Column] = {}
    for name, scan in scans.items():
        back = scan.back != reverse
        local, across = windows(back)
        upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = local.rowsBetween(Window.unboundedPreceding, -1)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        end_of = F.min_by if back else F.max_by
        value = F.col(f"_in_{name}")
        local_name, carry_name = f"_local_{name}", f"_carry_{name}"
        summary = F.col(f"_sum_{name}")
        if scan.kind == "lag" and scan.offset == 1:
            local_columns.append(F.lag(F.struct(value.alias("v"))).over(local).alias(local_name))
            summaries.append(end_of(F.struct(value.alias("v")), position).alias(f"_sum_{name}"))
            carries.append(F.lag(summary).over(across).alias(carry_name))
            results[name] = F.coalesce(F.col(local_name), F.col(carry_name))["v"]
        elif scan.kind == "lag":
            # A chunk hands on its last rows; the chunks before it fill up what it lacks.
            far, held = scan.offset, F.struct(position.alias("p"), value.alias("v"))
            left, nth = f"_left_{name}", f"_nth_{name}"
            ends = ends.withColumn(left, F.row_number().over(windows(not back)[0]))
            local_columns.append(F.lag(held, far).over(local).alias(local_name))
            local_columns.append(F.row_number().over(local).alias(nth))
            last_ones = F.sort_array(F.collect_list(F.when(F.col(left) <= far, held)), asc=not back)
            summaries.append(last_ones.alias(f"_sum_{name}"))
            carries.append(F.flatten(F.collect_list(summary).over(across.rowsBetween(-far, -1))).alias(carry_name))
            carried_over = F.get(F.col(carry_name), F.size(carry_name) - (far + 1) + F.col(nth))
            results[name] = F.when(F.col(nth) > far, F.col(local_name)).otherwise(carried_over)["v"]
        elif scan.kind in ("last", "last_before"):
            frame = upto if scan.kind == "last" else before
            local_columns.append(F.last(value, ignorenulls=True).over(frame).alias(local_name))
            summaries.append(
                end_of(value, F.when(value.isNotNull(), position)).alias(f"_sum_{name}")
            )
            carries.append(F.last(summary, ignorenulls=True).over(earlier).alias(carry_name))
            results[name] = F.coalesce(F.col(local_name), F.col(carry_name))
        elif scan.kind == "sum":
            local_columns.append(F.sum(value).over(upto).alias(local_name))
            summaries.append(F.sum(value).alias(f"_sum_{name}"))
            carries.append(F.sum(summary).over(earlier).alias(carry_name))
            results[name] = F.coalesce(F.col(local_name), F.lit(0)) + F.coalesce(
                F.col(carry_name), F.lit(0)
            )
        elif scan.kind in ("max", "max_before"):
            frame = upto if scan.kind == "max" else before
            local_columns.append(F.max(value).over(frame).alias(local_name))
            summaries.append(F.max(value).alias(f"_sum_{name}"))
            carries.append(F.max(summary).over(earlier).alias(carry_name))
            results[name] = F.greatest(F.col(local_name), F.col(carry_name))
        else:
            raise ValueError(f"unknown scan kind {scan.kind!r}")

    carried = ends.groupBy(*place).agg(*summaries)
    if once:
        carried = carried.select("*", *[F.col("_place")[c].alias(c) for c in (*keys, "_chunk")])
    carried = carried.select(*place, *carries)
    joined = base.select("*", *local_columns).join(carried, place, "left")
    kept = [c for c in df.columns if c not in scans]
    return joined.select(*kept, *[column.alias(name) for name, column in results.items()])
