"""Running a bounded counter along ordered rows without walking a key from end to end.

A step adds to the counter and then limits it from both sides.  Steps in a row act like one
step, so a stretch of rows is three numbers whatever its length.  Rows compose within chunks,
chunks within groups of chunks, and so on up; what enters a chunk then comes down the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posequery.session import cut

#: A limit that no counter reaches.
OPEN = 1 << 61
_GROUP = 8192


def composed(add: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the steps of each segment do together, up to and with each; ``first`` numbers the segments' first rows.

    Reach doubles each turn, so a segment of ``n`` rows takes ``log2 n`` turns over whole arrays.
    """
    add, low, high = add.copy(), low.copy(), high.copy()
    row, reach = np.arange(len(add)), 1
    while True:
        later = np.flatnonzero(row - reach >= first)
        if not len(later):
            return add, low, high
        before = later - reach
        a, lo, hi = add[later], low[later], high[later]
        low_, high_ = np.clip(low[before] + a, lo, hi), np.clip(high[before] + a, lo, hi)
        add[later], low[later], high[later] = add[before] + a, low_, high_
        reach *= 2


def _before(rows: pa.Table, keys: Sequence[str]) -> pa.Table:
    """``rows`` in order, with ``add, low, high`` of all earlier rows of their ``keys`` together, and how many add."""
    same = np.ones(max(len(rows) - 1, 0), bool)
    for key in keys:
        column = rows.column(key).to_numpy()
        same &= column[1:] == column[:-1]
    place = np.arange(len(rows))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0)) if len(rows) else place
    steps = [rows.column(c).to_numpy() for c in ("add", "low", "high")]
    found = composed(*steps, first)
    opens = place == first
    out = rows
    for name, values, start in zip(("add", "low", "high"), found, (0, -OPEN, OPEN)):
        earlier = np.where(opens, start, np.roll(values, 1)) if len(values) else values
        out = out.append_column(f"{name}_before", pa.array(earlier, pa.int64()))
    ups = np.cumsum(steps[0] > 0) - (steps[0] > 0)
    return out.append_column("ups_before", pa.array(ups - ups[first] if len(ups) else ups, pa.int64()))


def whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of sorted ``batches`` that hold all rows of each of their ``keys``, columns in one piece."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        last = np.ones(len(held), bool)
        for key in keys:
            column = held.column(key).to_numpy()
            last &= column == column[-1]
        done = len(held) - int(last[::-1].cumprod().sum())
        if done:
            yield held.slice(0, done).combine_chunks()
            held = held.slice(done)
    if held is not None and len(held):
        yield held.combine_chunks()


def steps_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``add_before, low_before, high_before``: all earlier steps of their ``keys`` as one.

    ``ups_before`` counts those that add, where steps add or take off one.  ``rows`` have longs ``add``, ``low`` and ``high``, ``keys`` of integers and all rows of a key in one
    partition's reach; a task holds one Arrow batch and the key at its border.
    """
    schema = rows.select("*", *(F.lit(0).cast("long").alias(f"{c}_before") for c in ("add", "low", "high", "ups"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            yield from _before(table, keys).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def entering(steps: DataFrame, number: str = "chunk") -> DataFrame:
    """``seq, chunk, entry``: the counter, from 0, at which each chunk of ``steps`` is entered.

    ``steps`` holds a row for each chunk (``seq, chunk, add, low, high``) and should be written.
    Groups of neighbouring chunks go first, then groups of groups, until there is one.
    """
    low, high = steps.agg(F.min(number), F.max(number)).first()
    grouped = steps.withColumn("_group", F.floor((F.col(number) - F.lit(low)) / _GROUP))
    inner = steps_before(grouped, ["seq", "_group"], [number])
    if low is None or high - low < _GROUP:
        return inner.select("seq", number, clamped(F.lit(0).cast("long")).alias("entry"))
    inner = cut(inner, "inner")
    totals = cut(_together(inner, ["seq", "_group"], [number]).withColumnRenamed("_group", number), "totals")
    outer = entering(totals, number).select("seq", F.col(number).alias("_group"), F.col("entry").alias("_start"))
    return inner.join(outer, ["seq", "_group"]).select("seq", number, clamped(F.col("_start")).alias("entry"))


def _together(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *sums: Column) -> DataFrame:
    """One step for all rows of :func:`steps_before` of each key, and further aggregates."""
    last = F.struct(*(F.col(c) for c in order), "add_before", "low_before", "high_before", "add", "low", "high")
    found = rows.groupBy(*keys).agg(F.max(last).alias("x"), *sums)
    both = {c: F.greatest(F.col("x.low"), F.least(F.col("x.high"), F.col(f"x.{c}_before") + F.col("x.add"))) for c in ("low", "high")}
    rest = [c for c in found.columns if c != "x"]
    return found.select(*rest, (F.col("x.add_before") + F.col("x.add")).alias("add"), *(v.alias(c) for c, v in both.items()))


def clamped(entry: Column) -> Column:
    """The counter before a row of :func:`steps_before` whose key was entered at ``entry``."""
    return F.greatest(F.col("low_before"), F.least(F.col("high_before"), entry + F.col("add_before")))


def counters(rows: DataFrame, order: Sequence[str], ups: str = "ups", downs: str = "downs") -> DataFrame:
    """``rows`` (``seq, chunk, add, low, high`` and more) with the counter ``before`` each, from 0 per ``seq``.

    ``ups`` and ``downs`` count the earlier rows that add and take off.
    """
    scanned = cut(steps_before(rows, ["seq", "chunk"], order), "steps")
    chunks = cut(_together(scanned, ["seq", "chunk"], order, F.count_if(F.col("add") > 0).alias("_ups"), F.count_if(F.col("add") < 0).alias("_downs")), "chunks")
    earlier = Window.partitionBy("seq").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunks.select("seq", "chunk", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_ups", "_downs")))
    joined = scanned.join(entering(chunks.drop("_ups", "_downs")), ["seq", "chunk"]).join(counts, ["seq", "chunk"])
    found = joined.withColumns({
        "before": clamped(F.col("entry")),
        ups: F.col("_ups") + F.col("ups_before"),
        downs: F.col("_downs") + F.col("ups_before") - F.col("add_before"),
    })
    return found.drop("add", "low", "high", "add_before", "low_before", "high_before", "ups_before", "entry", "_ups", "_downs")
