"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in a shuffled order, gone through up to three times.  A
document finishes at a virtual time: the words its queue has served by then, divided by the
source's target.  All finishing times are sorted in one global order, dealt by ranges, and
the order is cut where the budget is spent.  Words are summed over chunks of the shuffled order
first and over chunks after that, so a source that holds most rows stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from posequery.llm.common import keyed_columns
from posequery.llm.numbering import in_ranges, numbered
from posequery.session import cut

WEIGHTS = (1, 2, 3)
#: A document is taken so many times at most.
ROUNDS = 3
_CHUNK = 8192
_WORD = r"[^\x20\x09-\x0D]+"


def shuffled(key: Column) -> Column:
    """Where a key stands in the shuffled order: hexadecimal digits."""
    return F.md5(key.cast("string").cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """``source, queue, documents, source_size, target`` of every source of ``sizes`` (``source, size``).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes.  No target is above ``rounds`` times its source's size; what is above goes to the
    others by weight, again and again until none is.  Only sums reach the driver.
    """
    table = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    table = numbered(cut(table.withColumn("_none", F.col("source").isNull()), "sources"), ["_none", "source"], name="queue")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("queue") % len(weights) + 1).cast("int")).cast("long")
    table = table.select("source", "queue", "documents", "source_size", weight.alias("weight"), (F.col("source_size") * rounds).alias("most"))
    table = cut(table, "weights")
    exact = "decimal(19,0)"  # products of two stay exact
    budget = table.agg(F.sum("source_size")).first()[0] or 0
    capped, left, open_weight, above = -1, budget, 0, F.lit(False)
    while True:
        sums = table.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.lit(0)),
            F.count(F.when(above, 1)),
        ).first()
        if sums[2] == capped:
            break
        left, open_weight, capped = budget - sums[0], sums[1], sums[2]
        above = F.col("weight").cast(exact) * F.lit(left).cast(exact) > F.col("most").cast(exact) * F.lit(open_weight).cast(exact)
    share = (F.col("weight") * left).cast("double") / F.lit(float(max(open_weight, 1)))
    return table.select("source", "queue", "documents", "source_size", F.when(above, F.col("most").cast("double")).otherwise(share).alias("target"))


def served(rows: DataFrame) -> DataFrame:
    """``rows`` (``_key, queue, size, documents``) with the words that their queue serves up to and with each."""
    at = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("_order", shuffled(F.col("_key")))
    rows = rows.withColumn("_chunk", F.floor(at * F.ceil(F.col("documents") / _CHUNK)))
    chunk = ["queue", "_chunk"]
    local = Window.partitionBy(*chunk).orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("queue").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*chunk).agg(F.sum("size").alias("_sum"))
    sums = sums.select(*chunk, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.withColumn("_own", F.sum("size").over(local)).join(sums, chunk)
    return joined.withColumn("served", F.col("_own") + F.col("_before")).drop("_order", "_chunk", "_own", "_before")


def first_beyond(rows: DataFrame, order: list[str], most: int) -> Row | None:
    """The first of ``rows`` in ``order`` at which the sum of ``size`` passes ``most``.

    Rows are dealt by ranges; the range that passes is dealt again until one task can sort it.
    """
    before = 0
    ranges = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        dealt = in_ranges(rows, order, ranges)
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        parts = dealt.groupBy("_part").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"))
        parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        part = parts.where(F.col("_before") + F.col("_sum") > most - before).orderBy("_part").first()
        if part is None:
            return None
        rows, before = dealt.where(F.col("_part") == part["_part"]).drop("_part"), before + part["_before"]
        if part["_n"] <= _CHUNK * 4:
            break
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", upto + before).where(F.col("_upto") > most).orderBy(*order).first()


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken`` of every row.

    ``size`` counts words (runs outside ``[\\x20\\x09-\\x0D]``; null texts have none), ``times`` says how
    often the mix takes the document, whole each time, and ``taken`` is ``times * size``.  A source's taken
    words differ from its target by less than one document, and by what other sources leave
    of the budget.  Rows without words are never taken; null sources are one source, the last;
    texts of any length are counted whole.  The shuffled order comes from the ids, so reruns
    agree; rows with null or repeated ids are told apart by :func:`common.keyed_columns`.  An
    empty table gives no rows.  Runs jobs when called.
    """
    rows = keyed_columns(docs, {"doc_id": id_col, "source": source_col, "text": text_col})
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    sized = cut(rows.select("_key", "doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    per_source = targets(sized, weights, rounds).withColumnRenamed("source", "_from")
    beside = sized.join(per_source, sized["source"].eqNullSafe(per_source["_from"])).drop("_from")
    queued = cut(served(cut(beside, "beside")), "queues")
    open_ = (F.col("size") > 0) & (F.col("target") > 0)

    def finish(turn: int) -> Column:
        return (F.col("source_size") * turn + F.col("served")).cast("double") / F.col("target")

    turns = queued.where(open_).select("_key", "size", F.posexplode(F.array(*map(finish, range(rounds)))).alias("turn", "finish"))
    last = first_beyond(turns, ["finish", "_key", "turn"], sized.agg(F.sum("size")).first()[0] or 0)
    if last is None:
        times = F.lit(rounds)
    else:
        edge = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["_key"]).cast("long").alias("_key"), F.lit(last["turn"]).alias("turn"))
        times = sum((F.struct(finish(k).alias("finish"), "_key", F.lit(k).alias("turn")) < edge).cast("int") for k in range(rounds))
    times = F.when(open_, times).otherwise(0)
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", times.alias("times"), (times.cast("long") * F.col("size")).alias("taken")
    )
