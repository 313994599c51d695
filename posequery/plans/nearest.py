"""Nearest-in-time matching within a tolerance, with linear output.

Rows of both sides are merged per ``(key, time chunk)``; candidates within the
tolerance of a chunk border are copied to the neighbour chunk.  A forward and a
backward fill then give each query row its closest candidate on either side.
No pairs are formed, so dense stretches cost a sort and nothing more, and one
shuffle serves both fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posequery.plans.ordered import chunk_start

_CANDIDATE, _QUERY = 0, 1


def _candidate_chunks(stamp: Column, tolerance: int, width: int) -> Column:
    return F.array_distinct(
        F.array(
            chunk_start(stamp - F.lit(tolerance), width),
            chunk_start(stamp + F.lit(tolerance), width),
        )
    )


def _check(tolerance: int, width: int, prefer: str) -> None:
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    if 2 * tolerance >= width:
        raise ValueError("chunk width must exceed twice the tolerance")
    if prefer not in ("earlier", "later"):
        raise ValueError("prefer must be 'earlier' or 'later'")


def _fill(merged: DataFrame, keys: Sequence[str], tolerance: int, prefer: str) -> DataFrame:
    partition = Window.partitionBy(*keys, "_chunk")
    rows = (Window.unboundedPreceding, Window.currentRow)
    ascending = partition.orderBy(F.asc("_t"), F.asc("_side")).rowsBetween(*rows)
    descending = partition.orderBy(F.desc("_t"), F.asc("_side")).rowsBetween(*rows)
    filled = (
        merged.withColumn("_back", F.last("_candidate", ignorenulls=True).over(ascending))
        .withColumn("_next", F.last("_candidate", ignorenulls=True).over(descending))
        .where(F.col("_side") == _QUERY)
    )
    behind = F.col("_t") - F.col("_back._t")
    ahead = F.col("_next._t") - F.col("_t")
    take_next = (ahead < behind) if prefer == "earlier" else (ahead <= behind)
    chosen = (
        F.when(F.col("_back").isNull(), F.col("_next"))
        .when(F.col("_next").isNull(), F.col("_back"))
        .when(take_next, F.col("_next"))
        .otherwise(F.col("_back"))
    )
    return filled.withColumn("_best", chosen).withColumn(
        "_best",
        F.when(F.abs(F.col("_best._t") - F.col("_t")) <= F.lit(tolerance), F.col("_best")),
    )


def nearest_within(
    queries: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str],
    query_time: str,
    candidate_time: str,
    tolerance: int,
    width: int,
    prefer: str = "earlier",
    match: str = "match",
) -> DataFrame:
    """Every query row plus ``match``, a struct of its nearest candidate or null.

    ``prefer`` decides ties.  Times are integral; the bound is inclusive.
    """
    _check(tolerance, width, prefer)
    keys = list(keys)
    candidate_type = F.struct(
        F.col(candidate_time).alias("_t"),
        *[F.col(c) for c in candidates.columns if c not in keys],
    )
    right = candidates.select(
        *keys,
        F.explode(_candidate_chunks(F.col(candidate_time), tolerance, width)).alias("_chunk"),
        F.col(candidate_time).alias("_t"),
        F.lit(_CANDIDATE).alias("_side"),
        candidate_type.alias("_candidate"),
    )
    left = queries.select(
        *keys,
        chunk_start(F.col(query_time), width).alias("_chunk"),
        F.col(query_time).alias("_t"),
        F.lit(_QUERY).alias("_side"),
        F.struct(*[F.col(c) for c in queries.columns if c not in keys]).alias("_query"),
    )
    filled = _fill(
        left.unionByName(right, allowMissingColumns=True), keys, tolerance, prefer
    )
    names = [c for c in queries.columns if c not in keys]
    payload = [c for c in candidates.columns if c not in keys]
    best = F.when(
        F.col("_best").isNotNull(), F.struct(*[F.col(f"_best.{c}").alias(c) for c in payload])
    )
    return filled.select(
        *keys, *[F.col(f"_query.{c}").alias(c) for c in names], best.alias(match)
    )


def nearest_in_self(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    offset: int,
    tolerance: int,
    width: int,
    prefer: str = "later",
    match: str = "match",
) -> DataFrame:
    """Like :func:`nearest_within` for targets ``time + offset`` among the same rows.

    Each row is emitted as query and as candidate by one ``explode``, so the input
    is computed once.
    """
    _check(tolerance, width, prefer)
    keys = list(keys)
    names = [c for c in rows.columns if c not in keys]
    stamp = F.col(time)
    target = stamp + F.lit(offset)
    as_query = F.array(
        F.struct(
            chunk_start(target, width).alias("_chunk"),
            target.alias("_t"),
            F.lit(_QUERY).alias("_side"),
        )
    )
    as_candidate = F.transform(
        _candidate_chunks(stamp, tolerance, width),
        lambda chunk: F.struct(
            chunk.alias("_chunk"), stamp.alias("_t"), F.lit(_CANDIDATE).alias("_side")
        ),
    )
    merged = rows.select(
        *keys,
        F.struct(*[F.col(c) for c in names]).alias("_row"),
        F.explode(F.concat(as_query, as_candidate)).alias("_role"),
    ).select(*keys, "_row", "_role._chunk", "_role._t", "_role._side")
    merged = merged.withColumn(
        "_candidate",
        F.when(
            F.col("_side") == _CANDIDATE,
            F.struct(F.col("_t").alias("_t"), F.col("_row").alias("row")),
        ),
    )
    filled = _fill(merged, keys, tolerance, prefer)
    return filled.select(
        *keys,
        *[F.col(f"_row.{c}").alias(c) for c in names],
        F.col("_best.row").alias(match),
    )
