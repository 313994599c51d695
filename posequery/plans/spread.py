"""Joining a table of one row per key to rows of which one key may hold a large share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_per_key(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """``rows`` beside their key's row of ``per_key``, with every key cut into salts.

    A plain join on the key keeps a hot key in one task when the next step groups by the
    same key: the shuffle is reused, nothing is combined before it, and the adaptive skew
    split is not applied.  Each row takes a salt from its own values, so that a task that runs
    again gives the same salts; the small side is copied to all salts, and a following
    aggregation combines before it shuffles.  ``salts`` is the number of shuffle partitions
    unless given, at least ``SALTS``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if salts is None:
        salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
