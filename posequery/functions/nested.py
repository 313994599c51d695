"""Values from JSON documents, and configuration maps side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A variant; null where the text is null or no JSON."""
    return F.try_parse_json(text)


def is_object(document: Column) -> Column:
    """Whether a variant is a JSON object; false for null."""
    return F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))


def found_at(document: Column, paths: str | Sequence[str], kind: str, default=None, blank: bool = True) -> Column:
    """The value at the first of ``paths`` that is there and can be a ``kind``, else ``default``.

    Paths are names joined by dots.  A value of another type counts as missing, never as an error:
    a number given as text, say, is tried as a number.  Empty texts count unless ``blank`` is false.
    """
    values = [F.try_variant_get(document, f"$.{p}", kind) for p in ([paths] if isinstance(paths, str) else paths)]
    if not blank:
        values = [F.when(F.length(v) > 0, v) for v in values]
    return F.coalesce(*values, F.lit(default).cast(kind))


def differing(left: Column, right: Column) -> Column:
    """Keys under which two maps of text differ, in order, with both values; null for a missing one.

    An array of ``key, left, right``; empty for equal maps.  A null map counts as an empty one.
    """
    empty = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(
        F.coalesce(left, empty), F.coalesce(right, empty), lambda k, a, b: F.struct(a.alias("left"), b.alias("right"))
    )
    apart = F.map_filter(both, lambda k, v: ~v["left"].eqNullSafe(v["right"]))
    rows = F.transform(F.map_entries(apart), lambda e: F.struct(e["key"].alias("key"), e["value"]["left"].alias("left"), e["value"]["right"].alias("right")))
    return F.array_sort(rows)


def largest_shifts(ids: Column, shifts: Column, most: int) -> Column:
    """The ``most`` entries of largest shift as ``key, dt_m``, smaller keys first where equal.

    ``ids`` and ``shifts`` are arrays of one length, zipped place by place; entries without a shift
    are left out.
    """
    zipped = F.filter(F.zip_with(ids, shifts, lambda i, s: F.struct(i.alias("key"), s.alias("dt_m"))), lambda x: x["dt_m"].isNotNull())
    ranked = F.array_sort(
        zipped,
        lambda a, b: F.when(a["dt_m"] > b["dt_m"], -1).when(a["dt_m"] < b["dt_m"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
    )
    return F.slice(ranked, 1, most)
