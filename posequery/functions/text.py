"""Text, time-text, path-key and hash helpers as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def seconds_text_to_ns(text: Column) -> Column:
    """``<seconds>[.<up to 9 digits>]`` to integer nanoseconds, null when malformed."""
    ok = text.rlike(r"^-?[0-9]{1,10}(\.[0-9]{0,9})?$")
    negative = text.startswith("-")
    whole = F.regexp_extract(text, r"^-?([0-9]+)", 1).try_cast("long")
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]*)$", 1), 9, "0").try_cast("long")
    magnitude = whole * NANOS + F.coalesce(fraction, F.lit(0).cast("long"))
    return F.when(ok, F.when(negative, -magnitude).otherwise(magnitude))


def ns_to_seconds_text(stamp: Column) -> Column:
    """Integer nanoseconds as seconds with nine decimals, floored for negatives."""
    fraction = F.pmod(stamp, F.lit(NANOS))
    seconds = F.call_function("div", stamp - fraction, F.lit(NANOS))
    return F.concat(
        seconds.cast("string"), F.lit("."), F.lpad(fraction.cast("string"), 9, "0")
    )


def iso_utc(stamp: Column) -> Column:
    """ISO-8601 UTC text with second precision of an integer nanosecond stamp."""
    seconds = F.call_function("div", stamp - F.pmod(stamp, F.lit(NANOS)), F.lit(NANOS))
    moment = F.timestamp_seconds(seconds)
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_basename(name: Column) -> Column:
    """A bare file name: no separator, not empty, not a dot entry."""
    return (F.length(name) > 0) & ~name.contains("/") & ~name.isin(".", "..")


def run_key(sequence: Column, commit: Column, dirty: Column, label: Column, digest: Column) -> Column:
    """Ledger directory key, null when a required part is empty."""
    empty = F.lit(False)
    for part in (sequence, label, digest):
        empty = empty | (F.coalesce(F.length(part), F.lit(0)) == 0)
    known = F.when(F.coalesce(F.length(commit), F.lit(0)) == 0, F.lit("unknown")).otherwise(commit)
    suffix = F.when(dirty, F.lit("_dirty")).otherwise(F.lit(""))
    return F.when(
        ~empty,
        F.concat(sequence, F.lit("/"), known, suffix, F.lit("/"), label, F.lit("_"), digest),
    )


def _format_with(pattern: str):
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: pattern % v, na_action="ignore").astype(object)

    kernel.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(kernel, "string")


def g17(value: Column) -> Column:
    """``%.17g`` text.  The JVM prints the shortest digits instead, so this is an Arrow UDF."""
    return _format_with("%.17g")(value.cast("double"))


def g6(value: Column) -> Column:
    """``%.6g`` text for report tables."""
    return _format_with("%.6g")(value.cast("double"))


# Fixed values of 64-bit FNV-1a: offset basis (high and low word); the prime is
# 2^40 + 435.
_FNV_HIGH, _FNV_LOW, _FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_WORD = 0xFFFFFFFF


def fnv1a64_hex(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, 16 hex digits.

    Two 32-bit words in longs keep the wrapping product inside ANSI arithmetic.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    count = F.length(digits)
    offsets = F.when(count > 0, F.sequence(F.lit(1), count - 1, F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    octets = F.transform(
        offsets, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")
    )
    start = F.struct(
        F.lit(_FNV_HIGH).cast("long").alias("hi"), F.lit(_FNV_LOW).cast("long").alias("lo")
    )

    def step(state: Column, octet: Column) -> Column:
        mixed = state["lo"].bitwiseXOR(octet)
        product = mixed * _FNV_PRIME_LOW
        high = (
            state["hi"] * _FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        )
        return F.struct(
            high.bitwiseAND(F.lit(_WORD)).alias("hi"),
            product.bitwiseAND(F.lit(_WORD)).alias("lo"),
        )

    def word(value: Column) -> Column:
        return F.lpad(F.lower(F.hex(value)), 8, "0")

    return F.aggregate(
        octets, start, step, lambda s: F.concat(word(s["hi"]), word(s["lo"]))
    )
