"""Text files as numbered lines.

Spark's text source gives no line numbers.  A line's place is its file, the start of
its block and its order inside the block; blocks are numbered by counting, so a file of
any size is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posequery.plans.spread import join_per_key


# Fixed value: how folders of Hive-style layouts spell a null.
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class Parsed(NamedTuple):
    """Valid rows, and one row per violation with file, line, code and field."""

    rows: DataFrame
    violations: DataFrame


def read_lines(
    spark: SparkSession, path: str | Sequence[str], recursive: bool = False, only: Sequence[str] = ()
) -> DataFrame:
    """``file, line, value`` plus partition columns of the path; carriage returns removed.

    ``only`` are conditions on partition columns; those whose column the path lacks are passed over, the
    others choose the folders that are read.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    raw = reader.text(path)
    extra = [c for c in raw.columns if c != "value"]
    for condition in only:
        if condition.split()[0] in extra:
            raw = raw.where(condition)
    placed = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"),
        F.regexp_replace("value", "\r$", "").alias("value"),
        *extra,
    )
    inside = Window.partitionBy("file", "_block").orderBy("_order")
    earlier = (
        Window.partitionBy("file")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("file", "_block")
        .agg(F.count(F.lit(1)).alias("_lines"))
        .select(
            "file",
            "_block",
            F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    return (
        placed.withColumn("_nth", F.row_number().over(inside))
        .join(starts, ["file", "_block"], "left")
        .select(
            "file",
            (F.coalesce("_before", F.lit(0).cast("long")) + F.col("_nth")).alias("line"),
            "value",
            *extra,
        )
    )


def write_in_order(
    rows: DataFrame, folders: Sequence[str], order: str, path: str, format: str = "text", **options: str
) -> None:
    """Files in folders named by ``folders``, whose lines keep rising ``order``; other columns are written.

    Spark's writer sorts by the folders anew, and drops the sort before, unless it can see that
    the rows come sorted that way.  It cannot where a folder is constant or may be null, so each is made a
    text that is neither; a null goes to the folder that reads back as null.
    """
    varying = F.substring(F.coalesce(F.col(order).cast("string"), F.lit("")), 1, 0)
    names = {c: F.coalesce(F.concat(F.col(c).cast("string"), varying), F.lit(_NULL_FOLDER)) for c in folders}
    ordered = rows.withColumns(names).repartitionByRange(*folders, order).sortWithinPartitions(*folders, order)
    ordered.drop(order).write.partitionBy(*folders).options(**options).format(format).save(path)


def violation(code: str | Column, field: str | Column | None = None) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    field = F.lit(field).cast("string") if not isinstance(field, Column) else field
    return F.struct(code.alias("code"), field.alias("field"))


def first_violation(*checks: Column) -> Column:
    """The first check that is not null."""
    return F.coalesce(*checks)


def number_checks(fields: Column, names: Sequence[str], offset: int) -> list[Column]:
    """Parse and finiteness checks of consecutive text fields, in order."""
    checks = []
    for index, name in enumerate(names):
        number = F.get(fields, F.lit(offset + index)).try_cast("double")
        finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
        checks.append(
            F.when(number.isNull(), violation("invalid_field", name)).when(
                ~finite, violation("non_finite_measurement", name)
            )
        )
    return checks


def stamp_check(text: Column) -> Column:
    """Integer nanosecond stamps; too many digits are told apart from other text."""
    return F.when(
        text.try_cast("long").isNull() & text.rlike(r"^-?[0-9]+$"),
        violation("timestamp_overflow", "timestamp"),
    ).when(~text.rlike(r"^-?[0-9]+$"), violation("invalid_field", "timestamp"))


def headed_columns(
    lines: DataFrame, columns: dict[str, str], separator: str = ","
) -> DataFrame:
    """CSV columns picked by header name, so files of different age read alike.

    A column the file does not have is null, and so is text of the wrong type.
    """
    pattern = f"[{separator}]"
    headers = lines.where(F.col("line") == 1).select(
        "file", F.split("value", pattern, -1).alias("_header")
    )
    content = lines.where((F.col("line") > 1) & (F.length("value") > 0))
    body = join_per_key(content, headers, ["file"])
    fields = F.split("value", pattern, -1)

    def pick(name: str, kind: str) -> Column:
        at = F.array_position("_header", name).cast("int")
        text = F.when(at > 0, F.get(F.col("_fields"), at - 1))
        if kind == "boolean":
            return F.when(text.isin("1", "true"), True).when(text.isin("0", "false"), False)
        return text if kind == "string" else text.try_cast(kind)

    extra = [c for c in lines.columns if c not in ("file", "line", "value")]
    return body.withColumn("_fields", fields).select(
        "file", "line", *extra, *[pick(n, k).alias(n) for n, k in columns.items()]
    )
