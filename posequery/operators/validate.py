"""Checks that report violations with their place instead of failing or dropping rows.

A violation row holds the keys of its source, ``line``, ``ts_ns``, ``code`` and ``field``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequery.functions.geometry import Quat, quat_norm
from posequery.plans.ordered import Scan, ordered_scan

# Accepted deviation of an input quaternion norm, of a rotation, of identity.
QUATERNION_TOLERANCE = 1e-3
ROTATION_TOLERANCE = 1e-6
IDENTITY_TOLERANCE = 1e-12
LINES = 65_536


def _violation(code: Column, field: Column | None = None) -> Column:
    place = field if field is not None else F.lit(None).cast("string")
    return F.struct(code.alias("code"), place.alias("field"))


def check_order(
    rows: DataFrame, keys: Sequence[str], line: str = "line", width: int = LINES, repeats: bool = False
) -> DataFrame:
    """Rows whose stamp repeats or precedes the latest one on the lines before.

    The rows that are left are strictly increasing, whatever was in between.  With ``repeats`` a stamp may
    repeat the latest one, and they never decrease.
    """
    scanned = ordered_scan(
        rows.select(*keys, line, "ts_ns"),
        keys,
        [line],
        width,
        latest_ns=Scan("max_before", F.col("ts_ns")),
    )
    code = F.when(F.col("ts_ns") < F.col("latest_ns"), "out_of_order_timestamp")
    if not repeats:
        code = code.when(F.col("ts_ns") == F.col("latest_ns"), "duplicate_timestamp")
    return scanned.select(
        *keys, line, "ts_ns", code.alias("code"), F.lit("timestamp").alias("field")
    ).where(F.col("code").isNotNull())


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def check_finite_text(fields: dict[str, Column]) -> Column:
    """Violations of text fields that should be finite numbers, as an array of structs."""
    found = []
    for name, text in fields.items():
        number = text.try_cast("double")
        code = F.when(number.isNull(), "invalid_field").when(
            ~is_finite(number), "non_finite_measurement"
        )
        found.append(F.when(code.isNotNull(), _violation(code, F.lit(name))))
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def check_quaternion(q: Quat, tolerance: float = QUATERNION_TOLERANCE) -> Column:
    """Whether the norm is within ``tolerance`` of one."""
    norm = quat_norm(q)
    return is_finite(norm) & (F.abs(norm - 1.0) <= tolerance)


def check_rotation(m: Sequence[Column], tolerance: float = ROTATION_TOLERANCE) -> Column:
    """Whether a row-major 3x3 matrix is a proper rotation."""
    squares = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            dot = sum((m[3 * k + i] * m[3 * k + j] for k in range(1, 3)), m[i] * m[j])
            squares = squares + (dot - (1.0 if i == j else 0.0)) ** 2
    determinant = (
        m[0] * (m[4] * m[8] - m[5] * m[7])
        - m[1] * (m[3] * m[8] - m[5] * m[6])
        + m[2] * (m[3] * m[7] - m[4] * m[6])
    )
    finite = F.lit(True)
    for value in m:
        finite = finite & is_finite(value)
    return (
        finite & (F.sqrt(squares) <= tolerance) & (F.abs(determinant - 1.0) <= tolerance)
    )


def check_transform(m: Sequence[Column], field: str) -> Column:
    """First violation of a row-major 4x4 rigid transform, or null."""
    rotation = [m[4 * i + j] for i in range(3) for j in range(3)]
    finite = F.lit(True)
    for value in m:
        finite = finite & is_finite(value)
    bottom = F.sqrt(m[12] ** 2 + m[13] ** 2 + m[14] ** 2 + (m[15] - 1.0) ** 2)
    code = (
        F.when(~finite, "non_finite_value")
        .when(~check_rotation(rotation), "invalid_rotation")
        .when(bottom > ROTATION_TOLERANCE, "invalid_homogeneous_row")
    )
    return F.when(code.isNotNull(), _violation(code, F.lit(field)))


def is_identity(m: Sequence[Column]) -> Column:
    near = F.lit(True)
    for i in range(4):
        for j in range(4):
            near = near & (
                F.abs(m[4 * i + j] - (1.0 if i == j else 0.0)) <= IDENTITY_TOLERANCE
            )
    return near


def check_calibration(
    finite: dict[str, Column],
    positive: dict[str, Column],
    transforms: dict[str, Sequence[Column]],
    identities: dict[str, Sequence[Column]],
    left_centre: Sequence[Column],
    right_centre: Sequence[Column],
) -> Column:
    """All violations of a calibration row, as an array of ``code, field`` structs."""
    found = [
        F.when(~is_finite(c), _violation(F.lit("non_finite_value"), F.lit(n)))
        for n, c in finite.items()
    ]
    for name, column in positive.items():
        code = F.when(~is_finite(column), "non_finite_value").when(
            column <= 0, "non_positive_value"
        )
        found.append(F.when(code.isNotNull(), _violation(code, F.lit(name))))
    found += [check_transform(m, n) for n, m in transforms.items()]
    found += [
        F.when(~is_identity(m), _violation(F.lit("unsupported_extrinsics"), F.lit(n)))
        for n, m in identities.items()
    ]
    baseline = sum(
        ((a - b) ** 2 for a, b in zip(left_centre, right_centre, strict=True)), F.lit(0.0)
    )
    found.append(
        F.when(
            baseline <= 0.0, _violation(F.lit("zero_stereo_baseline"), F.lit("camera_centres"))
        )
    )
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def first_error(violations: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """The violation a fail-fast reader would report: the lowest line of each source."""
    rest = [c for c in violations.columns if c not in keys]
    ordered = F.struct(F.col(line), *[F.col(c) for c in rest if c != line])
    return violations.groupBy(*keys).agg(F.min(ordered).alias("first")).select(*keys, "first.*")


def quarantine(
    rows: DataFrame, violations: DataFrame, keys: Sequence[str], line: str = "line"
) -> tuple[DataFrame, DataFrame]:
    """Rows without and with violations."""
    place = [*keys, line]
    bad = violations.select(*place).distinct()
    return rows.join(bad, place, "left_anti"), rows.join(bad, place, "left_semi")


class ValidationError(ValueError):
    """Raised by the strict policy with the first violations found."""


def require_valid(violations: DataFrame, keys: Sequence[str], line: str = "line") -> None:
    """Strict policy: raise with up to ten sources that have violations."""
    found = first_error(violations, keys, line).limit(10).collect()
    if found:
        raise ValidationError("; ".join(str(row.asDict()) for row in found))
