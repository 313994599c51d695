"""Quaternions and rigid transforms as column expressions.

Quaternions are scalar-last, transforms map body points into the world frame.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


class Quat(NamedTuple):
    x: Column
    y: Column
    z: Column
    w: Column


class Pose(NamedTuple):
    t: Vec
    q: Quat


POSE_COLUMNS = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def vec(prefix: str, names: tuple[str, str, str] = ("x", "y", "z")) -> Vec:
    return Vec(*[F.col(prefix + n) for n in names])


def pose(parent: str = "") -> Pose:
    """Pose held in the flat columns (or struct fields) ``tx .. qw`` of ``parent``."""
    dot = f"{parent}." if parent else ""
    columns = [F.col(dot + name) for name in POSE_COLUMNS]
    return Pose(Vec(*columns[:3]), Quat(*columns[3:]))


def pose_struct(value: Pose) -> Column:
    return F.struct(
        *[c.alias(n) for c, n in zip([*value.t, *value.q], POSE_COLUMNS, strict=True)]
    )


def add(a: Vec, b: Vec) -> Vec:
    return Vec(a.x + b.x, a.y + b.y, a.z + b.z)


def subtract(a: Vec, b: Vec) -> Vec:
    return Vec(a.x - b.x, a.y - b.y, a.z - b.z)


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def length(a: Vec) -> Column:
    return F.sqrt(a.x * a.x + a.y * a.y + a.z * a.z)


def quat_norm(q: Quat) -> Column:
    return F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z + q.w * q.w)


def quat_normalize(q: Quat) -> Quat:
    norm = quat_norm(q)
    return Quat(q.x / norm, q.y / norm, q.z / norm, q.w / norm)


def quat_conjugate(q: Quat) -> Quat:
    return Quat(-q.x, -q.y, -q.z, q.w)


def quat_multiply(a: Quat, b: Quat) -> Quat:
    return Quat(
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
    )


def quat_rotate(q: Quat, v: Vec) -> Vec:
    axis = Vec(q.x, q.y, q.z)
    twice = Vec(*[2.0 * c for c in cross(axis, v)])
    turn = cross(axis, twice)
    return Vec(
        v.x + q.w * twice.x + turn.x,
        v.y + q.w * twice.y + turn.y,
        v.z + q.w * twice.z + turn.z,
    )


def quat_to_matrix(q: Quat) -> list[Column]:
    """Row-major 3x3 rotation of a unit quaternion."""
    return [
        1.0 - 2.0 * (q.y * q.y + q.z * q.z),
        2.0 * (q.x * q.y - q.z * q.w),
        2.0 * (q.x * q.z + q.y * q.w),
        2.0 * (q.x * q.y + q.z * q.w),
        1.0 - 2.0 * (q.x * q.x + q.z * q.z),
        2.0 * (q.y * q.z - q.x * q.w),
        2.0 * (q.x * q.z - q.y * q.w),
        2.0 * (q.y * q.z + q.x * q.w),
        1.0 - 2.0 * (q.x * q.x + q.y * q.y),
    ]


def matrix_to_quat(m: list[Column]) -> Quat:
    """Unit quaternion of a row-major rotation, by its largest component."""
    xx, yy, zz = m[0], m[4], m[8]
    trace = xx + yy + zz
    s_w = F.sqrt(F.greatest(trace + 1.0, F.lit(0.0))) * 2.0
    s_x = F.sqrt(F.greatest(1.0 + xx - yy - zz, F.lit(0.0))) * 2.0
    s_y = F.sqrt(F.greatest(1.0 + yy - xx - zz, F.lit(0.0))) * 2.0
    s_z = F.sqrt(F.greatest(1.0 + zz - xx - yy, F.lit(0.0))) * 2.0

    def choose(by_w: Column, by_x: Column, by_y: Column, by_z: Column) -> Column:
        return (
            F.when(trace > 0, by_w)
            .when((xx > yy) & (xx > zz), by_x)
            .when(yy > zz, by_y)
            .otherwise(by_z)
        )

    return Quat(
        choose((m[7] - m[5]) / s_w, s_x / 4.0, (m[1] + m[3]) / s_y, (m[2] + m[6]) / s_z),
        choose((m[2] - m[6]) / s_w, (m[1] + m[3]) / s_x, s_y / 4.0, (m[5] + m[7]) / s_z),
        choose((m[3] - m[1]) / s_w, (m[2] + m[6]) / s_x, (m[5] + m[7]) / s_y, s_z / 4.0),
        choose(s_w / 4.0, (m[7] - m[5]) / s_x, (m[2] - m[6]) / s_y, (m[3] - m[1]) / s_z),
    )


def rotation_angle_deg(q: Quat) -> Column:
    """Rotation angle in [0, 180] degrees, accurate near zero."""
    axis = F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z)
    return F.degrees(2.0 * F.atan2(axis, F.abs(q.w)))


def pose_compose(a: Pose, b: Pose) -> Pose:
    return Pose(add(a.t, quat_rotate(a.q, b.t)), quat_multiply(a.q, b.q))


def pose_inverse(a: Pose) -> Pose:
    back = quat_conjugate(a.q)
    moved = quat_rotate(back, a.t)
    return Pose(Vec(-moved.x, -moved.y, -moved.z), back)


def pose_apply(a: Pose, point: Vec) -> Vec:
    return add(a.t, quat_rotate(a.q, point))


def pose_between(a: Pose, b: Pose) -> Pose:
    """``a⁻¹ b``: the motion from ``a`` to ``b`` seen in ``a``."""
    back = quat_conjugate(a.q)
    return Pose(quat_rotate(back, subtract(b.t, a.t)), quat_multiply(back, b.q))
