"""Rectified stereo and lens projection as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from posequery.functions.geometry import Pose, Vec, pose_apply, pose_compose, pose_inverse


class Rig(NamedTuple):
    """Rectified stereo calibration: pixels, baseline in metres.

    Numbers for one rig, columns for a joined calibration table.
    """

    fx: Column | float
    fy: Column | float
    cx: Column | float
    cy: Column | float
    baseline: Column | float


def stereo_depth(r: Rig, disparity: Column) -> Column:
    """Depth in metres; null where the disparity is not positive."""
    return F.when(disparity > 0, r.fx * r.baseline / disparity)


def right_pixel(u: Column, disparity: Column) -> Column:
    return u - disparity


def back_project(r: Rig, u: Column, v: Column, disparity: Column) -> Vec:
    """Point in the left camera frame."""
    z = stereo_depth(r, disparity)
    return Vec((u - r.cx) * z / r.fx, (v - r.cy) * z / r.fy, z)


def back_project_world(
    r: Rig, body: Pose, u: Column, v: Column, disparity: Column, body_to_left: Pose | None = None
) -> Vec:
    left = pose_compose(body, body_to_left) if body_to_left else body
    return pose_apply(left, back_project(r, u, v, disparity))


def to_left_camera(body: Pose, point: Vec, body_to_left: Pose | None = None) -> Vec:
    left = pose_compose(body, body_to_left) if body_to_left else body
    return pose_apply(pose_inverse(left), point)


def stereo_residual(r: Rig, point: Vec, u: Column, v: Column, disparity: Column) -> Vec:
    """(left u, right u, v) residual in pixels of a point in the left camera frame.

    Behind the camera every axis takes the fixed value ``2 fx``.
    """
    behind = point.z <= 0
    inverse = 1.0 / F.when(point.z != 0, point.z)
    left_u = r.fx * point.x * inverse + r.cx
    fallback = 2.0 * r.fx
    return Vec(
        F.when(behind, fallback).otherwise(left_u - u),
        F.when(behind, fallback).otherwise(
            left_u - r.fx * r.baseline * inverse - right_pixel(u, disparity)
        ),
        F.when(behind, fallback).otherwise(r.fy * point.y * inverse + r.cy - v),
    )


class Lens(NamedTuple):
    """Pinhole intrinsics with four distortion coefficients.

    Radial-tangential order is k1, k2, p1, p2; equidistant is k1 .. k4.
    """

    fx: Column
    fy: Column
    cx: Column
    cy: Column
    d0: Column
    d1: Column
    d2: Column
    d3: Column


def _finite(*values: Column) -> Column:
    ok = F.lit(True)
    for value in values:
        ok = ok & F.coalesce(F.abs(value) < float("inf"), F.lit(False)) & ~F.isnan(value)
    return ok


def _projection(lens: Lens, point: Vec, xd: Column, yd: Column) -> Column:
    u, v = lens.fx * xd + lens.cx, lens.fy * yd + lens.cy
    code = (
        F.when(~_finite(*point), "non_finite_input")
        .when(point.z <= 0, "outside_domain")
        .when(~_finite(u, v), "numerical_failure")
    )
    return F.struct(
        F.when(code.isNull(), u).alias("u"),
        F.when(code.isNull(), v).alias("v"),
        code.alias("error_code"),
    )


def _normalised(point: Vec) -> tuple[Column, Column]:
    depth = F.when(point.z > 0, point.z)
    return point.x / depth, point.y / depth


def project_radial_tangential(lens: Lens, point: Vec) -> Column:
    """Struct ``u, v, error_code`` of a camera-frame point."""
    x, y = _normalised(point)
    k1, k2, p1, p2 = lens.d0, lens.d1, lens.d2, lens.d3
    r2 = x * x + y * y
    radial = 1.0 + r2 * (k1 + k2 * r2)
    xd = x * radial + 2.0 * p1 * x * y + p2 * (r2 + 2.0 * x * x)
    yd = y * radial + p1 * (r2 + 2.0 * y * y) + 2.0 * p2 * x * y
    return _projection(lens, point, xd, yd)


def project_equidistant(lens: Lens, point: Vec) -> Column:
    """Struct ``u, v, error_code`` of a camera-frame point."""
    x, y = _normalised(point)
    radius = F.hypot(x, y)
    theta = F.atan(radius)
    t2 = theta * theta
    bent = theta * (
        1.0 + t2 * (lens.d0 + t2 * (lens.d1 + t2 * (lens.d2 + t2 * lens.d3)))
    )
    scale = F.when(radius > 0, bent / radius).otherwise(F.lit(1.0))
    return _projection(lens, point, scale * x, scale * y)


_UNDISTORT_TYPE = "x double, y double, z double, error_code string"
# Iteration bound, accepted re-projection error in pixels, and the
# smallest usable derivative.
_MAX_ITERATIONS, _ACCEPT_PX, _SINGULAR = 50, 1e-8, 1e-14


def _bend(model: str, k: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Distorted point and Jacobian entries of the normalised point, per row."""
    if model == "radial_tangential":
        k1, k2, p1, p2 = k
        r2 = x * x + y * y
        radial, slope = 1.0 + r2 * (k1 + k2 * r2), 2.0 * (k1 + 2.0 * k2 * r2)
        xd = x * radial + 2.0 * p1 * x * y + p2 * (r2 + 2.0 * x * x)
        yd = y * radial + p1 * (r2 + 2.0 * y * y) + 2.0 * p2 * x * y
        mixed = slope * x * y + 2.0 * p1 * x + 2.0 * p2 * y
        dxx = radial + slope * x * x + 2.0 * p1 * y + 6.0 * p2 * x
        dyy = radial + slope * y * y + 6.0 * p1 * y + 2.0 * p2 * x
        return xd, yd, dxx, mixed, dyy
    theta, t2 = x, x * x
    bent = theta * (1.0 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    slope = 1.0 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3])))
    return bent, slope


def _solve(model: str, xd: np.ndarray, yd: np.ndarray, k: np.ndarray, scale: np.ndarray):
    """Newton over a whole batch; returns unit-depth rays or angles and error codes."""
    n = len(xd)
    code = np.full(n, "", dtype=object)
    open_rows = np.isfinite(xd) & np.isfinite(yd)
    code[~open_rows] = "non_finite_input"
    polar = model != "radial_tangential"
    radius = np.hypot(xd, yd)
    x = np.minimum(radius, np.pi / 4) if polar else xd.copy()
    y = np.zeros(n) if polar else yd.copy()
    with np.errstate(all="ignore"):
        for _ in range(_MAX_ITERATIONS):
            if not open_rows.any():
                break
            if polar:
                bent, dxx = _bend(model, k, x, y)
                rx, ry = bent - radius, np.zeros(n)
                det, step_x, step_y = dxx, rx / dxx, ry
            else:
                bx, by, dxx, dxy, dyy = _bend(model, k, x, y)
                rx, ry = bx - xd, by - yd
                det = dxx * dyy - dxy * dxy
                step_x, step_y = (dyy * rx - dxy * ry) / det, (dxx * ry - dxy * rx) / det
            open_rows &= ~(np.hypot(rx, ry) * scale <= _ACCEPT_PX)
            for bad, name in (
                (~np.isfinite(det), "numerical_failure"),
                (np.abs(det) <= _SINGULAR, "outside_domain"),
            ):
                hit = open_rows & bad
                code[hit], open_rows = name, open_rows & ~bad
            x, y = np.where(open_rows, x - step_x, x), np.where(open_rows, y - step_y, y)
            diverged = open_rows & ~(np.isfinite(x) & np.isfinite(y))
            code[diverged], open_rows = "numerical_failure", open_rows & ~diverged
            if polar:
                out = open_rows & ((x < 0) | (x >= np.pi / 2))
                code[out], open_rows = "outside_domain", open_rows & ~out
    code[open_rows] = "not_converged"
    if polar:
        unit = np.where(radius > 0, radius, 1.0)
        rays = np.stack([np.sin(x) * xd / unit, np.sin(x) * yd / unit, np.cos(x)])
    else:
        norm = np.sqrt(x * x + y * y + 1.0)
        rays = np.stack([x / norm, y / norm, 1.0 / norm])
    return rays, code


def undistort(lens: Lens, u: Column, v: Column, model: str) -> Column:
    """Unit bearing ``x, y, z`` of a distorted pixel, or an ``error_code``.

    The lens maps have no closed inverse, so Arrow batches go through a vectorised
    Newton iteration; each row is independent of the others.
    """
    if model not in ("radial_tangential", "equidistant"):
        raise ValueError(f"unknown lens model {model!r}")

    def kernel(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pu, pv, fx, fy, cx, cy, *k = [s.to_numpy(dtype=float) for s in batch]
            scale = np.maximum(np.abs(fx), np.abs(fy))
            rays, code = _solve(model, (pu - cx) / fx, (pv - cy) / fy, np.stack(k), scale)
            ok = code == ""
            frame = {n: np.where(ok, r, np.nan) for n, r in zip("xyz", rays, strict=True)}
            frame = {n: pd.Series(r).where(ok) for n, r in frame.items()}
            yield pd.DataFrame({**frame, "error_code": np.where(ok, None, code)})

    kernel.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, ...]],
        "return": Iterator[pd.DataFrame],
    }
    udf = F.pandas_udf(kernel, _UNDISTORT_TYPE)
    return udf(*[c.cast("double") for c in (u, v, *lens)])
