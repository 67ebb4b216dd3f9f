"""Projection of points by a camera with lens distortion and rolling shutter, as built-in expressions.

Axes: x ahead, y left, z up, for the vehicle and for the camera.  ``extrinsic`` maps camera axes to the vehicle's, ``pose`` the
vehicle's to the world's at ``pose_timestamp``.  The camera's velocity is the vehicle's: v in world axes, w (radians a second) in
vehicle axes.

A rolling shutter reads its lines one after the other, so the time at which a point is seen depends on its pixel, and the pixel on
the time.  That time is a fixed point: a few steps find it, each of two looks at the pixel and one extrapolation (Steffensen's
method), folded over in the JVM.  The vehicle moves on evenly meanwhile, along v and about w.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Directions in which lines are read; others, and null, expose all lines at once.
TOP_DOWN, LEFT_RIGHT, BOTTOM_UP, RIGHT_LEFT = 1, 2, 3, 4
#: Radial distortions that a lens is trusted with; a point beyond is thrown out of the image.
RADIAL = (0.8, 1.2)


def _xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def distorted(intrinsic: Column, width: Column, height: Column, p: Column) -> Column:
    """u, v, depth, ok of a point (struct x, y, z in camera axes).

    intrinsic: f_u, f_v, c_u, c_v, k1, k2, p1, p2, k3; a shorter array has no distortion.  u and v are null for points that aren't
    ahead; for points beyond ``RADIAL`` they lie outside the image, in the point's direction."""
    i = lambda k: F.coalesce(F.get(intrinsic, F.lit(k)), F.lit(0.0))
    ahead = F.when(p["x"] > 1e-6, p["x"])
    plane = F.struct((-p["y"] / ahead).alias("a"), (-p["z"] / ahead).alias("b"), p["x"].alias("depth"))

    def bent(n: Column) -> Column:
        return let(n["a"] * n["a"] + n["b"] * n["b"], lambda r2: let(1 + r2 * (i(4) + r2 * (i(5) + r2 * i(8))), lambda radial: pixel(n, r2, radial)))

    def pixel(n: Column, r2: Column, radial: Column) -> Column:
        a, b = n["a"], n["b"]
        fine = F.coalesce(radial.between(*RADIAL), F.lit(False))
        far = F.sqrt((width * width + height * height) / r2)
        u = F.when(fine, i(0) * (a * radial + 2 * i(6) * a * b + i(7) * (r2 + 2 * a * a))).otherwise(a * far) + i(2)
        v = F.when(fine, i(1) * (b * radial + i(6) * (r2 + 2 * b * b) + 2 * i(7) * a * b)).otherwise(b * far) + i(3)
        return F.struct(u.alias("u"), v.alias("v"), n["depth"].alias("depth"), fine.alias("ok"))

    return let(plane, bent)


def carried(p: Column, v: Column, w: Column, dt: Column) -> Column:
    """A standing point in the axes that the vehicle has ``dt`` later: moved back along v and turned back about w."""

    def turned(d: Column) -> Column:
        def by(r: Column) -> Column:
            angle = r * dt
            # sin(angle) / r and (1 - cos(angle)) / r^2, without their loss of digits for slow turns
            s = F.when(F.abs(angle) > 1e-4, F.sin(angle) / r).otherwise(dt * (1 - angle * angle / 6))
            c = F.when(F.abs(angle) > 1e-4, (1 - F.cos(angle)) / (r * r)).otherwise(dt * dt * (0.5 - angle * angle / 24))
            return let(F.struct(F.cos(angle).alias("cos"), s.alias("s"), (c * _dot(w, d)).alias("along")), rotate)

        def rotate(k: Column) -> Column:
            cross = (w["y"] * d["z"] - w["z"] * d["y"], w["z"] * d["x"] - w["x"] * d["z"], w["x"] * d["y"] - w["y"] * d["x"])
            return _xyz(*[d[a] * k["cos"] - x * k["s"] + w[a] * k["along"] for a, x in zip("xyz", cross, strict=True)])

        return let(F.sqrt(_dot(w, w)), by)

    return let(_xyz(*[p[a] - v[a] * dt for a in "xyz"]), turned)


def in_camera(extrinsic: Column, p: Column) -> Column:
    """A point of the vehicle's axes in the camera's: the shift, then the transposed rotation."""
    d = [p[a] - extrinsic[r][3] for r, a in enumerate("xyz")]
    return _xyz(*[d[0] * extrinsic[0][c] + d[1] * extrinsic[1][c] + d[2] * extrinsic[2][c] for c in range(3)])


def in_vehicle(pose: Column, v: Column) -> Column:
    """A direction of the world's axes in the vehicle's."""
    return _xyz(*[v["x"] * pose[0][c] + v["y"] * pose[1][c] + v["z"] * pose[2][c] for c in range(3)])


def rolling_shutter(
    p: Column, v: Column, w: Column, extrinsic: Column, intrinsic: Column, width: Column, height: Column, direction: Column, first: Column, readout: Column, steps: int = 4
) -> Column:
    """u, v, depth, ok of a point (struct x, y, z in the vehicle's axes at the time of its pose).

    v, w: the vehicle's motion in its own axes.  first: seconds from the pose to the exposure of the first line; readout: seconds
    from the first line to the last.  Points that aren't ahead at some step keep the time they had."""

    def seen(dt: Column) -> Column:
        return let(carried(p, v, w, dt), lambda q: let(in_camera(extrinsic, q), lambda c: distorted(intrinsic, width, height, c)))

    def read(dt: Column) -> Column:
        def when(uv: Column) -> Column:
            part = F.when(direction == TOP_DOWN, uv["v"] / height).when(direction == LEFT_RIGHT, uv["u"] / width)
            part = part.when(direction == BOTTOM_UP, 1 - uv["v"] / height).when(direction == RIGHT_LEFT, 1 - uv["u"] / width)
            line = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
            return F.coalesce(F.when(part.isNotNull(), first + line * readout), dt)

        return let(seen(dt), when)

    def step(dt: Column, _: Column) -> Column:
        return let(read(dt), lambda a: let(read(a), lambda b: F.coalesce(b - F.try_divide((b - a) * (b - a), b - 2 * a + dt), b)))

    rolls = F.coalesce(direction.between(TOP_DOWN, RIGHT_LEFT) & (first + readout).isNotNull(), F.lit(False))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first + readout / 2, step)
    return let(F.when(rolls, found).otherwise(F.lit(0.0)), seen)
