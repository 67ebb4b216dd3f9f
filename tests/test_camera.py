"""Lens distortion and rolling shutter, against matrices and bisection in NumPy."""

import numpy as np
import pytest

from lanewise import schema
from lanewise.operators import scenes


def turn(w, t):
    """Rotation about w by |w| t."""
    a = np.linalg.norm(w) * t
    if abs(a) < 1e-15:
        return np.eye(3)
    k = np.asarray(w) / np.linalg.norm(w)
    m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(a) * m + (1 - np.cos(a)) * m @ m


def matrix(r, t):
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, t
    return out


def pixel(c, world, dt):
    """u, v, depth, ok of a point of the world, seen ``dt`` after the pose."""
    pose = np.array(c["pose"])
    now = matrix(pose[:3, :3] @ turn(c["w"], dt), pose[:3, 3] + np.array(c["v"]) * dt)
    x, y, z, _ = np.linalg.inv(now @ np.array(c["extrinsic"])) @ np.append(world, 1)
    fu, fv, cu, cv, k1, k2, p1, p2, k3 = c["intrinsic"]
    if x <= 1e-6:
        return None, None, x, False
    a, b = -y / x, -z / x
    r2 = a * a + b * b
    radial = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
    if not 0.8 <= radial <= 1.2:
        far = np.hypot(c["width"], c["height"]) / np.sqrt(r2)
        return a * far + cu, b * far + cv, x, False
    return fu * (a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)) + cu, fv * (b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b) + cv, x, True


def solved(c, world):
    if c["direction"] not in (1, 2, 3, 4):
        return pixel(c, world, 0.0)
    first = c["trigger"] + c["shutter"] / 2 - c["at"]
    readout = c["done"] - c["trigger"] - c["shutter"]

    def late(dt):
        u, v, _, _ = pixel(c, world, dt)
        part = {1: v / c["height"], 2: u / c["width"], 3: 1 - v / c["height"], 4: 1 - u / c["width"]}[c["direction"]]
        return first + readout * min(max(part, 0), 1) - dt

    lo, hi = first - 1e-9, first + readout + 1e-9
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if late(mid) > 0 else (lo, mid)
    return pixel(c, world, (lo + hi) / 2)


def cases(n):
    rng = np.random.default_rng(7)
    for i in range(n):
        pose = matrix(turn(rng.normal(size=3), 1.0), rng.normal(size=3) * 100)
        c = {
            "pose": pose.tolist(), "extrinsic": matrix(turn(rng.normal(size=3) * 0.2, 1.0), [1.5, 0.1, 2.0]).tolist(), "v": (rng.normal(size=3) * [12, 12, 1]).tolist(),
            "w": (rng.normal(size=3) * 0.3 * (i % 7 > 0)).tolist(), "intrinsic": [2000.0, 1900.0, 960.0, 640.0, *(rng.normal(size=5) * [0.05, 0.02, 0.002, 0.002, 0.01]).tolist()],
            "width": 1920, "height": 1280, "direction": [1, 2, 3, 4, 5][i % 5], "at": 100.0, "trigger": 99.97, "shutter": 0.01, "done": 100.03,
        }
        box = [float(x) for x in (rng.uniform(12, 40) * (1 if i % 9 else -1), rng.uniform(-8, 8), rng.uniform(-1, 2), 4, 2, 1.5, rng.uniform(-3, 3))]
        yield c, box


@pytest.fixture(scope="module")
def seen(spark):
    objects, cams = [], []
    for i, (c, box) in enumerate(cases(60)):
        v = dict(zip(("v_x", "v_y", "v_z", "w_x", "w_y", "w_z"), [*c["v"], *c["w"]], strict=True))
        cam = {
            "name": "FRONT", "velocity": v, "intrinsic": c["intrinsic"], "extrinsic": c["extrinsic"], "metadata": {"width": 1920, "height": 1280, "rolling_shutter_direction": c["direction"]},
            "pose": c["pose"], "pose_timestamp": c["at"], "shutter": c["shutter"], "camera_trigger_time": c["trigger"], "camera_readout_done_time": c["done"],
        }
        cams.append((f"s{i}", 1, [cam]))
        objects.append({"id": "o", "scene_id": f"s{i}", "timestamp": 1, "box": dict(zip(("center_x", "center_y", "center_z", "length", "width", "height", "heading"), box, strict=True)), "num_lidar_points_in_box": 20})
    frames = spark.createDataFrame([{"scene_id": s, "timestamp": t, "images": c} for s, t, c in cams], schema.FRAMES)
    table = spark.createDataFrame(objects, schema.OBJECTS)
    return scenes.projected(table, scenes.cameras(frames)), table


def corners(box):
    x, y, z, length, width, height, heading = box
    c, s = np.cos(heading), np.sin(heading)
    return [np.array([x + dx * c - dy * s, y + dx * s + dy * c, z + dz]) for dx in (length / 2, -length / 2) for dy in (width / 2, -width / 2) for dz in (height / 2, -height / 2)]


def test_projection_equals_bisection(seen):
    got = {r.scene_id: r.points for r in seen[0].collect()}
    rolled = 0
    for i, (c, box) in enumerate(cases(60)):
        for p, corner in zip(got[f"s{i}"], corners(box), strict=True):
            world = (np.array(c["pose"]) @ np.append(corner, 1))[:3]
            u, v, depth, ok = solved(c, world) if box[0] > 0 else pixel(c, world, 0.0)
            assert p.ok == ok
            if ok:
                assert abs(p.u - u) < 1e-6 and abs(p.v - v) < 1e-6 and abs(p.depth - depth) < 1e-9
                rolled += abs(u - pixel(c, world, 0.0)[0]) > 1
            elif u is None:
                assert p.u is None
    assert rolled > 50


def test_cameras_without_motion_or_times_are_still(spark, seen):
    cam = {"name": "F", "intrinsic": [2000.0, 2000.0, 960.0, 640.0], "extrinsic": np.eye(4).tolist(), "metadata": {"width": 1920, "height": 1280, "rolling_shutter_direction": 1}}
    frames = spark.createDataFrame([{"scene_id": "s1", "timestamp": 1, "images": [cam]}], schema.FRAMES)
    points = scenes.projected(seen[1], scenes.cameras(frames)).first().points
    x, y, z = corners(list(cases(2))[1][1])[0]
    assert (points[0].u, points[0].v, points[0].ok) == pytest.approx((960 - 2000 * y / x, 640 - 2000 * z / x, x > 0))


def test_best_camera_of_a_projection(seen):
    views = scenes.in_images(*seen)
    rows = {r.scene_id: r for r in views.collect()}
    best = {r.scene_id: r.camera for r in scenes.most_visible(views).collect()}
    assert len(rows) == 60 and best == {s: "FRONT" for s, r in rows.items() if r.visibility > 0} and len(best) > 20
    for r in rows.values():
        w, h = r.bbox[2] - r.bbox[0], r.bbox[3] - r.bbox[1]
        assert r.visibility in (0.0, w * h * 20.0)
