"""Column functions of boxes, poses and cameras.  All are built-in expressions on doubles; none needs Python in a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BANDS, DISPLAY, MOVING_ABOVE
from .text import let


def centre_box(synced: Column, box: Column) -> Column:
    """The camera-synced box if there is one, else the box: whole boxes, never fields of both."""
    return F.when(synced.isNotNull(), synced).otherwise(box)


def transform_point(pose: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """pose . [x, y, z, 1] of a 4x4 matrix held as an array of rows."""
    return [pose[r][0] * x + pose[r][1] * y + pose[r][2] * z + pose[r][3] for r in range(3)]


def rotate_to_camera(extrinsic: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """[x, y, z, 1] as a row vector times the matrix: the transposed rotation, without the translation."""
    return [x * extrinsic[0][c] + y * extrinsic[1][c] + z * extrinsic[2][c] + extrinsic[3][c] for c in range(3)]


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def speed(sx: Column, sy: Column) -> Column:
    """Speed in the plane; 0 where either part is missing."""
    return F.coalesce(norm(sx, sy), F.lit(0.0))


def vector(*parts: Column) -> list[Column]:
    """Parts with zeros for what is missing."""
    return [F.coalesce(p, F.lit(0.0)) for p in parts]


def by_type(table: dict[str, object], kind: Column, other: object = None) -> Column:
    out = None
    for t, v in table.items():
        out = F.when(kind == t, F.lit(v)) if out is None else out.when(kind == t, F.lit(v))
    return out.otherwise(F.lit(other))


def is_moving(kind: Column, v: Column) -> Column:
    """Faster than the type's threshold; types without one, and null, never move."""
    return F.coalesce(v > by_type(MOVING_ABOVE, kind), F.lit(False))


def speed_band(kind: Column, v: Column, last: bool = False) -> Column:
    """The first (or last) band of the type with lo <= v <= hi; 'stationary' if there is none."""
    out = F.lit("stationary")
    for t, each in BANDS.items():
        inner = F.lit("stationary")
        for name, lo, hi in each if last else reversed(each):
            inner = F.when((v >= lo) & (v <= hi), F.lit(name)).otherwise(inner)
        out = F.when(kind == t, inner).otherwise(out)
    return out


def display_type(kind: Column) -> Column:
    return by_type(DISPLAY, kind)


def description(color: Column, label: Column, kind: Column) -> Column:
    """'red sedan', 'sedan', the display type, or 'object'."""
    named = F.when(label.isNotNull() & color.isNotNull(), F.concat(color, F.lit(" "), F.lower(label))).when(label.isNotNull(), F.lower(label))
    return named.otherwise(F.coalesce(display_type(kind), F.lit("object")))


def sector(x: Column, y: Column) -> Column:
    """front, left, right or behind by the angle atan2(x, y) in degrees, rounded to 1e-9 before the bounds are applied."""
    a = F.round(F.degrees(F.atan2(x, y)), 9)
    return F.when(a.between(-45, 45), "front").when((a > 45) & (a <= 135), "left").when((a >= -135) & (a < -45), "right").otherwise("behind")


def heading_vector(heading: Column, length: Column) -> list[Column]:
    return [F.cos(heading) * length / 2, F.sin(heading) * length / 2, F.lit(0.0)]


def facing(x: Column, y: Column) -> Column:
    """Side of the longer axis of a vector in camera axes; a tie goes to x, a zero vector is 'towards'."""
    return F.when(F.abs(x) >= F.abs(y), F.when(x > 0, "away").otherwise("towards")).otherwise(F.when(y > 0, "left").otherwise("right"))


def movement(moving: Column, x: Column, y: Column) -> Column:
    return F.when(moving, facing(x, y)).otherwise("not moving")


def pinhole(fx: Column, fy: Column, cx: Column, cy: Column, x: Column, y: Column, z: Column) -> Column:
    """u, v, depth, ok of a point in camera axes (x ahead, y left, z up) without distortion or rolling shutter."""
    ahead = F.when(x > 1e-6, x)
    return F.struct((cx - fx * y / ahead).alias("u"), (cy - fy * z / ahead).alias("v"), x.alias("depth"), (x > 1e-6).alias("ok"))


def corners(cx: Column, cy: Column, cz: Column, length: Column, width: Column, height: Column, heading: Column) -> Column:
    """The 8 corners of a box, as an array of x, y, z."""
    out = []
    for i in (1, -1):
        for j in (1, -1):
            for k in (1, -1):
                dx, dy = length * (i / 2), width * (j / 2)
                out.append(F.struct((cx + dx * F.cos(heading) - dy * F.sin(heading)).alias("x"), (cy + dx * F.sin(heading) + dy * F.cos(heading)).alias("y"), (cz + height * (k / 2)).alias("z")))
    return F.array(*out)


def bbox(points: Column, width: Column, height: Column) -> Column:
    """[x1, y1, x2, y2] of the projected corners (array of u, v, depth, ok) that are ok and in front: whole pixels towards
    zero, clamped to the image; zeros if fewer than 3 are."""
    good = F.filter(points, lambda p: p["ok"] & (p["depth"] > 0))
    side = lambda f, axis, most: F.greatest(F.lit(0), F.least(f(F.transform(good, lambda p: p[axis])).cast("int"), most.cast("int")))
    whole = F.array(side(F.array_min, "u", width), side(F.array_min, "v", height), side(F.array_max, "u", width), side(F.array_max, "v", height))
    return F.when(F.size(good) < 3, F.array(*[F.lit(0)] * 4)).otherwise(whole)


def visible(points: Column, width: Column, height: Column) -> Column:
    """All corners ok, in front and inside the image."""
    return F.forall(points, lambda p: p["ok"] & (p["depth"] > 0) & p["u"].between(F.lit(0), width) & p["v"].between(F.lit(0), height))


def visibility(n_ok: Column, any_behind: Column, w: Column, h: Column, lidar: Column) -> Column:
    """Area times LiDAR points; 0 with fewer than 6 good corners, one behind the camera, a side below 32 or fewer than 5 points."""
    return F.when((n_ok < 6) | any_behind | (w < 32) | (h < 32) | (lidar < 5), F.lit(0.0)).otherwise((w * h * lidar).cast("double"))


def thirds(u: Column, v: Column, width: Column, height: Column) -> Column:
    """top-left ... bottom-right by thirds of the image."""
    row = F.when(v < height / 3, "top").when(v < 2 * height / 3, "middle").otherwise("bottom")
    column = F.when(u < width / 3, "left").when(u < 2 * width / 3, "center").otherwise("right")
    return F.concat(row, F.lit("-"), column)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2); 0 for two empty ones."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def rescale(x: Column, padded: Column, width: Column) -> Column:
    """A coordinate of 0 to 1 on a square padded image, in pixels of the original, clipped."""
    return F.greatest(F.lit(0.0), F.least(x * padded, width))


def box_from_centre(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def inverse(matrix: Column, least: float = 1e-12) -> Column:
    """The inverse of a square matrix held as an array of rows; null for a null, ragged or singular one (no pivot above ``least`` times
    the largest element).

    Gauss and Jordan with the largest pivot of each column, folded over the columns in the JVM."""
    size = F.size(matrix)
    ok = (size > 0) & F.forall(matrix, lambda r: (F.size(r) == size) & F.forall(r, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    largest = F.array_max(F.transform(matrix, lambda r: F.array_max(F.transform(r, lambda x: F.abs(x)))))
    one = lambda i: F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))
    wide = F.transform(matrix, lambda r, i: F.concat(F.transform(r, lambda x: x.cast("double")), one(i)))

    def step(rows: Column, c: Column) -> Column:
        """Column c becomes that of the unit matrix."""
        # the row from c on with the largest element there, the first of equal ones; it is negated to sort first
        best = F.array_min(F.transform(F.sequence(c, size - 1), lambda i: F.struct((-F.abs(rows[i][c])).alias("less"), i.alias("i"))))
        return let(best, lambda b: F.when(-b["less"] > least * largest, cleared(rows, c, b["i"])))

    def cleared(rows: Column, c: Column, at: Column) -> Column:
        pivot = F.transform(rows[at], lambda x: x / rows[at][c])
        swapped = F.transform(rows, lambda r, i: F.when(i == at, rows[c]).otherwise(r))
        return let(pivot, lambda p: F.transform(swapped, lambda r, i: F.when(i == c, p).otherwise(F.zip_with(r, p, lambda x, y: x - y * r[c]))))

    done = F.aggregate(F.sequence(F.lit(0), size - 1), wide, step)
    return F.when(ok, F.transform(done, lambda r: F.slice(r, size + 1, size)))


def product(a: Column, b: Column) -> Column:
    """The product of two matrices held as arrays of rows."""
    columns = F.sequence(F.lit(0), F.size(b[0]) - 1)
    return F.transform(a, lambda r: F.transform(columns, lambda j: F.aggregate(F.zip_with(r, b, lambda x, row: x * row[j]), F.lit(0.0), lambda s, v: s + v)))
