"""Boxes, pixels and grids as column expressions. A box is four columns x0, y0, x1, y1; undefined is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x0, y0, x1, y1) -> Column:
    return (x1 - x0) * (y1 - y0)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes, NULL where the union is empty; negative widths must be filtered out beside it."""
    both = (F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * (F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return both / F.nullif(area(*a) + area(*b) - both, F.lit(0.0))


def clipped(value: Column, limit: Column | float) -> Column:
    top = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.greatest(F.lit(0.0), F.least(value, top))


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")]


def to_world(transform: Column, x0, y0, x1, y1) -> list[Column]:
    """A pixel box in world units by an affine struct (a, b, c, d, e, f), corners put in order."""

    def at(x, y):
        return transform["a"] * x + transform["b"] * y + transform["c"], transform["d"] * x + transform["e"] * y + transform["f"]

    (xa, ya), (xb, yb) = at(x0, y0), at(x1, y1)
    return [F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb)]


def decoded(cx, cy, w, h, width, height, padded: bool = False) -> list[Column]:
    """Corners in pixels of a box given by centre and size as shares of the image (of its longer side, if padded)."""
    sx, sy = (F.greatest(width, height),) * 2 if padded else (width, height)
    return [(cx - w / 2) * sx, (cy - h / 2) * sy, (cx + w / 2) * sx, (cy + h / 2) * sy]


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def contains(outer: list[Column], inner: list[Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def block_key(city: Column, x: Column, y: Column, cell: float = 0.01) -> Column:
    return F.concat_ws(":", city, F.floor(x / cell).cast("string"), F.floor(y / cell).cast("string"))


def target_size(pixels: Column, native: Column | float, target: Column) -> Column:
    """Pixels along a side after resampling from `native` to `target` metres per pixel, halves up (fixed values: a half and 1e-9, see kernels.target_pixels)."""
    return F.greatest(F.lit(1).cast("long"), F.floor(pixels * native / target + 0.5 + 1e-9))


def effective_gsd(pixels: Column, native: Column | float, size: Column) -> Column:
    return pixels * native / size


def to_uint8(value: Column, scale: Column) -> Column:
    """Linear scaling to 0 to 255, halves to even; fails where the scale is missing or not positive."""
    sound = F.when(scale > 0, scale).otherwise(F.raise_error(F.lit("scale must be positive")))
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(value * 255.0 / sound))).cast("int")


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed or open ring of points (x, y)."""
    return _cross_sum(ring, lambda p, q: F.lit(1.0)) / 2


def _cross_sum(ring: Column, weight) -> Column:
    n = F.size(ring)
    steps = F.transform(ring, lambda p, i: (p["x"] * _next(ring, i, n)["y"] - _next(ring, i, n)["x"] * p["y"]) * weight(p, _next(ring, i, n)))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def _next(ring: Column, i: Column, n: Column) -> Column:
    return F.get(ring, F.when(i + 1 < n, i + 1).otherwise(F.lit(0)))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    six = F.nullif(ring_area(ring) * 6, F.lit(0.0))
    return _cross_sum(ring, lambda p, q: p["x"] + q["x"]) / six, _cross_sum(ring, lambda p, q: p["y"] + q["y"]) / six


def polygon_centroid(rings: Column) -> tuple[Column, Column]:
    """Area centroid of a polygon: an exterior ring and holes, closed or open, wound either way."""

    def weighted(part):
        own = lambda ring: F.abs(ring_area(ring))
        return F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, own(r) * part(r)).otherwise(-own(r) * part(r))), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))

    whole = F.nullif(weighted(lambda r: F.lit(1.0)), F.lit(0.0))
    return weighted(lambda r: ring_centroid(r)[0]) / whole, weighted(lambda r: ring_centroid(r)[1]) / whole


def centre(transform: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """An image's centre in world units."""
    x, y = width / 2, height / 2
    return transform["a"] * x + transform["b"] * y + transform["c"], transform["d"] * x + transform["e"] * y + transform["f"]


def sound_ring(ring: Column) -> Column:
    """Whether a ring can be a polygon's: three different points or more, an area, no point that is not a number."""
    n = F.size(F.array_distinct(ring))
    numbers = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.coalesce((n >= 3) & numbers & (F.abs(ring_area(ring)) > 0), F.lit(False))
