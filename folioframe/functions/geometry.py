"""Rectangles, polygons and angles as Column expressions. A rectangle is a struct of x, y, w, h."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def centre_x(r: Column) -> Column:
    return F.floor(r["x"] + r["w"] / 2)


def overlap_area(a: Column, b: Column) -> Column:
    """Area of the intersection, 0 without one."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    common = overlap_area(a, b).cast("double")
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def page_side(r: Column, width: Column, percent: int = 20) -> Column:
    """left, right, or both where the centre lies within `percent` of the width around the middle."""
    share = (r["x"] + F.floor(r["w"] / 2)) / width
    return F.when(share < (50 - percent / 2) / 100, "left").when(share > (50 + percent / 2) / 100, "right").otherwise("both")


def parse_points(text: Column | str) -> Column:
    """Array of (x, y) from `x,y x,y ...`."""
    pairs = F.transform(F.filter(F.split(text, " "), lambda p: p != ""), lambda p: F.split(p, ","))
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("x"), F.get(p, F.lit(1)).cast("int").alias("y")))


def points_text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")


def bounds(points: Column) -> Column:
    """The rectangle around points; null without any."""

    def around(p):
        sides = F.struct(*[f(F.transform(p, lambda q: q[c])).alias(f"{n}{c}") for n, f in (("l", F.array_min), ("m", F.array_max)) for c in ("x", "y")])
        return F.when(F.size(p) > 0, let(sides, lambda s: rect(s["lx"], s["ly"], s["mx"] - s["lx"], s["my"] - s["ly"])))

    return let(points, around)


def shift(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rotate(points: Column, degrees: float, cx: Column, cy: Column) -> Column:
    """Turned about a centre, as whole pixels."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return F.transform(
        points,
        lambda p: F.struct(
            F.round((p["x"] - cx) * c - (p["y"] - cy) * s + cx).cast("int").alias("x"), F.round((p["x"] - cx) * s + (p["y"] - cy) * c + cy).cast("int").alias("y")
        ),
    )


def project(points: Column, m: list[float]) -> Column:
    """Projective transform by the eight coefficients of a homography (the ninth is 1), as whole pixels."""

    def to(p):
        z = p["x"] * m[6] + p["y"] * m[7] + 1
        return F.struct(((p["x"] * m[0] + p["y"] * m[1] + m[2]) / z).cast("int").alias("x"), ((p["x"] * m[3] + p["y"] * m[4] + m[5]) / z).cast("int").alias("y"))

    return F.transform(points, to)


def let(value: Column, fn) -> Column:
    """fn(value), where value is computed once however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _from_square(c: Column) -> list[Column]:
    """The nine coefficients that take the unit square's corners (around from the origin) to four points."""
    x, y = ([F.get(c, F.lit(i))[k].cast("double") for i in range(4)] for k in ("x", "y"))
    sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    ux, uy, vx, vy = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
    turn = ux * vy - vx * uy
    g, h = F.try_divide(sx * vy - vx * sy, turn), F.try_divide(ux * sy - sx * uy, turn)
    return [x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h, F.lit(1.0)]


def perspective(source: Column, target: Column) -> Column:
    """The nine coefficients, row by row and the last one 1, of the projective map that takes four points to four others, both in order around: through
    the unit square, whose map to four points has a closed form. Null where three points of a side lie on a line or a point is null."""

    def solved(m):
        a, b, c, d, e, f, g, h, i = (m["s"][k] for k in range(9))
        # the adjugate of the source's map undoes it, up to a factor
        back = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
        both = F.array(*[sum((m["t"][3 * r + k] * back[3 * k + j] for k in range(1, 3)), m["t"][3 * r] * back[j]) for r in range(3) for j in range(3)])
        return let(both, lambda n: F.transform(n, lambda v: F.try_divide(v, n[8])))

    whole = let(F.struct(F.array(*_from_square(source)).alias("s"), F.array(*_from_square(target)).alias("t")), solved)
    return let(whole, lambda m: F.when(F.forall(m, lambda v: v.isNotNull()), m))


def clip(v: Column, low: Column | int, high: Column | int) -> Column:
    return F.greatest(F.least(v, high if isinstance(high, Column) else F.lit(high)), low if isinstance(low, Column) else F.lit(low))


def vertical_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees by which the line from the upper to the lower point leaves the vertical."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1)) - 90


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting: whether the number of edges crossed to the right is odd."""
    edges = F.zip_with(points, F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e):
        a, b = e["a"], e["b"]
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1
