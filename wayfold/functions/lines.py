"""Column functions over points (struct x, y) and lines (array of points). All run inside the JVM's generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line(*points: Column) -> Column:
    return F.array(*points).cast(LINE)


def first_point(geom: Column) -> Column:
    return F.get(geom, F.lit(0))


def last_point(geom: Column) -> Column:
    return F.element_at(geom, -1)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. A lambda that named the value's expression would compute it for each of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(geom: Column) -> Column:
    """Array of (seq, x1, y1, x2, y2)."""
    return bound(geom, lambda line: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))), lambda i: i < F.size(line)),
        lambda i: F.struct(i.alias("seq"), line[i - 1]["x"].alias("x1"), line[i - 1]["y"].alias("y1"), line[i]["x"].alias("x2"), line[i]["y"].alias("y2")),
    ))


def length(geom: Column) -> Column:
    """Sum of segment lengths; 0 for a line of fewer than two points, null for null."""
    return F.aggregate(segments(geom), F.lit(0.0), lambda s, g: s + F.sqrt((g["x2"] - g["x1"]) * (g["x2"] - g["x1"]) + (g["y2"] - g["y1"]) * (g["y2"] - g["y1"])))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring: positive if it runs counter-clockwise."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, g: s + (g["x1"] * g["y2"] - g["x2"] * g["y1"])) / 2


def is_closed(geom: Column) -> Column:
    return (F.size(geom) > 2) & (first_point(geom) == last_point(geom))


def canonical(geom: Column) -> Column:
    """One form for both directions of a line; a ring also starts at its least point."""
    ring = F.slice(geom, 1, F.greatest(F.size(geom) - 1, F.lit(1)))
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    turned = F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at))
    base = F.when(is_closed(geom), turned).otherwise(geom)
    return F.least(F.struct(base.alias("g")), F.struct(F.reverse(base).alias("g")))["g"]


def angle(a: Column, shared: Column, b: Column) -> Column:
    """Angle in degrees at the shared point; the cosine is rounded to six digits; 0 where a side has no length."""
    ax, ay, bx, by = a["x"] - shared["x"], a["y"] - shared["y"], b["x"] - shared["x"], b["y"] - shared["y"]
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.round((ax * bx + ay * by) / norm, 6)
    return F.when(norm > 0, F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))).otherwise(0.0)


def angle_between_lines(p: Column, q: Column) -> Column:
    """Angle of two two-point lines at the vertex that they share; 0 if they share none or both."""
    p0, p1, q0, q1 = first_point(p), last_point(p), first_point(q), last_point(q)
    same = ((p0 == q0) & (p1 == q1)) | ((p0 == q1) & (p1 == q0))
    return F.when(same, 0.0).when(p0 == q0, angle(p1, p0, q1)).when(p0 == q1, angle(p1, p0, q0)).when(p1 == q0, angle(p0, p1, q1)).when(p1 == q1, angle(p0, p1, q0)).otherwise(0.0)


def interpolate(geom: Column, share: float) -> Column:
    """The point at this share (0 to 1) of the length."""
    goal = length(geom) * F.lit(float(share))
    start = F.struct(F.lit(0.0).alias("done"), first_point(geom).alias("p"))

    def step(s: Column, g: Column) -> Column:
        size = F.sqrt((g["x2"] - g["x1"]) * (g["x2"] - g["x1"]) + (g["y2"] - g["y1"]) * (g["y2"] - g["y1"]))
        t = F.least(F.greatest((goal - s["done"]) / F.nullif(size, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        here = F.struct((g["x1"] + F.coalesce(t, F.lit(0.0)) * (g["x2"] - g["x1"])).alias("x"), (g["y1"] + F.coalesce(t, F.lit(0.0)) * (g["y2"] - g["y1"])).alias("y"))
        return F.struct((s["done"] + size).alias("done"), F.when(s["done"] < goal, here).otherwise(s["p"]).alias("p"))

    return F.aggregate(segments(geom), start, step)["p"]


def segmentize(geom: Column, longest: float) -> Column:
    """The line with extra points, so that no segment is longer than `longest`."""

    def cut(g: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt((g["x2"] - g["x1"]) * (g["x2"] - g["x1"]) + (g["y2"] - g["y1"]) * (g["y2"] - g["y1"])) / longest), F.lit(1))
        at = lambda k, n: F.struct((g["x1"] + (g["x2"] - g["x1"]) * k / n).alias("x"), (g["y1"] + (g["y2"] - g["y1"]) * k / n).alias("y"))
        return bound(n, lambda n: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: at(k, n)))

    return bound(geom, lambda line: F.concat(F.flatten(F.transform(segments(line), cut)), F.array(last_point(line))))


def project(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on a segment (0 to 1) the nearest place to a point lies."""
    dx, dy = x2 - x1, y2 - y1
    return F.least(F.greatest(F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def distance_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = project(px, py, x1, y1, x2, y2)
    qx, qy = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
    return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))
