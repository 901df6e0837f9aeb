"""Spatial joins as equi-joins on grid cells, with the exact predicate after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L

#: Side of a grid cell in map units. A side well above the usual segment keeps copies few; any value gives the same rows.
CELL = 64.0


def cells(x1: Column, y1: Column, x2: Column, y2: Column, reach: float = 0.0, cell: float = CELL) -> Column:
    """The grid cells that a bounding box, grown by reach, covers."""
    low = lambda a, b: F.floor((F.least(a, b) - reach) / cell)
    high = lambda a, b: F.floor((F.greatest(a, b) + reach) / cell)
    return F.flatten(F.transform(F.sequence(low(x1, x2), high(x1, x2)), lambda i: F.transform(F.sequence(low(y1, y2), high(y1, y2)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def walked(segments: DataFrame, x1: str, y1: str, x2: str, y2: str, reach: float = 0.0, cell: float = CELL) -> DataFrame:
    """A row for each grid cell (cx, cy) that a segment, grown by reach, passes: for each column of cells, those between its heights there.

    Columns and heights are exploded one after the other, as generated code; nested lambdas would be interpreted.
    """
    x1, y1, x2, y2 = (F.col(c) for c in (x1, y1, x2, y2))
    left, right, cx = F.least(x1, x2), F.greatest(x1, x2), F.col("cx")
    # Heights at both sides of a column; an upright segment has all of its heights in its column.
    upright = right - left <= 1e-9
    slope = (y2 - y1) / F.when(upright, F.lit(1.0)).otherwise(x2 - x1)
    at = lambda x: F.least(F.greatest(y1 + slope * (x - x1), F.least(y1, y2)), F.greatest(y1, y2))
    a, b = at(cx * cell - reach), at((cx + 1) * cell + reach)
    low, high = F.when(upright, F.least(y1, y2)).otherwise(F.least(a, b)), F.when(upright, F.greatest(y1, y2)).otherwise(F.greatest(a, b))
    wide = reach + 1e-6
    columns = segments.withColumn("cx", F.explode(F.sequence(F.floor((left - reach) / cell), F.floor((right + reach) / cell))))
    return columns.withColumn("cy", F.explode(F.sequence(F.floor((low - wide) / cell), F.floor((high + wide) / cell))))


def segment_table(streets: DataFrame, *keep: str) -> DataFrame:
    """street_id, the kept columns, seq, x1, y1, x2, y2."""
    n = F.greatest(F.size("geom") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("geom", F.lit(1), n).alias("a"), F.slice("geom", F.lit(2), n).alias("b"))
    s = streets.select("street_id", *keep, F.posexplode(pairs).alias("_at", "_s"))
    return s.select("street_id", *keep, (F.col("_at") + 1).alias("seq"), F.col("_s.a.x").alias("x1"), F.col("_s.a.y").alias("y1"), F.col("_s.b.x").alias("x2"), F.col("_s.b.y").alias("y2"))


def points_near_segments(points: DataFrame, segments: DataFrame, reach: float, cell: float = CELL) -> DataFrame:
    """Pairs of points (columns x, y) and segments within reach, each once: all columns of both, the point's cell (cx, cy) and distance.

    A point lies in one cell only, so no pair comes twice and nothing need be made distinct. The pairs are dealt by cell: who
    groups them by point names the cell, too, and needs no shuffle.
    """
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    s = walked(segments, "x1", "y1", "x2", "y2", reach, cell)
    d = L.distance_to_segment(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    return p.join(s, ["cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= reach)


def point_pairs(points: DataFrame, reach: float) -> DataFrame:
    """Pairs of points (id, x, y) within reach: a < b."""
    side = max(reach, 1e-9)
    a = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(cells(F.col("x"), F.col("y"), F.col("x"), F.col("y"), reach, side)).alias("c"))
    b = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).alias("c"))
    near = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")) <= reach * reach
    return a.join(b, "c").filter((F.col("a") < F.col("b")) & near).select("a", "b")


def segment_pairs(left: DataFrame, right: DataFrame, cell: float = CELL, once: bool = True) -> DataFrame:
    """Pairs of segments that pass a common cell, each once, or once for each such cell. Columns of the left end in _l, of the right in _r."""
    names = ("street_id", "seq", "x1", "y1", "x2", "y2")
    named = lambda d, t: walked(d.select(*(F.col(n).alias(n + t) for n in names)), *(n + t for n in names[2:]), 0.0, cell)
    both = named(left, "_l").join(named(right, "_r"), ["cx", "cy"])
    # Boxes that are apart have nothing in common.
    c = F.col
    meet = lambda v: (F.least(c(f"{v}1_l"), c(f"{v}2_l")) <= F.greatest(c(f"{v}1_r"), c(f"{v}2_r"))) & (F.least(c(f"{v}1_r"), c(f"{v}2_r")) <= F.greatest(c(f"{v}1_l"), c(f"{v}2_l")))
    met = both.filter(meet("x") & meet("y")).drop("cx", "cy")
    return met.dropDuplicates(["street_id_l", "seq_l", "street_id_r", "seq_r"]) if once else met
