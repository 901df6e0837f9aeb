"""Nodes, degrees and repair of street topology.

A street table has street_id (long, unique), geom (array of points) and any other columns. Streets with a null geometry or
fewer than two points are dropped by fix_topology and give nothing elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..plans.storage import is_written, written
from .graph import near_components
from .spatial import points_near_segments, segment_table

#: Search distance for nodes on streets.
EPS = 1e-4


def line_ends(streets: DataFrame, *keep: str) -> DataFrame:
    """Two rows per street: street_id, the kept columns, end (0 first, 1 last), x, y."""
    ends = F.array(F.struct(F.lit(0).alias("end"), L.first_point(F.col("geom")).alias("p")), F.struct(F.lit(1).alias("end"), L.last_point(F.col("geom")).alias("p")))
    return streets.select("street_id", *keep, F.explode(ends).alias("e")).select("street_id", *keep, "e.end", "e.p.x", "e.p.y")


def node_degrees(streets: DataFrame) -> DataFrame:
    """x, y, degree: street ends at each distinct coordinate; a loop counts twice."""
    return line_ends(streets).groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))


def dedupe(streets: DataFrame) -> DataFrame:
    """Streets without repetitions, direction and ring start aside; the least street_id stays."""
    first = streets.select("street_id", L.canonical(F.col("geom")).alias("g")).groupBy("g").agg(F.min("street_id").alias("street_id"))
    return streets.join(first.select("street_id"), "street_id", "left_semi")


def split_loops(streets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings (closed lines), and the other streets."""
    closed = L.is_closed(F.col("geom"))
    return streets.filter(closed), streets.filter(~closed)


def degree_mismatch(streets: DataFrame, reach: float = EPS) -> DataFrame:
    """Nodes whose degree isn't the number of streets within reach: x, y, degree, n_streets."""
    nodes = node_degrees(streets)
    near = points_near_segments(nodes, segment_table(streets), reach).groupBy("cx", "cy", "x", "y", "degree").agg(F.countDistinct("street_id").alias("n_streets"))
    return near.filter("degree <> n_streets").drop("cx", "cy")


def loop_contacts(streets: DataFrame, reach: float = EPS) -> tuple[DataFrame, DataFrame]:
    """Vertices of loops (a) near a street that is no loop, (b) near more than one loop: street_id of the loop, x, y."""
    loops, others = split_loops(streets)
    vertices = loops.select(F.col("street_id").alias("loop_id"), F.explode(F.array_distinct("geom")).alias("p")).select("loop_id", "p.x", "p.y")
    off = points_near_segments(vertices, segment_table(others), reach).select("loop_id", "x", "y").distinct()
    on = points_near_segments(vertices, segment_table(loops), reach).groupBy("loop_id", "x", "y").agg(F.countDistinct("street_id").alias("n")).filter("n > 1").drop("n")
    return off, on


def induce_points(streets: DataFrame, reach: float = EPS) -> DataFrame:
    """Distinct coordinates where a node is missing: x, y.

    Those of degree_mismatch and of both kinds of loop_contacts, from one join: nodes and vertices of loops meet all
    streets once, and per place the streets and the loops among them are counted.
    """
    closed = L.is_closed(F.col("geom"))
    vertices = streets.filter(closed).select(F.explode(F.array_distinct("geom")).alias("p")).select("p.x", "p.y")
    places = line_ends(streets).select("x", "y", F.lit(1).alias("end")).unionByName(vertices.withColumn("end", F.lit(0)))
    places = places.groupBy("x", "y").agg(F.sum("end").alias("degree"), F.bool_or(F.col("end") == 0).alias("vertex"))
    near = points_near_segments(places, segment_table(streets.withColumn("loop", closed), "loop"), reach)
    at = ("cx", "cy", "x", "y", "degree", "vertex")
    each = near.groupBy(*at, "street_id").agg(F.first("loop").alias("loop"))
    seen = each.groupBy(*at).agg(F.count(F.lit(1)).alias("n_streets"), F.sum(F.col("loop").cast("long")).alias("n_loops"))
    wrong = (F.col("degree") > 0) & (F.col("degree") != F.col("n_streets"))
    touched = F.col("vertex") & ((F.col("n_loops") < F.col("n_streets")) | (F.col("n_loops") > 1))
    return seen.filter(wrong | touched).select("x", "y")


def split(streets: DataFrame, points: DataFrame, eps: float = EPS) -> DataFrame:
    """Streets cut at every point (x, y) within eps, all at once: columns of streets, piece (0 from the start on), _status.

    A cut takes the point's own coordinates; a point at an end cuts nothing. Pieces of a cut street are 'changed'; other
    streets keep their status. All other columns are copied to each piece.
    """
    status = F.col("_status") if "_status" in streets.columns else F.lit(None).cast("string")
    base = streets.withColumn("_status", status)
    hit = points_near_segments(points.select("x", "y").distinct(), segment_table(streets), eps)
    # Of the segments near a point, the nearest and then the first takes the cut.
    t = L.project(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    best = hit.groupBy("cx", "cy", "street_id", "x", "y").agg(F.min(F.struct("distance", "seq", t.alias("t"), "x1", "y1", "x2", "y2")).alias("b"))
    at_start, at_end = (F.hypot(F.col("x") - F.col(f"b.x{k}"), F.col("y") - F.col(f"b.y{k}")) <= eps for k in (1, 2))
    place = F.col("b.seq") - 1 + F.when(at_start, 0.0).when(at_end, 1.0).otherwise(F.col("b.t"))
    cuts = best.groupBy("street_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.struct("x", "y").alias("p")))).alias("cuts"))
    joined = base.join(cuts, "street_id", "left")
    # Most streets are not cut; for them nothing below is computed.
    whole = F.col("cuts").isNull() & (F.size("geom") > 1)
    n = F.size("geom") - 1
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<struct<at:double,p:struct<x:double,y:double>>>")), lambda c: (c["at"] > 0) & (c["at"] < n))
    joined = joined.withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumn("cuts", F.when(~F.coalesce(whole, F.lit(False)), F.filter(inner, lambda c, i: (i == 0) | (c["at"] != F.get(inner, i - 1)["at"]))))
    bounds = F.concat(F.array(F.struct(F.lit(0.0).alias("at"), L.first_point(F.col("geom")).alias("p"))), F.col("cuts"), F.array(F.struct(n.cast("double").alias("at"), L.last_point(F.col("geom")).alias("p"))))
    joined = joined.withColumn("_bounds", F.when(~F.col("_whole"), bounds))
    between = lambda a, z: F.transform(F.filter(F.sequence(F.lit(0), F.size("geom") - 1), lambda i: (i > a["at"]) & (i < z["at"])), lambda i: F.get(F.col("geom"), i))
    pieces = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda k: F.concat(F.array(F.get(F.col("_bounds"), k)["p"]), between(F.get(F.col("_bounds"), k), F.get(F.col("_bounds"), k + 1)), F.array(F.get(F.col("_bounds"), k + 1)["p"])))
    changed = F.when(F.size("cuts") > 0, F.lit("changed")).otherwise(F.col("_status"))
    out = joined.select(*[F.col(c) for c in base.columns if c not in ("geom", "_status")], changed.alias("_status"), F.posexplode(F.when(F.col("_whole"), F.array("geom")).otherwise(pieces)).alias("piece", "geom"))
    return out.select(*base.columns, "piece")


def induce_nodes(streets: DataFrame, eps: float = EPS, more: DataFrame | None = None) -> DataFrame:
    """Streets cut wherever a node is missing, and at more places (x, y); the search distance is EPS, eps is that of the cut. Adds _status, piece."""
    streets = streets if is_written(streets) else written(streets, "streets")
    points = induce_points(streets) if more is None else induce_points(streets).unionByName(more.select("x", "y"))
    return split(streets, written(points, "induced-points"), eps)


def status_of(statuses: Column, n: Column) -> Column:
    """The status of a merged group: all new is new, a single street keeps its own, all else is changed."""
    all_new = F.bool_and(F.coalesce(statuses == "new", F.lit(False)))
    return F.when(all_new, "new").when(n == 1, F.first(statuses)).otherwise("changed")


def bowtie_nodes(streets: DataFrame) -> DataFrame:
    """Nodes of components that are exactly two nodes, two loops and a doubled edge: x, y. They are not merged away."""
    a, b = L.first_point(F.col("geom")), L.last_point(F.col("geom"))
    point = "struct<x:double,y:double>"
    side = lambda p, other: F.struct(p.alias("p"), other.alias("other"))
    # A ring is one row without another end. Two nodes that have only each other as neighbours are a component.
    sides = F.when(a == b, F.array(side(a, F.lit(None).cast(point)))).otherwise(F.array(side(a.cast(point), b.cast(point)), side(b.cast(point), a.cast(point))))
    nodes = streets.select(F.explode(sides).alias("s")).groupBy(F.col("s.p").alias("p")).agg(F.min("s.other").alias("only"), F.max("s.other").alias("last"), F.sum(F.col("s.other").isNull().cast("long")).alias("n_loops"))
    lone = nodes.filter((F.col("only") == F.col("last")) & (F.col("n_loops") == 1)).select("p", "only")
    return lone.join(lone.select(F.col("only").alias("p"), F.col("p").alias("only")), ["p", "only"], "left_semi").select("p.x", "p.y")


def chain_links(streets: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """Pairs of street ids that meet at a node of exactly two ends of non-loops: src, dst."""
    _, others = split_loops(streets)
    joints = line_ends(streets.withColumn("loop", L.is_closed(F.col("geom"))), "loop").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.bool_or("loop").alias("loop"), F.min("street_id").alias("src"), F.max("street_id").alias("dst")).filter("n = 2 and not loop and src <> dst")
    for skip in (ignore, bowtie_nodes(streets)):
        if skip is not None:
            joints = joints.join(skip.select("x", "y"), ["x", "y"], "left_anti")
    return joints.select("src", "dst")


def chain_labels(streets: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """street_id, label: the least street_id of the chain through nodes of degree two."""
    parts = near_components(chain_links(streets, ignore))
    return streets.select("street_id").join(parts.withColumnRenamed("node", "street_id"), "street_id", "left").select("street_id", F.coalesce("component", "street_id").alias("label"))


def _merge(lines: list[list[tuple]]) -> list[tuple]:
    """One chain of lines, in the order of their ids, as one line; direction and start are those of the first where that is possible."""
    at: dict = {}
    for k, g in enumerate(lines):
        at.setdefault(g[0], []).append(k)
        at.setdefault(g[-1], []).append(k)
    left = set(range(1, len(lines)))
    out = list(lines[0])
    for _ in range(2):
        while left:
            nxt = next((k for k in at[out[-1]] if k in left), None)
            if nxt is None:
                break
            left.discard(nxt)
            g = lines[nxt]
            out += (g if g[0] == out[-1] else g[::-1])[1:]
        out.reverse()
    return out


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of label and lines (street_id, geom, in order), many chains at a time, as label and geom."""
    for batch in batches:
        merged = [_merge([[(p["x"], p["y"]) for p in line["geom"]] for line in lines.as_py()]) for lines in batch.column("lines")]
        geom = pa.array([[{"x": x, "y": y} for x, y in g] for g in merged], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        yield pa.RecordBatch.from_arrays([batch.column("label"), geom], names=["label", "geom"])


def _by_rule(name: str, rule: str | Callable[[Column, Column], Column], seq: Column) -> Column:
    """An attribute of a merged group: first or last (non-null, by street_id), a built-in aggregate's name, or an expression."""
    col = F.col(name)
    if callable(rule):
        return rule(col, seq).alias(name)
    if rule in ("first", "last"):
        pick = F.min_by if rule == "first" else F.max_by
        return pick(col, F.when(col.isNotNull(), seq)).alias(name)
    return getattr(F, rule)(col).alias(name)


def remove_interstitial_nodes(streets: DataFrame, aggfunc: str | dict = "first", ignore: DataFrame | None = None) -> DataFrame:
    """Chains through nodes of degree two merged into one street each: street_id (the least), _status, geom, attributes.

    Chains of one street pass through natively; only real chains are merged in Python, a batch of them at a time. Rings
    start at the vertex that most other streets touch.
    """
    streets = streets if "_status" in streets.columns else streets.withColumn("_status", F.lit("original"))
    labelled = streets.join(chain_labels(streets, ignore), "street_id")
    others = [c for c in streets.columns if c not in ("street_id", "geom", "_status", "piece")]
    rule = lambda c: aggfunc.get(c, "first") if isinstance(aggfunc, dict) else aggfunc
    n = F.count(F.lit(1))
    attrs = labelled.groupBy("label").agg(n.alias("n_merged"), status_of(F.col("_status"), n).alias("_status"), *(_by_rule(c, rule(c), F.col("street_id")) for c in others), F.first("geom").alias("one"))
    many = attrs.filter("n_merged > 1").select("label")
    lines = F.array_sort(F.collect_list(F.struct("street_id", "geom"))).alias("lines")
    merged = labelled.join(many, "label", "left_semi").groupBy("label").agg(lines).mapInArrow(_merge_batches, f"label long, geom {L.LINE}")
    out = attrs.join(merged, "label", "left").select(F.col("label").alias("street_id"), *others, "_status", F.coalesce("geom", "one").alias("geom"))
    return rotate_loops(out)


def rotate_loops(streets: DataFrame, reach: float = EPS) -> DataFrame:
    """Rings start at their vertex with the most contacts with streets that are no loops; the least (x, y) of equals."""
    streets = written(streets, "merged")
    loops, others = split_loops(streets)
    vertices = loops.select(F.col("street_id").alias("loop_id"), F.explode(F.array_distinct("geom")).alias("p")).select("loop_id", "p.x", "p.y")
    contact = points_near_segments(vertices, segment_table(others), reach).groupBy("loop_id", "x", "y").agg(F.countDistinct("street_id").alias("n"))
    best = contact.groupBy("loop_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "x", "y")).alias("b")).select(F.col("loop_id").alias("street_id"), F.struct("b.x", "b.y").alias("start"))
    ring = F.slice("geom", 1, F.size("geom") - 1)
    at = F.array_position(ring, F.col("start")).cast("int")
    turned = F.when(F.col("start").isNull() | (at < 1), F.col("geom")).otherwise(F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at)))
    rest = [c for c in streets.columns if c != "geom"]
    return streets.join(best, "street_id", "left").select(*rest, turned.alias("geom"))


def fix_topology(streets: DataFrame, eps: float = EPS, aggfunc: str | dict = "first") -> DataFrame:
    """Repetitions dropped, missing nodes induced, nodes of degree two removed. Street ids are numbered anew."""
    whole = streets.filter(F.col("geom").isNotNull() & (F.size("geom") > 1))
    cut = induce_nodes(dedupe(whole), eps)
    return remove_interstitial_nodes(written(renumber(cut), "induced"), aggfunc)


def renumber(pieces: DataFrame) -> DataFrame:
    """Pieces with ids of their own, in the order of street and piece."""
    return compact(pieces, "street_id", "piece").drop("piece")


def compact(streets: DataFrame, *by: str, name: str = "street_id", start: int = 0) -> DataFrame:
    """The same rows numbered from start on in the order of some columns: ranges are numbered apart, and their sizes added up."""
    by = by or ("street_id",)
    placed = written(streets.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "placed")
    part, bases = F.shiftright("_m", 33), []
    for row in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        bases.append((row["p"], start))
        start += row["n"]
    # A row per partition of the table above.
    base = placed.sparkSession.createDataFrame(bases, "_p long, _base long")
    out = placed.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn("_n", F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1))
    return out.select(*[c for c in streets.columns if c != name], F.col("_n").alias(name)).select(*dict.fromkeys([*streets.columns, name]))
