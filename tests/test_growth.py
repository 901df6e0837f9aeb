"""Work that has to grow no faster than its input."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import lines as L
from wayfold.operators import graph, planar
from wayfold.operators import simplify as S
from wayfold.operators.cluster import node_clusters
from wayfold.operators.topology import node_degrees


def test_a_line_is_computed_once_however_its_points_are_read(lines):
    one = lines([[(0, 0), (3, 4), (3, 104)]])
    dense = L.segmentize(F.col("geom"), 0.01)
    out = one.select(F.size(dense).alias("n"), L.length(dense).alias("length"))
    # Each of these expressions names the column once; inside a lambda it would be read again for each of 10,501 points.
    assert out._jdf.queryExecution().analyzed().toString().count("geom#") <= 4
    row = out.first()
    assert row["n"] == 10_501 and abs(row["length"] - 105.0) < 1e-6


def test_lines_without_segments(lines):
    few = lines([[(1, 1)], [(0, 0), (0, 0)]])
    assert [(r["n"], r["l"]) for r in few.orderBy("street_id").select(F.size(L.segments(F.col("geom"))).alias("n"), L.length(F.col("geom")).alias("l")).collect()] == [(0, 0.0), (1, 0.0)]


def test_kernels_are_dealt_to_tasks_by_number(lines):
    """200 clusters of two ends are a few KB; by size they were one task."""
    pairs = lines([[(100 * k, 0), (100 * k, 50)] for k in range(200)] + [[(100 * k + 1, 0), (100 * k + 1, -50)] for k in range(200)])
    out = node_clusters(node_degrees(pairs), 2.0)
    assert out.count() == 200 and out.rdd.getNumPartitions() > 1


def test_artifacts_are_dealt_to_tasks_by_number(spark, lines):
    squares = [[(100 * k, 0), (100 * k + 10, 0), (100 * k + 10, 10), (100 * k, 10), (100 * k, 0)] for k in range(100)]
    streets = lines(squares)
    art = streets.select(F.col("street_id").alias("artifact_id"), F.array("geom").cast(S.RINGS).alias("rings"))
    out = S.around(streets, art)
    assert out.count() == 100 and out.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("changes", [S.single_changes, S.cluster_changes])
def test_a_kernel_that_fails_gives_no_result(lines, changes):
    row = [[(10 * k, y), (10 * k + 10, y)] for y in (0, 10) for k in range(3)] + [[(10 * k, 0), (10 * k, 10)] for k in range(4)]
    streets = lines([*row, [(0, 0), (-50, -20)], [(0, 10), (-50, 30)], [(30, 0), (90, -20)], [(30, 10), (90, 40)]])
    ring = [(0, 0), (30, 0), (30, 10), (0, 10), (0, 0)]
    art = lines([ring]).select(F.col("street_id").alias("artifact_id"), F.array("geom").cast(S.RINGS).alias("rings"))
    if changes is S.single_changes:
        streets = S.with_strokes(lines([ring]))  # a loop at one node
    with pytest.raises(Exception, match="NaN"):
        changes(streets, art, S.R.Options(longest=math.nan)).count()


def test_contained_looks_at_streets_that_may_be(lines):
    """A dead end and a loop within a face, and one that leaves it; the face's own sides, cut or whole, are not contained."""
    ring = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
    sides = [[(0, 0), (100, 0), (100, 100)], [(100, 100), (0, 100)], [(0, 100), (0, 0)]]
    inner = [[(50, 0), (50, 40)], [(60, 60), (70, 60), (70, 70), (60, 60)], [(100, 100), (90, 80)]]
    outer = [[(50, 0), (50, -40)], [(90, 50), (110, 50)], [(-10, -10), (-20, -20)], [(0, 100), (0, 200)]]
    art = lines([ring]).select(F.col("street_id").alias("artifact_id"), F.array("geom").cast(S.RINGS).alias("rings"))
    out = S.contained_streets(lines([*sides, *inner, *outer]), art)
    assert sorted(r["street_id"] for r in out.collect()) == [3, 4, 5]


def test_complete_orbits_are_put_aside(spark, monkeypatch):
    """100 orbits of three and one of 500: what the later rounds write is the long one only."""
    ways = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(100)] + [list(range(1000, 1500))]
    rows = [(h, way[(i + 1) % len(way)]) for way in ways for i, h in enumerate(way)]
    half = spark.createDataFrame(rows, "twin long, right_of long").withColumn("half", F.col("twin"))
    sizes, plain = [], planar.written

    def counted(df, name):
        out = plain(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(planar, "written", counted)
    out = planar.orbits(half).collect()
    assert {r["half"]: r["face"] for r in out} == {h: way[0] for way in ways for h in way} and len(out) == 800
    assert sizes.count(800) <= 6 and 500 in sizes


def written_names(monkeypatch, module):
    names, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or plain(df, name))
    return names


@pytest.mark.parametrize("some", [None, 30])
def test_faces_within_a_task_take_no_rounds(spark, lines, monkeypatch, some):
    """A grid of streets with a hole: its faces and their neighbours, in one task and in parts of 30 half-edges."""
    n = 7
    sides = [[(a, b), (a + 1, b)] for a in range(n) for b in range(n + 1)] + [[(a, b), (a, b + 1)] for a in range(n + 1) for b in range(n)]
    streets = lines([s for s in sides if s != [(3, 3), (4, 3)]] + [[(0, 0), (-3, 0)], [(-3, 0), (-4, 1)]])
    if some:
        monkeypatch.setattr(planar, "TRACED", some)
        monkeypatch.setattr(planar, "ORBIT_ROUNDS", 2)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        names = written_names(monkeypatch, planar)
        labelled = planar.face_edges(streets)
        assert ("orbits" in names) == bool(some)
        f = planar.faces(labelled)
        assert sorted(r["area"] for r in f.collect()) == [1.0] * (n * n - 2) + [2.0]
        rows = {r["half"]: r for r in labelled.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 2 * (2 * n * (n + 1) - 1)
    assert all(rows[r["twin"]]["face"] == r["twin_face"] and rows[r["next"]]["face"] == r["face"] for r in rows.values())
    assert all(min(h for h, r in rows.items() if r["face"] == face) == face for face in {r["face"] for r in rows.values()})
    pairs = {(r["focal"], r["neighbor"]) for r in planar.rook_adjacency(labelled, f).collect()}
    assert len(pairs) == 2 * (2 * n * (n - 1) - 1) and pairs == {(b, a) for a, b in pairs}
    assert sorted(len(r["ring"]) for r in planar.face_rings(labelled).collect()) == [5] * (n * n - 2) + [7]


@pytest.mark.parametrize("some", [None, 20])
def test_near_ids_are_joined_in_a_task(spark, monkeypatch, some):
    """Long chains of near ids, one that leaps, a star and a loop, in one task and in parts of 20 edges."""
    edges = [(k, k + 1) for k in range(300) if k % 100 != 99] + [(5, 250), (1000, 1000)] + [(2000, 2001 + k) for k in range(50)]
    if some:
        monkeypatch.setattr(graph, "JOINED", some)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        names = written_names(monkeypatch, graph)
        out = graph.near_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ("components" in names) == bool(some)
    known = {**{k: 100 if 100 <= k < 200 else 0 for k in range(300)}, **{k: 2000 for k in range(2000, 2051)}}
    assert len(out) == len(known) and {r["node"]: r["component"] for r in out} == known


def test_prune_writes_what_a_round_changes(lines, monkeypatch):
    """A square without dead ends is written once."""
    names = written_names(monkeypatch, planar)
    square = lines([[(0, 0), (1, 0)], [(1, 0), (1, 1)], [(1, 1), (0, 1)], [(0, 1), (0, 0)]])
    assert planar.without_dead_ends(square).count() == 4 and names == ["street-ends", "lone"]
