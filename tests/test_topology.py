from __future__ import annotations

import pytest
from conftest import coords

from wayfold.operators import topology as T

D = lambda *ks: [(k, k) for k in ks]


@pytest.mark.parametrize(
    ("streets", "points", "expected"),
    [
        ([D(1, 2)], [2], [(D(1, 2), None)]),
        ([D(1, 4)], [2], [(D(1, 2), "changed"), (D(2, 4), "changed")]),
        ([D(1, 4)], [2, 3], [(D(1, 2), "changed"), (D(2, 3), "changed"), (D(3, 4), "changed")]),
        ([D(1, 4), D(6, 9)], [2], [(D(1, 2), "changed"), (D(2, 4), "changed"), (D(6, 9), None)]),
        ([D(1, 4), D(6, 9)], [2, 8], [(D(1, 2), "changed"), (D(2, 4), "changed"), (D(6, 8), "changed"), (D(8, 9), "changed")]),
        ([D(1, 4), [(2, 4), (4, 2)]], [3], [(D(1, 3), "changed"), (D(3, 4), "changed"), ([(2, 4), (3, 3)], "changed"), ([(3, 3), (4, 2)], "changed")]),
        ([D(1, 2, 4)], [2], [(D(1, 2), "changed"), (D(2, 4), "changed")]),
    ],
)
def test_split(spark, lines, streets, points, expected):
    out = T.split(lines(streets), spark.createDataFrame([(float(p), float(p)) for p in points], "x double, y double")).orderBy("street_id", "piece").collect()
    assert list(zip(coords(out), [r["_status"] for r in out], strict=True)) == [([(float(x), float(y)) for x, y in g], s) for g, s in expected]


def test_split_copies_attributes(spark, lines):
    out = T.split(lines([D(1, 4)], a=[5], b=["W"], c=[["i", "o"]]), spark.createDataFrame([(2.0, 2.0)], "x double, y double")).collect()
    assert [(r["a"], r["b"], r["c"]) for r in out] == [(5, "W", ["i", "o"])] * 2


@pytest.mark.parametrize(
    ("streets", "ignore", "groups"),
    [
        ([D(1, 2), D(2, 4)], None, [{0, 1}]),
        ([D(1, 2), D(2, 4)], 2, [{0}, {1}]),
        ([D(1, 2), D(3, 4)], None, [{0}, {1}]),
        ([D(1, 2), D(2, 4), D(4, 5)], None, [{0, 1, 2}]),
        ([D(1, 2), D(2, 4), D(4, 5)], 2, [{0}, {1, 2}]),
    ],
)
def test_chain_labels(spark, lines, streets, ignore, groups):
    skip = None if ignore is None else spark.createDataFrame([(float(ignore), float(ignore))], "x double, y double")
    out = T.chain_labels(lines(streets), skip).collect()
    found = {}
    for r in out:
        found.setdefault(r["label"], set()).add(r["street_id"])
    assert sorted(found.values(), key=min) == groups


@pytest.mark.parametrize(
    ("streets", "n"),
    [
        ([[(1, 0), (3, 0)], [(2, 0), (2, 1)]], 3),
        ([[(1, 0), (3, 0)], [(2, 0.1), (2, 1)]], 2),
        ([[(2, 0), (4, 0)], [(4, 1), (3, 0), (2, 1), (4, 1)], [(2, 1.5), (3, 1.5), (2.5, 1), (2, 1.5)]], 7),
    ],
)
def test_induce_nodes(lines, streets, n):
    assert T.induce_nodes(lines(streets)).count() == n


RING = [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]
NET = [[(1, 0), (2, 0)], [(2, 0), (3, 0)], [(3, 0), (4, 0)], [(4, 0), (5, 0)], [(3, 0), (2, 1)], [(2, 1), (3, 2)], [(4, 1), (3, 2)], [(3, 0), (4, 1)]]


@pytest.mark.parametrize(("rule", "animals"), [("first", {"cat", "dog"}), ("last", {"cat", "eel", "dog"})])
def test_interstitial_nodes(lines, rule, animals):
    out = T.remove_interstitial_nodes(lines(NET, animal=["cat"] * 3 + ["dog"] * 3 + ["eel"] * 2), rule).collect()
    assert len(out) == 3
    assert {r["animal"] for r in out} == animals
    ring = next(g for g in coords(out) if g[0] == g[-1])
    assert ring[0] == (3.0, 0.0) and set(ring) == {(3.0, 0.0), (4.0, 1.0), (3.0, 2.0), (2.0, 1.0)}


def test_fix_topology(lines):
    rings = [[(4, 1), (3, 0), (2, 1), (4, 1)], [(2, 1.5), (3, 1.5), (2.5, 1), (2, 1.5)]]
    out = T.fix_topology(lines([[(2, 0), (4, 0)], [(4, 0), (2, 0)], *rings])).collect()
    assert all(r["_status"] == "changed" for r in out)
    again = T.fix_topology(lines([[(2, 0), (4, 0)], *rings])).collect()
    assert len(out) == len(again)


def test_bowtie(lines):
    loops = [[(7, 2), (6.5, 2.5), (6.5, 1.5), (7, 2)], [(11, 2), (11.5, 2.5), (11.5, 1.5), (11, 2)]]
    ends = [[(7, 2), (9, 3), (11, 2)], [(7, 2), (9, 1), (11, 2)]]
    out = T.bowtie_nodes(lines([*loops, *ends, [(0, 0), (1, 0)]])).collect()
    assert {(r["x"], r["y"]) for r in out} == {(7.0, 2.0), (11.0, 2.0)}


def test_near_bowties(lines):
    """Both loops at one node, a third node, two loops at a node, one loop only, no loop: none is a bowtie."""

    def at(x, y):
        ring = lambda d, n: [(x + d, y), (x + d - 0.5, y + n), (x + d - 0.5, y - n), (x + d, y)]
        return ring(0, 0.5), ring(4, 0.5), ring(0, 0.7), [(x, y), (x + 2, y + 1), (x + 4, y)], [(x, y), (x + 2, y - 1), (x + 4, y)], [(x + 4, y), (x + 8, y)]

    near = []
    for k, chosen in enumerate([(0, 2, 3, 4), (0, 1, 3, 4, 5), (0, 1, 2, 3), (0, 3, 4), (3, 4)]):
        near += [at(0, 20 * k)[c] for c in chosen]
    assert T.bowtie_nodes(lines(near)).count() == 0
    both = T.bowtie_nodes(lines([*near, *(at(0, 200)[c] for c in (0, 1, 3))])).collect()
    assert {(r["x"], r["y"]) for r in both} == {(0.0, 200.0), (4.0, 200.0)}


def test_empty(spark, lines):
    none = lines([D(1, 2)]).limit(0)
    assert T.node_degrees(none).count() == 0
    assert T.dedupe(none).count() == 0
    assert T.fix_topology(none).count() == 0


def test_large_ids_and_many_cuts(spark):
    """Numbers of pieces can't collide or overflow: a street of 5,000 cuts, one of 70,000 vertices, ids from 2^60 on."""
    from wayfold.functions.lines import LINE
    from wayfold.operators.planar import edge_table

    long_ = [(float(k), 5.0) for k in range(70_000)]
    streets = spark.createDataFrame([(2**60, [(0.0, 0.0), (5001.0, 0.0)]), (2**60 + 1, long_)], f"street_id long, geom {LINE}")
    cuts = spark.range(1, 5001).selectExpr("cast(id as double) x", "0D y")
    pieces = T.renumber(T.split(streets, cuts))
    assert pieces.count() == pieces.select("street_id").distinct().count() == 5002
    edges = edge_table(pieces)
    assert edges.count() == edges.select("edge_id").distinct().count() == 5001 + 69_999
