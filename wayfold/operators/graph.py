"""Connected components of an edge table, by alternating stars.

Each round points every node at the least node it knows, first over larger neighbours, then over smaller ones, until no
edge changes. Components of any size work: only minima per node are aggregated, and they combine before the shuffle.
Minima of nodes with many edges, of which there can only be few, are broadcast; the edges of such a node stay spread.

Where neighbours have near ids, as streets and faces do, tasks first put together what lies in a range of ids; rounds are
for the edges between ranges only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import counted_join
from ..plans.storage import forget, written

#: Edges of the nodes that a task puts together at a time.
JOINED = 200_000


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """The edges (src, dst) and low, the least dst of each src."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("n"))
    return counted_join(edges, least, ["src"], "n", rows, F.col("dst"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node's neighbours and the node itself."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _least(both, 2 * rows).filter("dst > src").select(F.col("dst").alias("src"), F.least("src", "low").alias("dst"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of the smaller neighbours."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    tied = F.array(F.struct(F.col("src").alias("src"), F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))
    return _least(down, rows).select(F.explode(tied).alias("e")).select("e.*").filter("src != dst")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the least node that can be reached), for every node with an edge to another node.

    Loops and edges with a null end are left out; repeated edges count once.
    """

    def look(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst") % 1_000_003), F.sum(F.xxhash64("dst", "src") % 998_244_353)).first())

    now = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src != dst")
    now = written(now.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "components")
    state = look(now)
    while state[0]:
        stars = written(_large_star(now, state[0]).distinct(), "components")
        new = written(_small_star(stars, state[0]).distinct(), "components")
        forget(now, stars)
        before, state, now = state, look(new), new
        if state == before:
            break
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)


def _together(rows: pa.Table) -> pa.RecordBatch:
    """Of edges (src, dst) in the order of src, all those of each src at hand: a row per src with its root, the least src
    that is reached among them, and the dst of edges that lead elsewhere (out)."""
    src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
    nodes, a = np.unique(src, return_inverse=True)
    b = np.minimum(np.searchsorted(nodes, dst), len(nodes) - 1)
    inner = nodes[b] == dst
    parent, left, right = np.arange(len(nodes)), a[inner], b[inner]
    while len(left):
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        apart = low < high
        left, right = left[apart], right[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            far = parent[parent]
            if (far == parent).all():
                break
            parent = far
    leaving = np.zeros(len(nodes), bool)
    leaving[parent[a[~inner]]] = True
    node, root = np.concatenate((nodes, src[~inner])), np.concatenate((nodes[parent], nodes[parent[a[~inner]]]))
    out = pa.array(np.concatenate((np.zeros(len(nodes), np.int64), dst[~inner])), pa.int64(), mask=np.arange(len(node)) < len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), out, pa.array(np.concatenate((leaving[parent], np.ones(len(node) - len(nodes), bool))))], names=["node", "root", "out", "open"])


def _together_batches(batches: Iterator[pa.RecordBatch], some: int) -> Iterator[pa.RecordBatch]:
    """So many edges at a time, about, and all of each src."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < some:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        src = rows.column("src").to_numpy()
        inner = np.flatnonzero(src[1:] != src[:-1])
        if len(inner):
            cut = int(inner[-1]) + 1
            yield _together(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), n - cut
    if n:
        yield _together(pa.Table.from_batches(held))


def _both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("e")).select("e.*")


def near_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """connected_components of an edge table of which most edges join ids (long) that are near. Others give the same rows, in more rounds."""
    c = F.col
    one = edges.select(c(src).cast("long").alias("src"), c(dst).cast("long").alias("dst")).filter("src != dst")
    together = lambda rows, some: rows.sortWithinPartitions("src").mapInArrow(lambda batches: _together_batches(batches, some), "node long, root long, out long, open boolean")
    parts = written(together(_both_ways(one).repartitionByRange("src"), JOINED), "component-parts")
    leaving = parts.filter("out is not null")
    back = leaving.select(c("out").alias("node"), c("node").alias("out"), c("root").alias("far"))
    between = written(leaving.select("node", "out", "root").join(back, ["node", "out"]).select("root", "far").filter("root > far").distinct(), "between-parts")
    nodes = parts.filter("out is null")
    n = between.count()
    if not n:
        forget(between)
        return nodes.select("node", c("root").alias("component"))
    if n <= JOINED:
        # Few enough for one task.
        few = _both_ways(between.select(c("root").alias("src"), c("far").alias("dst"))).repartition(1)
        found = together(few, 2 * JOINED + 1).select(c("node").alias("root"), c("root").alias("component"))
    else:
        found = connected_components(between, "root", "far").select(c("node").alias("root"), "component")
    found = written(found, "joined-parts")
    forget(between)
    # A root is that of at most so many nodes as a task has put together.
    joined = nodes.filter("open").join(found, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return nodes.filter("not open").select("node", c("root").alias("component")).unionByName(joined)
