"""A street network made from the part table by arithmetic, in DataFrame functions and in SQL.

A grid of nodes, one per part, jittered by its size; edges to the right and up; and, by the node's number, the faults
that the operators are there to find: middle nodes, reversed copies, stubs that touch a street between its nodes, loops,
parallel carriageways, and diagonals that cross without a node. Coordinates are whole or half numbers, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L

COLUMNS = 40


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """street_id, name, rank, geom."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter(F.col("p_partkey").isNotNull())
    k = F.col("p_partkey")
    nodes = part.select(k.alias("k"), (100 * (k % COLUMNS) + F.col("p_size") % 7).cast("double").alias("x"), (100 * F.floor(k / COLUMNS) + F.col("p_size") % 5).cast("double").alias("y"), F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("rank"))
    to = nodes.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    right = nodes.filter(f"k % {COLUMNS} < {COLUMNS - 1} and (k * 7919) % 11 <> 0").withColumn("k2", F.col("k") + 1).join(to, "k2")
    up = nodes.withColumn("k2", F.col("k") + COLUMNS).join(to, "k2")
    at = lambda by, n: nodes.select((F.col("k") - by).alias("k"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    block = nodes.filter(f"k % 23 in (7, 11) and k % 29 <> 0 and k % {COLUMNS} < {COLUMNS - 1} and floor(k / {COLUMNS}) % 8 <> 3").join(at(1, 2), "k").join(at(COLUMNS, 3), "k").join(at(COLUMNS + 1, 4), "k")
    p = lambda x, y: L.point(F.expr(x), F.expr(y))
    a, b, m = p("x", "y"), p("x2", "y2"), p("(x + x2) / 2", "(y + y2) / 2")
    made = [
        right.filter("k % 3 <> 0").select((F.col("k") * 10).alias("street_id"), "name", "rank", L.line(a, b).alias("geom")),
        right.filter("k % 3 = 0").select((F.col("k") * 10).alias("street_id"), "name", "rank", L.line(a, m).alias("geom")),
        right.filter("k % 3 = 0").select((F.col("k") * 10 + 1).alias("street_id"), F.lit(None).cast("string").alias("name"), "rank", L.line(m, b).alias("geom")),
        up.select((F.col("k") * 10 + 2).alias("street_id"), "name", "rank", L.line(a, b).alias("geom")),
        up.filter("k % 17 = 0").select((F.col("k") * 10 + 3).alias("street_id"), "name", "rank", L.line(b, a).alias("geom")),
        right.filter("k % 3 <> 0 and k % 13 = 0").select((F.col("k") * 10 + 4).alias("street_id"), "name", "rank", L.line(m, p("(x + x2) / 2", "(y + y2) / 2 - 20")).alias("geom")),
        right.filter(f"k % 29 = 0 and floor(k / {COLUMNS}) % 8 <> 3").select((F.col("k") * 10 + 5).alias("street_id"), "name", "rank", L.line(a, p("x + 14", "y + 6"), p("x + 10", "y + 12"), a).alias("geom")),
        right.filter(f"floor(k / {COLUMNS}) % 8 = 3").select((F.col("k") * 10 + 6).alias("street_id"), "name", "rank", L.line(a, p("x + 10", "y + 8"), p("x2 - 10", "y2 + 8"), b).alias("geom")),
        block.select((F.col("k") * 10 + 7).alias("street_id"), "name", "rank", L.line(a, p("x4", "y4")).alias("geom")),
        block.filter("k % 23 = 7").select((F.col("k") * 10 + 8).alias("street_id"), "name", "rank", L.line(b, p("x3", "y3")).alias("geom")),
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


#: Point rows (street_id, name, rank, seq, x, y) of the same network, first of the common table expressions of every query's SQL.
SQL_POINTS = f"""
net AS (
  SELECT p_partkey AS k, CAST(100 * (p_partkey % {COLUMNS}) + p_size % 7 AS DOUBLE) AS x, CAST(100 * (p_partkey // {COLUMNS}) + p_size % 5 AS DOUBLE) AS y, p_brand AS name, CAST(p_size AS BIGINT) AS rank
  FROM part WHERE p_partkey IS NOT NULL
),
rgt AS (SELECT a.*, b.x AS x2, b.y AS y2 FROM net a JOIN net b ON b.k = a.k + 1 WHERE a.k % {COLUMNS} < {COLUMNS - 1} AND (a.k * 7919) % 11 <> 0),
upp AS (SELECT a.*, b.x AS x2, b.y AS y2 FROM net a JOIN net b ON b.k = a.k + {COLUMNS}),
blk AS (
  SELECT a.*, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3, d.x AS x4, d.y AS y4 FROM net a JOIN net b ON b.k = a.k + 1 JOIN net c ON c.k = a.k + {COLUMNS} JOIN net d ON d.k = a.k + {COLUMNS + 1}
  WHERE a.k % 23 IN (7, 11) AND a.k % 29 <> 0 AND a.k % {COLUMNS} < {COLUMNS - 1} AND (a.k // {COLUMNS}) % 8 <> 3
),
raw AS (
  SELECT k * 10 AS street_id, name, rank, [x, x2] AS xs, [y, y2] AS ys FROM rgt WHERE k % 3 <> 0
  UNION ALL SELECT k * 10, name, rank, [x, (x + x2) / 2], [y, (y + y2) / 2] FROM rgt WHERE k % 3 = 0
  UNION ALL SELECT k * 10 + 1, NULL, rank, [(x + x2) / 2, x2], [(y + y2) / 2, y2] FROM rgt WHERE k % 3 = 0
  UNION ALL SELECT k * 10 + 2, name, rank, [x, x2], [y, y2] FROM upp
  UNION ALL SELECT k * 10 + 3, name, rank, [x2, x], [y2, y] FROM upp WHERE k % 17 = 0
  UNION ALL SELECT k * 10 + 4, name, rank, [(x + x2) / 2, (x + x2) / 2], [(y + y2) / 2, (y + y2) / 2 - 20] FROM rgt WHERE k % 3 <> 0 AND k % 13 = 0
  UNION ALL SELECT k * 10 + 5, name, rank, [x, x + 14, x + 10, x], [y, y + 6, y + 12, y] FROM rgt WHERE k % 29 = 0 AND (k // {COLUMNS}) % 8 <> 3
  UNION ALL SELECT k * 10 + 6, name, rank, [x, x + 10, x2 - 10, x2], [y, y + 8, y2 + 8, y2] FROM rgt WHERE (k // {COLUMNS}) % 8 = 3
  UNION ALL SELECT k * 10 + 7, name, rank, [x, x4], [y, y4] FROM blk
  UNION ALL SELECT k * 10 + 8, name, rank, [x2, x3], [y2, y3] FROM blk WHERE k % 23 = 7
),
pts AS (SELECT street_id, name, rank, unnest(range(1, len(xs) + 1)) AS seq, unnest(xs) AS x, unnest(ys) AS y FROM raw),
segs AS (
  SELECT street_id, CAST(seq AS INTEGER) AS seq, x AS x1, y AS y1, nx AS x2, ny AS y2
  FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY street_id ORDER BY seq)) WHERE nx IS NOT NULL
),
ends AS (
  SELECT street_id, arg_min(x, seq) AS fx, arg_min(y, seq) AS fy, arg_max(x, seq) AS lx, arg_max(y, seq) AS ly, count(*) AS n, min(name) AS name, min(rank) AS rank FROM pts GROUP BY street_id
)"""
