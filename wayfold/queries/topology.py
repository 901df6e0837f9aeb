"""Queries of scalar functions, nodes and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import topology as T
from ..operators.graph import connected_components
from ..operators.spatial import segment_table
from ..plans.network import SQL_POINTS, streets
from ..plans.storage import written


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network, written once: the operators read their input several times."""
    return written(streets(spark, sf_dir), "network")


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(T.dedupe(streets(spark, sf_dir)), "deduped")


def street_length_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("geom")
    return streets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_streets"), F.round(F.sum(L.length(g)), 4).alias("total_length"), F.sum(F.size(g)).alias("n_points"))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_table(streets(spark, sf_dir))


def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dedupe(streets(spark, sf_dir)).select("street_id")


def endpoint_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.node_degrees(streets(spark, sf_dir))


def loop_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    loops, others = T.split_loops(streets(spark, sf_dir))
    return loops.select("street_id", F.lit(True).alias("is_loop")).unionByName(others.select("street_id", F.lit(False).alias("is_loop")))


def degree_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.degree_mismatch(deduped(spark, sf_dir))


def loop_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    off, on = T.loop_contacts(network(spark, sf_dir))
    return off.select("loop_id", "x", "y", F.lit("off").alias("side")).unionByName(on.select("loop_id", "x", "y", F.lit("on").alias("side")))


def induce_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.induce_points(deduped(spark, sf_dir))


def split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.induce_nodes(deduped(spark, sf_dir))
    return out.select("street_id", F.col("piece").cast("long").alias("piece"), "name", F.coalesce("_status", F.lit("kept")).alias("status"), F.size("geom").cast("long").alias("n_points"), F.round(L.length(F.col("geom")), 4).alias("length"))


def interstitial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chain_labels(deduped(spark, sf_dir))


def interstitial_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.remove_interstitial_nodes(deduped(spark, sf_dir), {"rank": "max"})
    return out.select("street_id", "name", "rank", F.col("_status").alias("status"), F.round(L.length(F.col("geom")), 4).alias("length"))


def fixed_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.fix_topology(network(spark, sf_dir))
    return out.agg(F.count(F.lit(1)).alias("n_streets"), F.round(F.sum(L.length(F.col("geom"))), 3).alias("total_length"))


def bowtie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bowtie_nodes(written(_bowties(spark, sf_dir), "bowties"))


def _bowties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of loops joined by one street or two, for every part, beside the network."""
    k = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    x = F.col("k") * 10.0
    p = lambda dx, y: L.point(x + dx, F.lit(float(y)))
    kinds = [L.line(p(0, 0), p(-2, 1), p(-2, -1), p(0, 0)), L.line(p(4, 0), p(6, 1), p(6, -1), p(4, 0)), L.line(p(0, 0), p(2, 1), p(4, 0)), L.line(p(4, 0), p(2, -1), p(0, 0))]
    return k.select("k", F.posexplode(F.array(*kinds)).alias("c", "geom")).filter("c < 3 or k % 20 = 0").select((F.col("k") * 10 + F.col("c")).alias("street_id"), "geom")


def components_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of orders and customers: a plain test of the graph operator."""
    c = spark.read.parquet(f"{sf_dir}/orders.parquet")
    edges = c.select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 1_000_000_000).alias("dst"))
    return connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "new").when(F.col("event_id") % 3 == 1, "original").alias("status"))
    n = F.count(F.lit(1))
    return e.groupBy("user_id").agg(F.coalesce(T.status_of(F.col("status"), n), F.lit("none")).alias("status"), n.alias("n"))


def angle_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segment_table(streets(spark, sf_dir))
    two = s.select("street_id", "seq", L.line(L.point(F.col("x1"), F.col("y1")), L.point(F.col("x2"), F.col("y2"))).alias("g"))
    nxt = two.select("street_id", (F.col("seq") - 1).alias("seq"), F.col("g").alias("h"))
    return two.join(nxt, ["street_id", "seq"]).select("street_id", "seq", F.round(L.angle_between_lines(F.col("g"), F.col("h")), 4).alias("angle"))


def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = L.interpolate(F.col("geom"), 0.5)
    return streets(spark, sf_dir).select("street_id", F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))


def segmentized(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = L.segmentize(F.col("geom"), 10.0)
    return streets(spark, sf_dir).select("street_id", F.size(dense).cast("long").alias("n_points"), F.round(L.length(dense), 3).alias("length"))


def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    loops, _ = T.split_loops(streets(spark, sf_dir))
    return loops.select("street_id", L.signed_area(F.col("geom")).alias("area"))


W = f"WITH RECURSIVE {SQL_POINTS}"
#: Streets without repetitions: two-point lines by their unordered ends, longer ones never repeat here.
DEDUPED = """,
forms AS (
  SELECT street_id, CASE WHEN (fx, fy) <= (lx, ly) THEN (fx, fy, lx, ly) ELSE (lx, ly, fx, fy) END AS form, n FROM ends
), kept AS (
  SELECT min(street_id) AS street_id FROM forms WHERE n = 2 GROUP BY form UNION ALL SELECT street_id FROM forms WHERE n > 2
), kseg AS (SELECT s.* FROM segs s SEMI JOIN kept USING (street_id)), kend AS (SELECT e.* FROM ends e SEMI JOIN kept USING (street_id)),
tips AS (SELECT street_id, fx AS x, fy AS y FROM kend UNION ALL SELECT street_id, lx, ly FROM kend),
deg AS (SELECT x, y, count(*) AS degree FROM tips GROUP BY x, y)"""
#: Streets near a place: distance to a segment with the foot clamped to it.
FOOT = "least(greatest(((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)), 0), 1)"
NEAR = f"p.x BETWEEN least(s.x1, s.x2) - 1 AND greatest(s.x1, s.x2) + 1 AND p.y BETWEEN least(s.y1, s.y2) - 1 AND greatest(s.y1, s.y2) + 1 AND hypot_(p.x - (s.x1 + {FOOT} * (s.x2 - s.x1)), p.y - (s.y1 + {FOOT} * (s.y2 - s.y1))) <= 1e-4".replace("hypot_(", "sqrt_sq(")


def _near(sql: str) -> str:
    """DuckDB has no hypot: write it out."""
    head, tail = sql.split("sqrt_sq(", 1)
    depth, k, comma = 1, 0, 0
    while depth:
        c = tail[k]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 1:
            comma = k
        k += 1
    a, b = tail[:comma], tail[comma + 1 : k - 1]
    return f"{head}sqrt(({a}) * ({a}) + ({b}) * ({b})){tail[k:]}"


NEAR = _near(NEAR)
MISMATCH = f""",
mism AS (
  SELECT p.x, p.y, p.degree, count(DISTINCT s.street_id) AS n_streets FROM deg p JOIN kseg s ON {NEAR} GROUP BY p.x, p.y, p.degree HAVING p.degree <> count(DISTINCT s.street_id)
)"""
CONTACTS = f""",
lp AS (SELECT street_id FROM ends WHERE n > 2 AND fx = lx AND fy = ly),
lv AS (SELECT DISTINCT street_id AS loop_id, x, y FROM pts SEMI JOIN lp USING (street_id)),
offl AS (SELECT DISTINCT p.loop_id, p.x, p.y FROM lv p JOIN (SELECT * FROM segs ANTI JOIN lp USING (street_id)) s ON {NEAR}),
onl AS (SELECT p.loop_id, p.x, p.y FROM lv p JOIN (SELECT * FROM segs SEMI JOIN lp USING (street_id)) s ON {NEAR} GROUP BY ALL HAVING count(DISTINCT s.street_id) > 1)"""
INDUCED = ", induced AS (SELECT x, y FROM mism UNION SELECT x, y FROM offl UNION SELECT x, y FROM onl)"
#: Pieces of streets without repetitions: only two-point streets are cut here, at most at inner places.
PIECES = f""",
hits AS (
  SELECT s.street_id, s.seq, s.x1, s.y1, s.x2, s.y2, p.x, p.y, {FOOT} AS t FROM induced p JOIN kseg s ON {NEAR}
), cutp AS (
  SELECT DISTINCT street_id, x, y, t FROM hits WHERE sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) > 1e-4 AND sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) > 1e-4
), stops AS (
  SELECT e.street_id, e.fx AS x, e.fy AS y, 0.0 AS t FROM kend e SEMI JOIN cutp USING (street_id)
  UNION ALL SELECT e.street_id, e.lx, e.ly, 1.0 FROM kend e SEMI JOIN cutp USING (street_id)
  UNION ALL SELECT * FROM cutp
), runs AS (
  SELECT street_id, row_number() OVER w - 1 AS piece, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM stops WINDOW w AS (PARTITION BY street_id ORDER BY t)
), kpts AS (SELECT street_id, count(*) AS n_points FROM pts SEMI JOIN kept USING (street_id) GROUP BY street_id),
pieces AS (
  SELECT r.street_id, r.piece, e.name, 'changed' AS status, 2 AS n_points, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS length, x AS fx, y AS fy, nx AS lx, ny AS ly, false AS loop, e.rank
  FROM runs r JOIN kend e USING (street_id) WHERE nx IS NOT NULL
  UNION ALL
  SELECT e.street_id, 0, e.name, 'kept', k.n_points, sum(sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))), e.fx, e.fy, e.lx, e.ly, e.n > 2 AND e.fx = e.lx AND e.fy = e.ly, e.rank
  FROM kend e ANTI JOIN cutp USING (street_id) JOIN kpts k USING (street_id) JOIN kseg s USING (street_id) GROUP BY ALL
)"""


def chains(source: str, key: str) -> str:
    """Labels of chains through nodes where exactly two ends of non-loops meet."""
    return f""",
cend AS (SELECT {key} AS id, fx AS x, fy AS y, loop FROM {source} UNION ALL SELECT {key}, lx, ly, loop FROM {source}),
joints AS (SELECT min(id) AS a, max(id) AS b FROM cend GROUP BY x, y HAVING count(*) = 2 AND NOT bool_or(loop) AND min(id) <> max(id)),
both_ways AS (SELECT a, b FROM joints UNION SELECT b, a FROM joints),
reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT reach.id, b.b FROM reach JOIN both_ways b ON b.a = reach.r),
chain AS (SELECT id, min(r) AS label FROM reach GROUP BY id)"""


KEND_LOOPS = ", kl AS (SELECT *, n > 2 AND fx = lx AND fy = ly AS loop FROM kend), klen AS (SELECT street_id, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS length FROM kseg GROUP BY street_id)"

QUERIES = {
    f.__name__: f
    for f in (street_length_total, line_segments, canonical_dedupe, endpoint_degrees, loop_partition, degree_mismatch, loop_contacts, induce_points, split_pieces, interstitial_labels, interstitial_attrs, fixed_topology, bowtie_nodes, components_check, status_rollup, angle_two_lines, midpoints, segmentized, ring_areas)
}
ORACLE = {
    "street_length_total": f"{W} SELECT count(DISTINCT street_id) AS n_streets, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 4) AS total_length, CAST((SELECT count(*) FROM pts) AS BIGINT) AS n_points FROM segs",
    "line_segments": f"{W} SELECT * FROM segs",
    "canonical_dedupe": f"{W}{DEDUPED} SELECT street_id FROM kept",
    "endpoint_degrees": f"{W} SELECT x, y, count(*) AS degree FROM (SELECT fx AS x, fy AS y FROM ends UNION ALL SELECT lx, ly FROM ends) GROUP BY x, y",
    "loop_partition": f"{W} SELECT street_id, n > 2 AND fx = lx AND fy = ly AS is_loop FROM ends",
    "degree_mismatch": f"{W}{DEDUPED}{MISMATCH} SELECT * FROM mism",
    "loop_contacts": f"{W}{CONTACTS} SELECT *, 'off' AS side FROM offl UNION ALL SELECT *, 'on' FROM onl",
    "induce_points": f"{W}{DEDUPED}{MISMATCH}{CONTACTS}{INDUCED} SELECT * FROM induced",
    "split_pieces": f"{W}{DEDUPED}{MISMATCH}{CONTACTS}{INDUCED}{PIECES} SELECT street_id, CAST(piece AS BIGINT) AS piece, name, status, CAST(n_points AS BIGINT) AS n_points, round(length, 4) AS length FROM pieces",
    "interstitial_labels": f"{W}{DEDUPED}{KEND_LOOPS}{chains('kl', 'street_id')} SELECT k.street_id, coalesce(c.label, k.street_id) AS label FROM kl k LEFT JOIN chain c ON c.id = k.street_id",
    "interstitial_attrs": f"""{W}{DEDUPED}{KEND_LOOPS}{chains('kl', 'street_id')}
      SELECT coalesce(c.label, k.street_id) AS street_id, arg_min(k.name, k.street_id) FILTER (WHERE k.name IS NOT NULL) AS name, max(k.rank) AS rank,
        CASE WHEN count(*) = 1 THEN 'original' ELSE 'changed' END AS status, round(sum(l.length), 4) AS length
      FROM kl k JOIN klen l USING (street_id) LEFT JOIN chain c ON c.id = k.street_id GROUP BY 1""",
    "fixed_topology": f"""{W}{DEDUPED}{MISMATCH}{CONTACTS}{INDUCED}{PIECES}{chains('pieces', 'street_id * 4096 + piece')}
      SELECT count(DISTINCT coalesce(c.label, p.street_id * 4096 + p.piece)) AS n_streets, round(sum(length), 3) AS total_length
      FROM pieces p LEFT JOIN chain c ON c.id = p.street_id * 4096 + p.piece""",
    "bowtie_nodes": "SELECT p_partkey * 10.0 + d AS x, CAST(0 AS DOUBLE) AS y FROM part, (VALUES (CAST(0 AS DOUBLE)), (CAST(4 AS DOUBLE))) v(d)",
    "components_check": """WITH c AS (SELECT o_custkey, min(o_orderkey) AS component, count(*) + 1 AS n_nodes FROM orders GROUP BY o_custkey)
      SELECT component, n_nodes FROM c""",
    "status_rollup": """WITH e AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'original' END AS status FROM events)
      SELECT user_id, CASE WHEN bool_and(coalesce(status = 'new', false)) THEN 'new' WHEN count(*) = 1 THEN coalesce(any_value(status), 'none') ELSE 'changed' END AS status, count(*) AS n FROM e GROUP BY user_id""",
    "angle_two_lines": f"""{W} SELECT a.street_id, a.seq,
        round(degrees(acos(round(((a.x1 - a.x2) * (b.x2 - b.x1) + (a.y1 - a.y2) * (b.y2 - b.y1)) / (sqrt((a.x1 - a.x2) * (a.x1 - a.x2) + (a.y1 - a.y2) * (a.y1 - a.y2)) * sqrt((b.x2 - b.x1) * (b.x2 - b.x1) + (b.y2 - b.y1) * (b.y2 - b.y1))), 6))), 4) AS angle
      FROM segs a JOIN segs b ON b.street_id = a.street_id AND b.seq = a.seq + 1""",
    "midpoints": f"""{W}, sl AS (
        SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS size, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) OVER (PARTITION BY street_id) / 2 AS goal,
          sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) OVER (PARTITION BY street_id ORDER BY seq) AS upto FROM segs
      ) SELECT street_id, round(x1 + least(greatest((goal - (upto - size)) / size, 0), 1) * (x2 - x1), 4) AS x, round(y1 + least(greatest((goal - (upto - size)) / size, 0), 1) * (y2 - y1), 4) AS y
      FROM sl WHERE upto - size < goal QUALIFY row_number() OVER (PARTITION BY street_id ORDER BY seq DESC) = 1""",
    "segmentized": f"""{W} SELECT street_id, CAST(1 + sum(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 10.0)) AS BIGINT) AS n_points,
        round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 3) AS length FROM segs GROUP BY street_id""",
    "ring_areas": f"{W}{CONTACTS} SELECT street_id, sum(x1 * y2 - x2 * y1) / 2 AS area FROM segs SEMI JOIN lp USING (street_id) GROUP BY street_id",
}
