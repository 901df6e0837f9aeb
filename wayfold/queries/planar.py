"""Queries of faces, artifacts, strokes, gaps and clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import cluster as K
from ..operators import faces as A
from ..operators import gaps as G
from ..operators import planar as P
from ..operators import simplify as M
from ..operators import strokes as S
from ..operators import topology as T
from ..plans.network import streets
from ..plans.storage import written
from .topology import CONTACTS, DEDUPED, INDUCED, MISMATCH, NEAR, PIECES, W, deduped, network

#: Of the single-round queries, and a wider one that also takes the halves of blocks, which are pairs.
THRESHOLD, PAIR_THRESHOLD = 7.5, 8.2


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets without repetitions, cut where nodes are missing and where they cross."""
    whole = written(T.dedupe(streets(spark, sf_dir)), "deduped")
    return written(T.renumber(T.induce_nodes(whole, more=P.crossings(whole))), "pieces")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.face_edges(_pieces(spark, sf_dir))


def planar_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.faces(_labelled(spark, sf_dir))
    r = lambda c, n: F.round(F.col(c), n).alias(c)
    return f.select("n_edges", r("area", 3), r("perimeter", 3), "min_x", "min_y", r("isoareal_index", 6), r("isoperimetric_quotient", 6))


def _network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    labelled = _labelled(spark, sf_dir)
    f = written(A.with_index(P.faces(labelled), "isoperimetric_quotient"), "faces")
    return labelled, f, written(P.rook_adjacency(labelled, f), "adjacent")


#: A face is named by its least corner and its size; ids of half-edges differ between engines.
KEY = ("min_x", "min_y", "area")


def rook_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f, adjacent = _network(spark, sf_dir)
    side = lambda name, p: f.select(F.col("face_id").alias(name), *(F.round(F.col(c), 3).alias(p + c) for c in KEY))
    return adjacent.join(side("focal", "a_"), "focal").join(side("neighbor", "b_"), "neighbor").drop("focal", "neighbor")


def artifact_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f, adjacent = _network(spark, sf_dir)
    out = A.grow_artifacts(f, adjacent, THRESHOLD)
    return out.select(*(F.round(F.col(c), 3).alias(c) for c in KEY), "is_artifact")


def artifact_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the components of artifacts: single, pair or cluster."""
    _, f, adjacent = _network(spark, sf_dir)
    art = A.grow_artifacts(f, adjacent, THRESHOLD).filter("is_artifact")
    parts = P.face_components(adjacent, art).join(art.select("face_id", *KEY), "face_id")
    kind = F.when(F.col("comp_size") == 1, "singleton").when(F.col("comp_size") == 2, "pair").otherwise("cluster")
    return parts.select(*(F.round(F.col(c), 3).alias(c) for c in KEY), "comp_size", kind.alias("kind"))


def face_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f, _ = _network(spark, sf_dir)
    places, pdf = A.density(f)
    return spark.createDataFrame([(k, round(float(x), 6), round(float(d), 6)) for k, (x, d) in enumerate(zip(places, pdf, strict=True))], "k long, place double, density double")


def face_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole face-artifact analysis with the circle index: faces, peaks, valleys, threshold."""
    labelled = _labelled(spark, sf_dir)
    f = P.faces(labelled).join(P.face_rings(labelled), "face_id")
    out = A.face_artifacts(f)
    return spark.createDataFrame([(out.polygons.count(), len(out.peaks), len(out.valleys), out.threshold)], "n_faces long, n_peaks long, n_valleys long, threshold double")


def artifact_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that a mask over every tenth node's neighbourhood leaves."""
    labelled, f, adjacent = _network(spark, sf_dir)
    art = A.grow_artifacts(f, adjacent, THRESHOLD).filter("is_artifact").join(P.face_rings(labelled), "face_id")
    p = lambda x, y: L.point(F.lit(float(x)), F.lit(float(y)))
    mask = spark.range(1).select(L.line(p(-50, -50), p(1000, -50), p(1000, 1000), p(-50, 1000), p(-50, -50)).alias("ring"))
    return A.exclude(art, mask).select(*(F.round(F.col(c), 3).alias(c) for c in KEY))


def stroke_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.continuity(deduped(spark, sf_dir))
    return out.select("street_id", "coins_group", "coins_end", F.round("coins_len", 3).alias("coins_len"), "coins_count")


def _ringed(spark: SparkSession, sf_dir: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pieces, their artifacts with rings, all faces, and labelled half-edges."""
    pieces = _pieces(spark, sf_dir)
    labelled = P.face_edges(pieces)
    f = written(A.with_index(P.faces(labelled), "isoperimetric_quotient").join(P.face_rings(labelled), "face_id"), "faces")
    return pieces, f.filter(F.col("face_artifact_index") < threshold), f, labelled


def _rings(art: DataFrame) -> DataFrame:
    return art.select(F.col("face_id").alias("artifact_id"), F.array("ring").cast(M.RINGS).alias("rings"))


def ces_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each artifact sees of the strokes on its boundary, and the rule for it."""
    pieces, art, *_ = _ringed(spark, sf_dir, THRESHOLD)
    out = M.single_types(M.with_strokes(pieces), _rings(art)).withColumnRenamed("artifact_id", "face_id")
    return out.join(art, "face_id").select(*(F.round(F.col(c), 3).alias(c) for c in KEY), "ces_type", "rule")


def skeleton_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of single artifacts drop and add, by rule: streets, lines, and length of the lines that come."""
    pieces, art, *_ = _ringed(spark, sf_dir, THRESHOLD)
    out = M.single_changes(M.with_strokes(pieces), _rings(art), M.R.Options())
    rules = out.filter("op = 'rule'").select("artifact_id", F.split("note", " ")[1].alias("rule"))
    size = F.when(F.col("op") == "add", L.length(F.col("geom")))
    return out.filter("op <> 'rule'").join(rules, "artifact_id").groupBy("rule", "op").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.sum(size), 2), F.lit(0.0)).alias("length"))


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets that lie within a face without bounding it."""
    pieces, art, *_ = _ringed(spark, sf_dir, math.inf)
    inner = M.contained_streets(pieces, _rings(art))
    g = F.col("geom")
    return pieces.join(inner, "street_id", "left_semi").select(F.round(L.first_point(g)["x"], 3).alias("x1"), F.round(L.first_point(g)["y"], 3).alias("y1"), F.round(L.last_point(g)["x"], 3).alias("x2"), F.round(L.last_point(g)["y"], 3).alias("y2"))


def dangling_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dangling_ends(network(spark, sf_dir))


def extend_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = G.extension_hits(network(spark, sf_dir), 120.0)
    return hits.select("street_id", "end", F.round("hx", 3).alias("hx"), F.round("hy", 3).alias("hy"))


def extended_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.extend_lines(network(spark, sf_dir), 120.0, extension=1.0)
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(L.length(F.col("geom"))), 3).alias("total_length"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from events: users on a line, values across it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("user_id") * 8.0).alias("x"), (F.floor("value") * 4).cast("double").alias("y")).distinct()


def density_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring values of each user: within 5 lie those of one user whose values differ by one."""
    out = K.density_components(_points(spark, sf_dir), 5.0)
    return out.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")).drop("component")


def node_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.node_clusters(T.node_degrees(network(spark, sf_dir)), 21.0)
    return out.select(F.size("points").cast("long").alias("n"), F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"))


def close_gap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.gap_centroids(written(_shifted(spark, sf_dir), "shifted"), 2.5)
    return out.select("n", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network with the last point of every fourth upward street two units off."""
    s = streets(spark, sf_dir)
    end = L.last_point(F.col("geom"))
    off = F.concat(F.slice("geom", F.lit(1), F.size("geom") - 1), F.array(L.point(end["x"] + 2, end["y"])))
    return s.withColumn("geom", F.when(F.col("street_id") % 40 == 2, off).otherwise(F.col("geom")))


def gaps_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.close_gaps(written(_shifted(spark, sf_dir), "shifted"), 2.5)
    return T.node_degrees(out).agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.sum(F.col("x") * F.col("degree")), 2).alias("sum_x"))


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.consolidate_nodes(deduped(spark, sf_dir), 21.0)
    return out.groupBy(F.coalesce("_status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(L.length(F.col("geom"))), 1).alias("length"))


def pair_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of artifacts and what is to be done with the street between them."""
    pieces, art, f, labelled = _ringed(spark, sf_dir, PAIR_THRESHOLD)
    adjacent = written(P.rook_adjacency(labelled, f), "adjacent")
    comps = P.face_components(adjacent, art).filter("comp_size = 2")
    pairs = art.join(comps, "face_id").groupBy(F.col("comp").alias("artifact_id")).agg(F.array_sort(F.collect_list(F.struct("face_id", "ring"))).alias("r")).select("artifact_id", F.transform("r", lambda x: x["ring"]).alias("rings"))
    out = M.pair_table(M.with_strokes(pieces), written(pairs, "pairs"))
    return out.groupBy("solution", "planar_a", "planar_b").agg(F.count(F.lit(1)).alias("n"), F.sum("nodes_a").alias("nodes_a"), F.sum("nodes_b").alias("nodes_b"))


def simplified_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network after repair, consolidation and one round of simplification."""
    out = M.simplify(network(spark, sf_dir), artifact_threshold=THRESHOLD, n_loops=1)
    return out.groupBy(F.coalesce("_status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(L.length(F.col("geom"))), 1).alias("length"))


#: Undirected edges of the cut network, pruned of dangles round by round, and half-edges with their successors and faces.
CROSS = "((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1))"
NODED = f""",
crossp AS (
  SELECT DISTINCT x1 + t * dx AS x, y1 + t * dy AS y FROM (
    SELECT a.x1, a.y1, a.x2 - a.x1 AS dx, a.y2 - a.y1 AS dy, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif({CROSS}, 0) AS t, ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / nullif({CROSS}, 0) AS u
    FROM kseg a JOIN kseg b ON a.street_id < b.street_id AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
  ) WHERE t > 0 AND t < 1 AND u > 0 AND u < 1
), noded AS (SELECT x, y FROM induced UNION SELECT x, y FROM crossp)"""
EDGES = f"""{DEDUPED}{MISMATCH}{CONTACTS}{INDUCED}{NODED}{PIECES.replace('FROM induced p', 'FROM noded p')},
plain AS (
  SELECT fx AS x1, fy AS y1, lx AS x2, ly AS y2 FROM pieces WHERE status = 'changed'
  UNION ALL SELECT s.x1, s.y1, s.x2, s.y2 FROM kseg s ANTI JOIN cutp USING (street_id)
), e0 AS (SELECT DISTINCT CASE WHEN (x1, y1) < (x2, y2) THEN (x1, y1, x2, y2) ELSE (x2, y2, x1, y1) END AS e FROM plain WHERE (x1, y1) <> (x2, y2))"""


def _prune(k: int) -> str:
    a, b = f"e{k}", f"e{k + 1}"
    return f""",
n{k} AS MATERIALIZED (SELECT p FROM (SELECT (e[1], e[2]) AS p FROM {a} UNION ALL SELECT (e[3], e[4]) FROM {a}) GROUP BY p HAVING count(*) = 1),
{b} AS MATERIALIZED (SELECT e FROM {a} WHERE (e[1], e[2]) NOT IN (SELECT p FROM n{k}) AND (e[3], e[4]) NOT IN (SELECT p FROM n{k}))"""


ROUNDS = 8
TRACE = "".join(_prune(k) for k in range(ROUNDS)) + f""",
edge AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e) AS id, e[1] AS x1, e[2] AS y1, e[3] AS x2, e[4] AS y2 FROM e{ROUNDS}),
half AS MATERIALIZED (SELECT 2 * id AS h, 2 * id + 1 AS twin, x1 AS sx, y1 AS sy, x2 AS tx, y2 AS ty FROM edge UNION ALL SELECT 2 * id + 1, 2 * id, x2, y2, x1, y1 FROM edge),
turn AS (
  SELECT *, coalesce(lag(h) OVER w, last_value(h) OVER (PARTITION BY sx, sy ORDER BY atan2(ty - sy, tx - sx) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS right_of
  FROM half WINDOW w AS (PARTITION BY sx, sy ORDER BY atan2(ty - sy, tx - sx))
), nxt AS MATERIALIZED (SELECT twin AS h, right_of AS n FROM turn),
orbit AS (SELECT h, h AS r FROM nxt UNION SELECT o.h, n.n FROM orbit o JOIN nxt n ON n.h = o.r),
own AS MATERIALIZED (SELECT h, min(r) AS face FROM orbit GROUP BY h),
face AS MATERIALIZED (
  SELECT face, count(*) AS n_edges, sum(sx * ty - tx * sy) / 2 AS area, sum(sqrt((tx - sx) * (tx - sx) + (ty - sy) * (ty - sy))) AS perimeter, min(sx) AS min_x, min(sy) AS min_y
  FROM half JOIN own USING (h) GROUP BY face HAVING sum(sx * ty - tx * sy) > 0
), shape AS MATERIALIZED (
  SELECT *, 2 * sqrt({math.pi} * area) / perimeter AS isoareal_index, 4 * {math.pi} * area / (perimeter * perimeter) AS isoperimetric_quotient, ln(4 * {math.pi} * area / (perimeter * perimeter) * area) AS fai FROM face
), adj AS MATERIALIZED (
  SELECT DISTINCT a.face AS focal, b.face AS neighbor FROM half h JOIN own a ON a.h = h.h JOIN own b ON b.h = h.twin SEMI JOIN face fa ON fa.face = a.face SEMI JOIN face fb ON fb.face = b.face WHERE a.face <> b.face
)"""
FACES = f"{W}{EDGES}{TRACE}"
KEYS = "round(min_x, 3) AS min_x, round(min_y, 3) AS min_y, round(area, 3) AS area"


def _grow(k: int) -> str:
    return f""",
g{k + 1} AS MATERIALIZED (
  SELECT s.face, g.art OR ((enclosed OR touching) AND area < 1e5 AND isoareal_index < 0.5) OR (enclosed AND area < 5e4 AND isoareal_index > 0.75) OR (touching AND area < 5e4 AND isoperimetric_quotient > 0.9) AS art
  FROM shape s JOIN g{k} g USING (face) JOIN (
    SELECT s.face, coalesce(bool_and(n.art), false) AS enclosed, coalesce(bool_or(n.art), false) AS touching FROM shape s LEFT JOIN adj a ON a.focal = s.face LEFT JOIN g{k} n ON n.face = a.neighbor GROUP BY s.face
  ) r USING (face)
)"""


GROWN = f", g0 AS MATERIALIZED (SELECT face, fai < {THRESHOLD} AS art FROM shape)" + "".join(_grow(k) for k in range(12))
STROKES = """,
tip AS (
  SELECT street_id, 0 AS e, arg_min(x1, seq) AS px, arg_min(y1, seq) AS py, arg_min(x2, seq) AS qx, arg_min(y2, seq) AS qy FROM kseg GROUP BY street_id
  UNION ALL SELECT street_id, 1, arg_max(x2, seq), arg_max(y2, seq), arg_max(x1, seq), arg_max(y1, seq) FROM kseg GROUP BY street_id
), tipd AS (SELECT *, count(*) OVER (PARTITION BY px, py) AS degree FROM tip),
met AS (
  SELECT a.street_id AS a, a.e AS ea, b.street_id AS b, b.e AS eb, a.degree,
    degrees(acos(greatest(-1, least(1, round(((a.qx - a.px) * (b.qx - a.px) + (a.qy - a.py) * (b.qy - a.py)) / (sqrt((a.qx - a.px) ** 2 + (a.qy - a.py) ** 2) * sqrt((b.qx - a.px) ** 2 + (b.qy - a.py) ** 2)), 6))))) AS angle
  FROM tipd a JOIN tipd b ON a.px = b.px AND a.py = b.py AND a.street_id <> b.street_id
), pref AS (SELECT a, ea, b, eb FROM met WHERE angle > 120 OR degree = 2 QUALIFY row_number() OVER (PARTITION BY a, ea ORDER BY angle DESC, b DESC, eb) = 1),
bond AS MATERIALIZED (SELECT p.* FROM pref p JOIN pref q ON p.a = q.b AND p.ea = q.eb AND p.b = q.a AND p.eb = q.ea),
flow AS (SELECT a AS id, a AS r FROM bond UNION SELECT f.id, b.b FROM flow f JOIN bond b ON b.a = f.r),
strk AS MATERIALIZED (SELECT id, min(r) AS grp FROM flow GROUP BY id), nlink AS (SELECT a AS id, count(DISTINCT ea) AS n FROM bond GROUP BY a),
slen AS (SELECT street_id, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS length FROM kseg GROUP BY street_id)"""
FREE = """,
atip AS (SELECT street_id, 0 AS "end", fx AS x, fy AS y FROM ends UNION ALL SELECT street_id, 1, lx, ly FROM ends),
free AS (SELECT p.street_id, p."end", p.x, p.y FROM atip p JOIN segs s ON """ + "{near} GROUP BY ALL HAVING count(DISTINCT s.street_id) = 1)"

FREE = FREE.format(near=NEAR.replace("1e-4", "1e-9"))

#: Free ends of the network, their prolongation by 120 with the millionth that tilts it, and the first street that each meets.
RAYS = f"""{W}{FREE},
back AS (
  SELECT f.*, CASE f."end" WHEN 0 THEN ax ELSE bx END AS qx, CASE f."end" WHEN 0 THEN ay ELSE b_y END AS qy
  FROM free f JOIN (SELECT street_id, arg_min(x2, seq) AS ax, arg_min(y2, seq) AS ay, arg_max(x1, seq) AS bx, arg_max(y1, seq) AS b_y FROM segs GROUP BY street_id) USING (street_id)
), ray AS (
  SELECT street_id, "end", x, y, x + CASE WHEN x - qx > 0 OR (x = qx AND y > qy) THEN 1 ELSE -1 END * 120 * cos(atan(abs(-(y - qy) + 0.000001) / abs(-(x - qx) + 0.000001))) AS rx, y + CASE WHEN y - qy > 0 THEN 1 ELSE -1 END * 120 * sin(atan(abs(-(y - qy) + 0.000001) / abs(-(x - qx) + 0.000001))) AS ry FROM back
), met1 AS (
  SELECT r.*, s.street_id AS hit_id, ((s.x1 - r.x) * (s.y2 - s.y1) - (s.y1 - r.y) * (s.x2 - s.x1)) / nullif((r.rx - r.x) * (s.y2 - s.y1) - (r.ry - r.y) * (s.x2 - s.x1), 0) AS t,
    ((s.x1 - r.x) * (r.ry - r.y) - (s.y1 - r.y) * (r.rx - r.x)) / nullif((r.rx - r.x) * (s.y2 - s.y1) - (r.ry - r.y) * (s.x2 - s.x1), 0) AS u
  FROM ray r JOIN segs s ON s.street_id <> r.street_id AND least(s.x1, s.x2) <= greatest(r.x, r.rx) AND least(r.x, r.rx) <= greatest(s.x1, s.x2) AND least(s.y1, s.y2) <= greatest(r.y, r.ry) AND least(r.y, r.ry) <= greatest(s.y1, s.y2)
), hit1 AS (SELECT street_id, "end", x, y, x + t * (rx - x) AS hx, y + t * (ry - y) AS hy FROM met1 WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 QUALIFY row_number() OVER (PARTITION BY street_id, "end" ORDER BY t, hit_id) = 1)"""

QUERIES = {
    f.__name__: f
    for f in (planar_faces, rook_adjacency, artifact_fixpoint, artifact_components, face_kde, face_threshold, artifact_mask, stroke_groups, ces_types, skeleton_lengths, contained, dangling_ends, extend_rays, extended_total, density_components, node_clusters, close_gap_centroids, gaps_closed, consolidated, pair_solutions, simplified_total)
}
SHIFTED = """,
moved AS (SELECT street_id, fx, fy, CASE WHEN street_id % 40 = 2 THEN lx + 2 ELSE lx END AS lx, ly FROM ends),
gap AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT fx AS x, fy AS y FROM moved UNION ALL SELECT lx, ly FROM moved)),
close2 AS MATERIALIZED (SELECT a.x, a.y, b.x AS bx, b.y AS by FROM gap a JOIN gap b ON b.x BETWEEN a.x - 2.5 AND a.x + 2.5 AND b.y BETWEEN a.y - 2.5 AND a.y + 2.5 AND (a.x <> b.x OR a.y <> b.y) WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2.5),
clq AS (SELECT x, y, x AS rx, y AS ry FROM close2 UNION SELECT q.x, q.y, c.bx, c.by FROM clq q JOIN close2 c ON c.x = q.rx AND c.y = q.ry),
grp AS MATERIALIZED (SELECT x, y, min((rx, ry)) AS g FROM clq GROUP BY x, y)"""
ORACLE = {
    "planar_faces": f"{FACES} SELECT n_edges, round(area, 3) AS area, round(perimeter, 3) AS perimeter, min_x, min_y, round(isoareal_index, 6) AS isoareal_index, round(isoperimetric_quotient, 6) AS isoperimetric_quotient FROM shape",
    "rook_adjacency": f"{FACES} SELECT {', '.join(f'round(f.{c}, 3) AS a_{c}' for c in KEY)}, {', '.join(f'round(n.{c}, 3) AS b_{c}' for c in KEY)} FROM adj JOIN face f ON f.face = focal JOIN face n ON n.face = neighbor",
    "artifact_fixpoint": f"{FACES}{GROWN} SELECT {KEYS}, art AS is_artifact FROM shape JOIN g12 USING (face)",
    "artifact_components": f"""{FACES}{GROWN},
      arts AS MATERIALIZED (SELECT face FROM g12 WHERE art), al AS MATERIALIZED (SELECT focal, neighbor FROM adj SEMI JOIN arts a ON a.face = focal SEMI JOIN arts b ON b.face = neighbor),
      cr AS (SELECT face, face AS r FROM arts UNION SELECT c.face, a.neighbor FROM cr c JOIN al a ON a.focal = c.r), comp AS (SELECT face, min(r) AS comp FROM cr GROUP BY face)
      SELECT {KEYS}, count(*) OVER (PARTITION BY comp) AS comp_size, CASE count(*) OVER (PARTITION BY comp) WHEN 1 THEN 'singleton' WHEN 2 THEN 'pair' ELSE 'cluster' END AS kind FROM comp JOIN shape USING (face)""",
    "face_kde": f"""{FACES}, st AS (SELECT count(*) AS n, min(fai) AS lo, max(fai) AS hi, stddev_samp(fai) * (count(*) * 0.75) ** (-0.2) AS band FROM shape),
      grid AS (SELECT k, lo + (hi - lo) * k / 999.0 AS place, n, band FROM st, range(1000) t(k))
      SELECT k, round(place, 6) AS place, round(sum(exp(-0.5 * ((place - fai) / band) ** 2)) / (any_value(n) * any_value(band) * sqrt(2 * {math.pi})), 6) AS density FROM grid, shape GROUP BY k, place""",
    "stroke_groups": f"""{W}{DEDUPED}{STROKES}
      SELECT l.street_id, coalesce(s.grp, l.street_id) AS coins_group, coalesce(n.n, 0) < 2 AS coins_end, round(sum(length) OVER (PARTITION BY coalesce(s.grp, l.street_id)), 3) AS coins_len, count(*) OVER (PARTITION BY coalesce(s.grp, l.street_id)) AS coins_count
      FROM slen l LEFT JOIN strk s ON s.id = l.street_id LEFT JOIN nlink n ON n.id = l.street_id""",
    "dangling_ends": f'{W}{FREE} SELECT * FROM free',
    "density_components": """WITH p AS (SELECT DISTINCT user_id * 8.0::DOUBLE AS x, (floor(value) * 4)::DOUBLE AS y FROM events), s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY x ORDER BY y) <= 5 THEN 0 ELSE 1 END AS new FROM p),
      r AS (SELECT x, y, sum(new) OVER (PARTITION BY x ORDER BY y) AS g FROM s)
      SELECT count(*) AS n, x AS min_x, min(y) AS min_y, x AS max_x, max(y) AS max_y FROM r GROUP BY x, g HAVING count(*) > 1""",
    "extend_rays": f"""{RAYS} SELECT street_id, "end", round(hx, 3) AS hx, round(hy, 3) AS hy FROM hit1""",
    "extended_total": f"""{RAYS} SELECT (SELECT count(*) FROM ends) AS n, round((SELECT sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) FROM segs) + (SELECT coalesce(sum(sqrt((hx - x) * (hx - x) + (hy - y) * (hy - y))), 0) FROM hit1) + (SELECT count(*) FROM free), 3) AS total_length""",
    "contained": f"""{FACES}, dead AS (
        SELECT p.fx, p.fy, p.lx, p.ly, (p.fx + p.lx) / 2 AS mx, (p.fy + p.ly) / 2 AS my FROM pieces p WHERE p.n_points = 2 AND CASE WHEN (fx, fy) < (lx, ly) THEN (fx, fy, lx, ly) ELSE (lx, ly, fx, fy) END NOT IN (SELECT e FROM e{ROUNDS})
      ) SELECT round(fx, 3) AS x1, round(fy, 3) AS y1, round(lx, 3) AS x2, round(ly, 3) AS y2 FROM dead d
      WHERE EXISTS (SELECT 1 FROM half h JOIN own o USING (h) SEMI JOIN face f ON f.face = o.face WHERE (h.sy > d.my) <> (h.ty > d.my) AND d.mx < (h.tx - h.sx) * (d.my - h.sy) / (h.ty - h.sy) + h.sx GROUP BY o.face HAVING count(*) % 2 = 1)""",
    "artifact_mask": f"""{FACES}{GROWN}, span AS (
        SELECT o.face, CASE WHEN tx = sx THEN CASE WHEN sx BETWEEN -50 AND 1000 THEN 0.0 ELSE 2.0 END ELSE greatest(0, least((-50 - sx) / (tx - sx), (1000 - sx) / (tx - sx))) END AS a, CASE WHEN tx = sx THEN 1.0 ELSE least(1, greatest((-50 - sx) / (tx - sx), (1000 - sx) / (tx - sx))) END AS b,
          CASE WHEN ty = sy THEN CASE WHEN sy BETWEEN -50 AND 1000 THEN 0.0 ELSE 2.0 END ELSE greatest(0, least((-50 - sy) / (ty - sy), (1000 - sy) / (ty - sy))) END AS c, CASE WHEN ty = sy THEN 1.0 ELSE least(1, greatest((-50 - sy) / (ty - sy), (1000 - sy) / (ty - sy))) END AS d
        FROM half JOIN own o USING (h)
      ) SELECT {KEYS} FROM shape JOIN g12 USING (face) WHERE art AND face NOT IN (SELECT face FROM span WHERE greatest(a, c) <= least(b, d))""",
    "close_gap_centroids": f"{W}{SHIFTED} SELECT count(*) AS n, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM grp GROUP BY g",
    "gaps_closed": f"""{W}{SHIFTED}, mid AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM grp GROUP BY g), tips2 AS (SELECT fx AS x, fy AS y FROM moved UNION ALL SELECT lx, ly FROM moved),
      put AS (SELECT coalesce(mx, t.x) AS x, coalesce(my, t.y) AS y FROM tips2 t LEFT JOIN grp USING (x, y) LEFT JOIN mid USING (g))
      SELECT count(DISTINCT (x, y)) AS n_nodes, round(sum(x), 2) AS sum_x FROM put""",
}
