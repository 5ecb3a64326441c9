"""Queries of the map's upkeep: covariances, features, guards, views, depth fits, landmarks, late results and windows over frames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomap.functions import math as m
from loomap.operators import fits, graph, shared, spatial
from loomap.plans.maps import BOXES, DIST, r6, renamed
from loomap.runtime import checkpoint_dir, written
from loomap.sources.scene import DETECTIONS_SQL, OBJECTS_SQL, detections, objects, redirects, table
from loomap.streaming import frames as st
from loomap.streaming import live

S, A = ("x", "y", "z"), ("a_x", "a_y", "a_z")
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- covariances


PACKED_SQL = "cv AS (SELECT *, vx AS cxx, 0.5*sqrt(vx*vy)*(CASE WHEN object_idx % 3 = 0 THEN 2.5 ELSE 1 END) AS cxy, -0.3*sqrt(vx*vz) AS cxz, vy AS cyy, 0.2*sqrt(vy*vz) AS cyz, vz AS czz FROM o)"


def covariances(o: DataFrame) -> DataFrame:
    """Objects with a packed covariance; every third isn't positive."""
    root = lambda p, q: F.sqrt(F.col(f"v{p}") * F.col(f"v{q}"))
    xy = 0.5 * root("x", "y") * F.when(F.col("object_idx") % 3 == 0, 2.5).otherwise(1.0)
    return o.withColumns({"cxx": F.col("vx"), "cxy": xy, "cxz": -0.3 * root("x", "z"), "cyy": F.col("vy"), "cyz": 0.2 * root("y", "z"), "czz": F.col("vz")})


C6 = tuple(f"c{p}" for p in fits.PACKED)
EIGEN = """e1 AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM {0}), e2 AS (SELECT *, sqrt((pow(cxx-q, 2)+pow(cyy-q, 2)+pow(czz-q, 2)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS s FROM e1),
 e3 AS (SELECT *, acos(greatest(-1, least(1, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz))/(s*s*s)/2)))/3 AS f FROM e2),
 e4 AS (SELECT *, q+2*s*cos(f) AS top, q+2*s*cos(f+2*pi()/3) AS low FROM e3)"""


@query(f"WITH {OBJECTS_SQL}, {PACKED_SQL}, {EIGEN.format('cv')} SELECT object_idx, round(top, 5) AS top, round(low, 5) AS low, round(cxx+greatest(0, 0.005-low), 5) AS cxx, round(cxy, 6) AS cxy, round(czz+greatest(0, 0.005-low), 5) AS czz FROM e4")
def x12_eigen_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances raised so that no eigenvalue is below a floor."""
    o = covariances(objects(spark, sf_dir))
    top, _, low = m.symmetric_eigenvalues(C6)
    up = m.eigen_floored(C6, 0.005)
    return o.select("object_idx", F.round(top, 5).alias("top"), F.round(low, 5).alias("low"), F.round(up[0], 5).alias("cxx"), r6(up[1]).alias("cxy"), F.round(up[5], 5).alias("czz"))


H2 = "(1-exp(ln(greatest(1e-300, d1))/4+ln(greatest(1e-300, d2))/4-ln(greatest(1e-300, ds))/2-mh/8))"
DET = "({0}xx*({0}yy*{0}zz-{0}yz*{0}yz)-{0}xy*({0}xy*{0}zz-{0}yz*{0}xz)+{0}xz*({0}xy*{0}yz-{0}yy*{0}xz))"
QUADRATIC = """(({0}yy*{0}zz-{0}yz*{0}yz)*dx*dx+({0}xx*{0}zz-{0}xz*{0}xz)*dy*dy+({0}xx*{0}yy-{0}xy*{0}xy)*dz*dz
 +2*(({0}xz*{0}yz-{0}xy*{0}zz)*dx*dy+({0}xy*{0}yz-{0}xz*{0}yy)*dx*dz+({0}xy*{0}xz-{0}xx*{0}yz)*dy*dz))"""


@query(f"""WITH {OBJECTS_SQL}, {PACKED_SQL}, t AS (SELECT i.object_idx AS i, j.object_idx AS j, i.x-j.x AS dx, i.y-j.y AS dy, i.z-j.z AS dz, {', '.join(f'i.c{p} AS a{p}, j.c{p} AS b{p}, (i.c{p}+j.c{p})/2 AS s{p}' for p in fits.PACKED)} FROM cv i, cv j
  WHERE i.object_idx < j.object_idx AND {DIST.format('i', 'j')} <= 1), u AS (SELECT i, j, {DET.format('a')} AS d1, {DET.format('b')} AS d2, {DET.format('s')} AS ds, {QUADRATIC.format('s')}/{DET.format('s')} AS mh FROM t)
 SELECT i, j, round(CASE WHEN d1 > 0 AND d2 > 0 AND ds > 0 THEN {H2} ELSE 1 END, 6) AS h2 FROM u""")
def j02_full_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours with the Hellinger distance of their full covariances."""
    o = covariances(objects(spark, sf_dir)).select("object_idx", *S, *C6)
    both = spatial.pairs_within(o, renamed(o, "a_"), 1.0).where("object_idx < a_object_idx")
    return both.select(F.col("object_idx").alias("i"), F.col("a_object_idx").alias("j"), r6(m.hellinger2(S, C6, A, [f"a_{k}" for k in C6])).alias("h2"))


@query(f"""WITH {OBJECTS_SQL}, {PACKED_SQL}, s AS (SELECT object_idx-object_idx % 10 AS id, count(*) AS n, {', '.join(f'sum({a}) AS s{a}' for a in 'xyz')}, {', '.join(f'sum(c{p}+{p[0]}*{p[1]}) AS q{p}' for p in fits.PACKED)} FROM cv WHERE object_idx % 10 <> 0 GROUP BY 1),
 f AS (SELECT object_idx AS id, weight+coalesce(n, 0) AS w, {', '.join(f'(weight*{a}+coalesce(s{a}, 0))/(weight+coalesce(n, 0)) AS m{a}' for a in 'xyz')}, {', '.join(f'(weight*(c{p}+{p[0]}*{p[1]})+coalesce(q{p}, 0))/(weight+coalesce(n, 0)) AS r{p}' for p in fits.PACKED)} FROM cv LEFT JOIN s ON s.id = object_idx WHERE object_idx % 10 = 0)
 SELECT id, w, {', '.join(f'round(m{a}, 6) AS m{a}' for a in 'xyz')}, {', '.join(f'round(r{p}-m{p[0]}*m{p[1]}, 6) AS c{p}' for p in fits.PACKED)} FROM f""")
def a01_full_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian fusion on full covariances: every tenth object takes in the nine after it."""
    o = covariances(objects(spark, sf_dir))
    row = [*[F.col(a).alias(f"m{a}") for a in S], *C6]
    base = o.where("object_idx % 10 = 0").select(F.col("object_idx").alias("id"), F.col("weight").alias("w"), *row)
    new = o.where("object_idx % 10 <> 0").select((F.col("object_idx") - F.col("object_idx") % 10).alias("id"), *row)
    out = fits.fused_gaussians_full(base, new)
    return out.select("id", "w", *[r6(F.col(k)).alias(k) for k in out.columns[2:]])


@query(f"""WITH {OBJECTS_SQL}, f AS (SELECT object_idx-object_idx % 10 AS id, unnest(feature) AS v, generate_subscripts(feature, 1)-1 AS k, CASE WHEN object_idx % 10 = 0 THEN weight ELSE 1 END AS w FROM o)
 SELECT id, k::INT AS k, round(sum(w*v)/sum(w), 6) AS value FROM f GROUP BY id, k""")
def a02_feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running mean of features: every tenth object takes in the nine after it."""
    o = objects(spark, sf_dir).withColumn("id", F.col("object_idx") - F.col("object_idx") % 10)
    mean = fits.mean_features(o, "id", F.when(F.col("object_idx") % 10 == 0, F.col("weight")).otherwise(1.0))
    return mean.select("id", F.posexplode("feature").alias("k", "value")).withColumn("value", r6(F.col("value")))


WINNERS = """r AS (SELECT object_idx AS loser, CASE WHEN object_idx % 22 = 0 AND object_idx + 11 IN (SELECT object_idx FROM o) THEN object_idx + 12 WHEN object_idx % 22 = 0 THEN object_idx + 11 ELSE object_idx + 1 END AS winner FROM o WHERE object_idx % 11 = 0),
 g AS (SELECT winner, loser FROM r UNION SELECT winner, winner FROM r)"""


@query(f"""WITH {OBJECTS_SQL}, {WINNERS}, f AS (SELECT winner, weight AS w, unnest(feature) AS v, generate_subscripts(feature, 1)-1 AS k FROM g JOIN o ON o.object_idx = loser)
 SELECT winner, k::INT AS k, round(sum(w), 6) AS weight, round(sum(w*v)/sum(w), 6) AS value FROM f GROUP BY winner, k""")
def a03_merged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of merged objects: means weighted by counts."""
    group = graph.resolve_redirects(redirects(spark, sf_dir)).select("winner", "loser")
    group = group.unionByName(group.select("winner", F.col("winner").alias("loser")).distinct())
    rows = group.join(objects(spark, sf_dir), F.col("loser") == F.col("object_idx"))
    mean = fits.mean_features(rows, "winner", F.col("weight"))
    return mean.select("winner", F.round("weight", 6).alias("weight"), F.posexplode("feature").alias("k", "value")).withColumn("value", r6(F.col("value")))


@query(f"""WITH {OBJECTS_SQL}, {WINNERS}, h AS (SELECT winner, loser, [loser*10, loser*10+1, loser*10+2] AS h FROM g JOIN o ON o.object_idx = loser)
 SELECT winner, array_to_string(flatten(list(h ORDER BY loser <> winner, loser)), ',') AS history FROM h GROUP BY winner""")
def a36_merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding histories of merged objects, the winner's first."""
    k = F.col("object_idx")
    o = objects(spark, sf_dir).select(k, F.array(k * 10, k * 10 + 1).alias("history"), (k * 10 + 2).alias("current"))
    done = fits.merged_history(o, graph.resolve_redirects(redirects(spark, sf_dir)))
    return done.select("winner", F.array_join("history", ",").alias("history"))


POINTS = "pt AS (SELECT l_suppkey AS face, l_partkey AS lm, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice/1000 AS y, l_discount*10 AS z, (l_linenumber % 3)::DOUBLE AS w FROM lineitem)"
STATS = f"""s AS (SELECT face, sum(w) AS n, {', '.join(f'sum(w*{a}) AS s{a}' for a in 'xyz')}, {', '.join(f'sum(w*{p[0]}*{p[1]}) AS q{p}' for p in fits.PACKED)} FROM pt GROUP BY face),
 t AS (SELECT face, n, {', '.join(f's{a}/greatest(n, 1) AS m{a}' for a in 'xyz')}, {', '.join(f'(q{p}-s{p[0]}*s{p[1]}/greatest(n, 1))/greatest(n-1, 1) AS c{p}' for p in fits.PACKED)} FROM s)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a face's points: face, lm, x, y, z and a weight."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_suppkey").alias("face"), F.col("l_partkey").alias("lm"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 10).alias("z"), (F.col("l_linenumber") % 3).cast("double").alias("w"))


@query(f"WITH {POINTS}, {STATS} SELECT face, n, {', '.join(f'round(m{a}, 5) AS m{a}' for a in 'xyz')}, {', '.join(f'round(c{p}, 4) AS c{p}' for p in fits.PACKED)} FROM t")
def a04_weighted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and sample covariance of each face's points."""
    out = fits.weighted_moments(points(spark, sf_dir), "face")
    return out.select("face", "n", *[F.round(f"m{a}", 5).alias(f"m{a}") for a in S], *[F.round(k, 4).alias(k) for k in C6])


@query(f"""WITH {POINTS}, {STATS}, d AS (SELECT pt.face, w, x-mx AS dx, y-my AS dy, z-mz AS dz, cxx+1e-4 AS cxx, cxy, cxz, cyy+1e-4 AS cyy, cyz, czz+1e-4 AS czz FROM pt JOIN t USING (face))
 SELECT face, count(*) AS n, count(*) FILTER (w > 0 AND {QUADRATIC.format('c')}/{DET.format('c')} <= 4.0) AS inliers FROM d GROUP BY face""")
def f14_mahalanobis_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a face's points lie within two deviations of its mean."""
    pts = points(spark, sf_dir)
    both = pts.join(fits.weighted_moments(pts, "face"), "face")
    good = (F.col("w") > 0) & (m.mahalanobis2(S, ("mx", "my", "mz"), C6) <= 4.0)
    return both.groupBy("face").agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("inliers"))


@query(f"""WITH {POINTS}, g AS (SELECT face, count(*) AS n, {', '.join(f'median({a}) AS m{a}' for a in 'xyz')}, {', '.join(f'covar_samp({p[0]}, {p[1]}){"+1e-4" if p[0] == p[1] else ""} AS c{p}' for p in fits.PACKED)} FROM pt GROUP BY face HAVING count(*) >= 5), {EIGEN.format('g')}
 SELECT face, n, {', '.join(f'round(m{a}, 8) AS m{a}' for a in 'xyz')}, round(cxy, 4) AS cxy, round(least(top, 2.25), 4) AS widest FROM e4""")
def a06_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's geometry from its points: medians, covariance with a ridge, eigenvalues capped."""
    return rewritten(spark, sf_dir).select("face", "n", *[F.round(f"m{a}", 8).alias(f"m{a}") for a in S], F.round("cxy", 4).alias("cxy"), F.round(F.least(m.symmetric_eigenvalues(C6)[0], F.lit(2.25)), 4).alias("widest"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    ridge = lambda p: F.lit(1e-4 if p[0] == p[1] else 0.0)
    g = points(spark, sf_dir).groupBy("face").agg(F.count("*").alias("n"), *[F.median(a).alias(f"m{a}") for a in S], *[(F.covar_samp(p[0], p[1]) + ridge(p)).alias(f"c{p}") for p in fits.PACKED])
    return g.where("n >= 5")


@query()
def a06_clipped_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same covariances with eigenvalues clipped to [1e-4, 1.5 squared], by a pandas function on batches of matrices."""
    clipped = fits.eigen_clipped(F.array(*C6), F.lit(1e-4), F.lit(2.25)).alias("c")
    return rewritten(spark, sf_dir).select("face", clipped).select("face", *[F.round(F.col("c")[k], 4).alias(n) for k, n in enumerate(C6)])


# --- guards, funnels


PROPOSED = f"""n AS (SELECT i.object_idx, min(j.object_idx) AS winner FROM o i, o j WHERE j.object_idx <= i.object_idx AND {DIST.format('i', 'j')} <= 0.9 GROUP BY 1),
 p AS (SELECT n.object_idx, CASE WHEN {DIST.format('i', 'j')} > 0.8 THEN n.object_idx ELSE winner END AS winner FROM n JOIN o i ON i.object_idx = n.object_idx JOIN o j ON j.object_idx = winner),
 bad AS (SELECT DISTINCT a.winner FROM p a JOIN p b ON a.winner = b.winner AND a.object_idx < b.object_idx AND (a.object_idx + b.object_idx) % 7 = 0 JOIN o i ON i.object_idx = a.object_idx JOIN o j ON j.object_idx = b.object_idx WHERE {DIST.format('i', 'j')} <= 1.6),
 p2 AS (SELECT object_idx, CASE WHEN winner IN (SELECT winner FROM bad) THEN object_idx ELSE winner END AS winner FROM p),
 v AS (SELECT winner FROM p2 JOIN b ON b.i = object_idx GROUP BY winner HAVING count(*) >= 2 AND (max(x2)-min(x1))*(max(y2)-min(y1))*(max(z2)-min(z1)) > 2.75*max((x2-x1)*(y2-y1)*(z2-z1)))"""


@query(f"WITH {OBJECTS_SQL}, {BOXES}, {PROPOSED} SELECT object_idx, CASE WHEN winner IN (SELECT winner FROM v) THEN object_idx ELSE winner END AS winner FROM p2")
def g02_merge_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed merges (into the least neighbour) after the guards of distance, of forbidden pairs and of growth."""
    o = objects(spark, sf_dir)
    at = o.select("object_idx", *S)
    pairs = lambda r: spatial.pairs_within(at, renamed(at, "a_"), r)
    winner = pairs(0.9).where("a_object_idx <= object_idx").groupBy("object_idx").agg(F.min("a_object_idx").alias("winner"))
    end = renamed(at, "a_").withColumnRenamed("a_object_idx", "winner")
    proposed = winner.join(o.select("object_idx", *S, "vx", "vy", "vz"), "object_idx").join(end, "winner")
    proposed = proposed.select("object_idx", "winner", m.distance(S, A).alias("d"), *fits.box_of(S, ("vx", "vy", "vz")))
    cannot = pairs(1.6).where("object_idx < a_object_idx and (object_idx + a_object_idx) % 7 = 0").select(F.col("object_idx").alias("a"), F.col("a_object_idx").alias("b"))
    return fits.guarded_winners(proposed, cannot, 0.8)


@query(f"""WITH {OBJECTS_SQL}, {PACKED_SQL}, k AS (SELECT i.object_idx, count(j.object_idx) AS n FROM o i LEFT JOIN o j ON i.object_idx <> j.object_idx AND {DIST.format('i', 'j')} <= 0.8 GROUP BY 1)
 SELECT CASE WHEN n >= 3 THEN '3+' ELSE n::VARCHAR END AS neighbours, count(*) AS objects, count(*) FILTER ({DET.format('c')} <= 0) AS indefinite FROM k JOIN cv USING (object_idx) GROUP BY 1""")
def a30_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects have no, one, two or more neighbours, and how many of them a covariance that isn't positive."""
    o = covariances(objects(spark, sf_dir))
    at = o.select("object_idx", *S)
    n = spatial.pairs_within(at, renamed(at, "a_"), 0.8).where("object_idx <> a_object_idx").groupBy("object_idx").agg(F.count("*").alias("n"))
    both = o.join(n, "object_idx", "left").fillna({"n": 0})
    label = F.when(F.col("n") >= 3, "3+").otherwise(F.col("n").cast("string"))
    return both.groupBy(label.alias("neighbours")).agg(F.count("*").alias("objects"), F.count(F.when(m.det3(C6) <= 0, 1)).alias("indefinite"))


# --- views


VIEWS = f"{DETECTIONS_SQL}, w AS (SELECT *, score AS p, pixels/1000.0 AS q, (day+1)::DOUBLE AS r FROM det)"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.withColumns({"p": F.col("score"), "q": F.col("pixels") / 1000, "r": (F.col("day") + 1).cast("double")})


@query(f"""WITH {VIEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY pixels DESC, det) AS n FROM w), c AS (SELECT b.object, b.det, (a.p*b.p+a.q*b.q+a.r*b.r)/(sqrt(a.p*a.p+a.q*a.q+a.r*a.r)*sqrt(b.p*b.p+b.q*b.q+b.r*b.r)) AS cos FROM k a JOIN k b ON a.object = b.object AND a.n = 1 AND b.n > 1),
 s AS (SELECT object, det, row_number() OVER (PARTITION BY object ORDER BY round(cos, 9), det) AS n FROM c) SELECT k.object, k.det AS first, s.det AS second FROM k LEFT JOIN s ON s.object = k.object AND s.n = 1 WHERE k.n = 1""")
def a35_w11_two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two views that stand for an object: the largest, and the one least like it."""
    return fits.two_views(views(spark, sf_dir), "object", "det", "pixels", ("p", "q", "r"))


@query(f"""WITH {DETECTIONS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY pixels DESC, det) AS n, count(*) OVER (PARTITION BY object) AS c FROM det)
 SELECT object, max(CASE WHEN n = 1 THEN det END) AS largest, max(CASE WHEN n = c // 2 + 1 THEN det END) AS middle, string_agg(CASE WHEN n <= 3 THEN det::VARCHAR END, ',' ORDER BY n) AS top3 FROM k GROUP BY object""")
def w08_view_pickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's largest view, its middle one, and the three largest."""
    by = Window.partitionBy("object")
    k = detections(spark, sf_dir).select("object", "det", F.row_number().over(by.orderBy(F.desc("pixels"), "det")).alias("n"), F.count("*").over(by).alias("c"))
    at = lambda i: F.max(F.when(F.col("n") == i, F.col("det")))
    return k.groupBy("object").agg(at(1).alias("largest"), at(F.floor(F.col("c") / 2) + 1).alias("middle"), F.concat_ws(",", at(1).cast("string"), at(2).cast("string"), at(3).cast("string")).alias("top3"))


@query(f"""WITH {DETECTIONS_SQL}, k AS (SELECT object, det, row_number() OVER (PARTITION BY object ORDER BY abs(day-15), det) AS n, score*sqrt(greatest(1, pixels)) >= 100 AS hq FROM det),
 s AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY md5('7/' || det::VARCHAR), det) AS r FROM k WHERE n > 2 AND hq) SELECT object, det, 'near' AS why FROM k WHERE n <= 2 UNION ALL SELECT object, det, 'drawn' FROM s WHERE r <= 2""")
def w09_viewpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's viewpoints: the two nearest, and two drawn from the other good ones."""
    d = detections(spark, sf_dir)
    k = d.withColumn("n", F.row_number().over(Window.partitionBy("object").orderBy(F.abs(F.col("day") - 15), "det")))
    drawn = fits.capped_sample(k.where((F.col("n") > 2) & (m.view_quality("score", "pixels") >= 100)), "object", "det", 2, 7)
    row = lambda df, why: df.select("object", "det", F.lit(why).alias("why"))
    return row(k.where("n <= 2"), "near").unionByName(row(drawn, "drawn"))


@query(f"""WITH {DETECTIONS_SQL}, k AS (SELECT day, det, row_number() OVER (PARTITION BY day ORDER BY md5('3/' || det::VARCHAR), det) AS r FROM det) SELECT day, det, row_number() OVER (PARTITION BY day ORDER BY det)::INT AS place FROM k WHERE r <= 20""")
def f20_a33_frame_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twenty frames of a scene by a seeded draw, then in order."""
    kept = fits.capped_sample(detections(spark, sf_dir), "day", "det", 20, 3)
    return kept.select("day", "det", F.row_number().over(Window.partitionBy("day").orderBy("det")).alias("place"))


IMAGE8 = f"{DETECTIONS_SQL}, e AS (SELECT *, det // 8 AS image, score AS s, (det % 50)/10.0 AS pos FROM det)"


@query(f"""WITH {IMAGE8}, c AS (SELECT DISTINCT object, image FROM e), b AS (SELECT object, avg(pos) AS pos, avg(score) AS f, min(class) AS cls FROM e GROUP BY object),
 t AS (SELECT c.object, d.det, abs(d.pos-b.pos) AS dist, 1-abs(d.score-b.f)/(1+b.f) AS sim, d.score*sqrt(greatest(1, d.pixels)) AS q, d.class = b.cls AS same FROM c JOIN e d USING (image) JOIN b ON b.object = c.object WHERE abs(d.pos-b.pos) <= 4),
 r AS (SELECT *, q*(0.55+0.45*greatest(0, sim))+CASE WHEN same THEN 0.15*q ELSE 0 END-0.05*dist AS rank FROM t WHERE sim >= 0.35),
 k AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY round(rank, 6) DESC, det) AS n, row_number() OVER (PARTITION BY object ORDER BY round(sim, 9) DESC, det) AS m FROM r)
 SELECT object, max(CASE WHEN n = 1 THEN det END) AS best_view, max(CASE WHEN m = 1 THEN det END) AS likest, round(max(rank), 4) AS rank FROM k GROUP BY object""")
def j09_j10_best_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's supporting detection and best view: of all detections in the images that show it, near enough, the likest, and the best by quality, likeness, class and distance."""
    e = detections(spark, sf_dir).withColumns({"image": F.floor(F.col("det") / 8), "pos": F.col("det") % 50 / 10})
    b = e.groupBy("object").agg(F.avg("pos").alias("o_pos"), F.avg("score").alias("o_f"), F.min("class").alias("o_class"))
    shown = e.select("object", "image").distinct().join(b, "object")
    t = shown.join(e.drop("object"), "image")
    dist, sim = F.abs(F.col("pos") - F.col("o_pos")), 1 - F.abs(F.col("score") - F.col("o_f")) / (1 + F.col("o_f"))
    q = m.view_quality("score", "pixels")
    rank = q * (0.55 + 0.45 * F.greatest(F.lit(0.0), sim)) + F.when(F.col("class") == F.col("o_class"), 0.15 * q).otherwise(0.0) - 0.05 * dist
    t = t.where((dist <= 4) & (sim >= 0.35)).select("object", "det", rank.alias("rank"), sim.alias("sim"))
    best = lambda by: F.max_by("det", F.struct(by, -F.col("det")))
    return t.groupBy("object").agg(best(F.round("rank", 6)).alias("best_view"), best(F.round("sim", 9)).alias("likest"), F.round(F.max("rank"), 4).alias("rank"))


@query("""WITH cam AS (SELECT n_nationkey AS face, (n_nationkey-12)*0.4 AS px, -6+(n_nationkey % 5)*0.5 AS py, (n_nationkey % 3-1)*0.3 AS pz FROM nation), o AS (SELECT vec_id AS object_idx, 10*embedding[1]::DOUBLE AS x, 10*embedding[2]::DOUBLE AS y, 10*embedding[3]::DOUBLE AS z FROM embeddings),
 v AS (SELECT object_idx, face, x-px AS a, pz-z AS b, y-py AS z FROM o, cam), u AS (SELECT *, round_even(100*a/z+64, 0)::INT AS u, round_even(100*b/z+48, 0)::INT AS w FROM v WHERE z > 0.01 AND a*a+b*b+z*z < 900),
 m AS (SELECT *, z*(1+((object_idx+face) % 9-4)*0.02) AS depth FROM u WHERE u BETWEEN 0 AND 127 AND w BETWEEN 0 AND 95) SELECT object_idx, face, u, w AS v FROM m WHERE depth > 0 AND abs(z-depth) < greatest(0.15, 0.05*z) AND (u // 16 + w // 16) % 2 = 0""")
def j11_f15_points_in_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a face's mask: projected, inside the image, not hidden (by its depth map), and on the mask (a chessboard here)."""
    k = F.col("n_nationkey")
    faces = table(spark, sf_dir, "nation").select(k.alias("face"), ((k - 12) * 0.4).alias("px"), (k % 5 * 0.5 - 6).alias("py"), ((k % 3 - 1) * 0.3).alias("pz"))  # a scene's faces
    x = objects(spark, sf_dir).select("object_idx", *S).join(F.broadcast(faces))
    a, b, z = F.col("x") - F.col("px"), F.col("pz") - F.col("z"), F.col("y") - F.col("py")
    x = x.select("object_idx", "face", a.alias("a"), b.alias("b"), z.alias("d")).where("d > 0.01 and a*a + b*b + d*d < 900")
    u, v = m.pinhole(("a", "b", "d"), 100.0, 100.0, 64.0, 48.0)
    x = x.withColumns({"u": u.cast("int"), "v": v.cast("int"), "depth": F.col("d") * (1 + ((F.col("object_idx") + F.col("face")) % 9 - 4) * 0.02)})
    on = (F.floor(F.col("u") / 16) + F.floor(F.col("v") / 16)) % 2 == 0
    return x.where(F.col("u").between(0, 127) & F.col("v").between(0, 95) & fits.visible(F.col("d"), F.col("depth")) & on).select("object_idx", "face", "u", "v")


@query("""WITH e AS (SELECT event_id, (event_id % 640)::DOUBLE AS x1, (event_id % 480)::DOUBLE AS y1, least(640, event_id % 640+(event_id % 97)+1)::DOUBLE AS x2, least(480, event_id % 480+(event_id % 89)+1)::DOUBLE AS y2 FROM events)
 SELECT event_id, round(greatest(0, least(1, least(x1, y1, 640-x2, 480-y2)/24.0)), 6) AS edge, ((x1 <= 1)::INT+(y1 <= 1)::INT+(x2 >= 639)::INT+(y2 >= 479)::INT)/4.0::DOUBLE AS touch FROM e""")
def x28_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a box is from its image's border, and how many of its edges touch it."""
    k = F.col("event_id")
    box = [(k % 640).cast("double"), (k % 480).cast("double"), F.least(F.lit(640), k % 640 + k % 97 + 1).cast("double"), F.least(F.lit(480), k % 480 + k % 89 + 1).cast("double")]
    return table(spark, sf_dir, "events").select("event_id", r6(m.bbox_edge_score(*box, 640, 480)).alias("edge"), m.edge_touch(*box, 640, 480).alias("touch"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 640 AS u, l_suppkey % 480 AS v, l_quantity AS depth, l_discount AS conf, (l_orderkey % 256) AS r, (l_partkey % 256) AS g, (l_orderkey % 200+56) AS b FROM lineitem),
 k AS (SELECT *, greatest(r, g, b)::DOUBLE AS hi, least(r, g, b)::DOUBLE AS lo FROM p WHERE u % 4 = 0 AND v % 4 = 0 AND depth > 0 AND depth <= 40 AND conf >= 0.02)
 SELECT l_orderkey, l_linenumber, round((u-320)/500.0*depth, 5) AS px, round((v-240)/500.0*depth, 5) AS py, depth AS pz FROM k WHERE NOT (v < 0.65*480 AND hi >= 160 AND 255*(hi-lo)/hi <= 80)""")
def x35_unprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth pixel as a point, without unsure ones and sky."""
    line = table(spark, sf_dir, "lineitem")
    px = line.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 640).alias("u"), (F.col("l_suppkey") % 480).alias("v"), F.col("l_quantity").alias("depth"), F.col("l_discount").alias("conf"), (F.col("l_orderkey") % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_orderkey") % 200 + 56).alias("b"))
    out = fits.unprojected(px, 500.0, 500.0, 320.0, 240.0, 4, 40.0, 0.02, 480)
    return out.select("l_orderkey", "l_linenumber", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"), "pz")


# --- depth, landmarks


def lsq_sql(rounds: int) -> str:
    """The rounds of the fit, one after another."""
    out = ["f0 AS (SELECT face, l_extendedprice/1000 AS m, l_quantity AS s, 0.05+l_discount AS w, true AS keep FROM lineitem WHERE l_quantity > 1e-6 AND l_extendedprice > 1e-3)".replace("SELECT face", "SELECT l_suppkey AS face")]
    for k in range(rounds):
        out.append(f"a{k} AS (SELECT face, sum(w*m*s) FILTER (keep)/sum(w*s*s) FILTER (keep) AS alpha FROM f{k} GROUP BY face), r{k} AS (SELECT f.*, a.alpha, abs(m-a.alpha*s) AS r FROM (SELECT face, m, s, w, keep FROM f{k}) f JOIN a{k} a USING (face)), h{k} AS (SELECT face, median(r) FILTER (keep) AS md FROM r{k} GROUP BY face), f{k + 1} AS (SELECT r.face, m, s, w, r.r <= greatest(2*md, 1e-6) AS keep, alpha FROM r{k} r JOIN h{k} USING (face))")
    return ", ".join(out)


@query(f"WITH {lsq_sql(3)} SELECT face, round(any_value(alpha), 6) AS alpha, count(*) FILTER (keep) AS n_inliers, count(*) AS n_total, count(*) FILTER (keep) >= 8 AS ok FROM f3 GROUP BY face HAVING count(*) >= 8")
def a28_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each face's scale by weighted least squares through the origin, three rounds without what is over twice the median residual."""
    line = table(spark, sf_dir, "lineitem")
    pairs = line.select(F.col("l_suppkey").alias("face"), (F.col("l_extendedprice") / 1000).alias("metric"), F.col("l_quantity").alias("sparse"), (0.05 + F.col("l_discount")).alias("w"))
    return fits.scale_fit(pairs, "face").where("n_total >= 8").withColumn("alpha", r6(F.col("alpha")))


@query(f"""WITH {POINTS}, t AS (SELECT lm, count(DISTINCT face) AS track FROM pt GROUP BY lm) SELECT face, count(*) AS n, round(avg(x), 6) AS depth FROM pt JOIN t USING (lm) WHERE track >= 3 AND z <= 4 AND x > 1e-6 GROUP BY face""")
def f17_j25_sparse_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face's anchors: its landmarks that at least three faces see, with a small error, before the camera."""
    pts = points(spark, sf_dir)
    track = pts.select("lm", "face").distinct().groupBy("lm").agg(F.count("*").alias("track"))
    good = pts.join(track, "lm").where("track >= 3 and z <= 4 and x > 1e-6")
    return good.groupBy("face").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("depth"))


@query("""WITH c AS (SELECT l_orderkey AS ray, l_linenumber AS face, l_quantity AS depth, l_discount AS conf, l_tax AS away, l_partkey AS pk FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY away, face, pk) AS n, row_number() OVER (PARTITION BY ray ORDER BY conf DESC, face, pk) AS m FROM c)
 SELECT ray, max(CASE WHEN n = 1 THEN depth END) AS nearest, max(CASE WHEN m = 1 THEN depth END) AS surest, round(CASE WHEN sum(conf) <= 1e-12 THEN avg(depth) ELSE sum(conf*depth)/sum(conf) END, 6) AS blended FROM k GROUP BY ray""")
def a38_depth_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ray's depth from the faces that cover it: of the nearest axis, of the surest, and blended by confidence."""
    line = table(spark, sf_dir, "lineitem")
    blend = F.when(F.sum("l_discount") <= 1e-12, F.avg("l_quantity")).otherwise(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_discount"))
    nearest = F.min_by("l_quantity", F.struct("l_tax", "l_linenumber", "l_partkey"))
    surest = F.min_by("l_quantity", F.struct(-F.col("l_discount"), F.col("l_linenumber"), F.col("l_partkey")))
    return line.groupBy(F.col("l_orderkey").alias("ray")).agg(nearest.alias("nearest"), surest.alias("surest"), r6(blend).alias("blended"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS kf, l_partkey AS lm FROM lineitem), n AS (SELECT lm, count(*) AS n FROM s GROUP BY lm), d AS (SELECT l_suppkey AS kf, quantile_disc(l_quantity, 0.5) AS depth FROM lineitem GROUP BY 1)
 SELECT kf, depth, count(*) FILTER (n >= 3) AS tracked FROM s JOIN n USING (lm) JOIN d USING (kf) GROUP BY kf, depth""")
def a40_keyframe_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyframe's median depth, and how many of its landmarks three keyframes see."""
    line = table(spark, sf_dir, "lineitem")
    depth = line.groupBy(F.col("l_suppkey").alias("kf")).agg(F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("depth"))
    return depth.join(fits.tracked_landmarks(line.select(F.col("l_suppkey").alias("kf"), F.col("l_partkey").alias("lm")).distinct(), 3), "kf")


@query("""WITH f AS (SELECT *, lag(ts) OVER w AS t0, lag(value) OVER w AS v0, lag(event_id % 200) OVER w AS ref, row_number() OVER w - 1 AS kfs FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT event_id, epoch_us(ts)/1e6-epoch_us(t0)/1e6 AS el, abs(value-v0) AS way, event_id % 60 AS tracked, event_id % 200 AS rel, ref, kfs FROM f WHERE t0 IS NOT NULL)
 SELECT event_id, (el >= 86400 OR way > 3 OR rel < ref*0.5 OR rel < 100) AND (kfs <= 5 OR el >= 3600) AND tracked >= 15 AND NOT rel > ref*0.9 AS needed FROM g""")
def f19_keyframe_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames become keyframes, each judged against the one before it of its camera."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    f = table(spark, sf_dir, "events").select("event_id", (at - F.lag(at).over(by)).alias("el"), F.abs(F.col("value") - F.lag("value").over(by)).alias("way"), (k % 60).alias("tracked"), (k % 200).alias("rel"), F.lag(k % 200).over(by).alias("ref"), (F.row_number().over(by) - 1).alias("kfs"))
    c = F.col
    return f.where("el is not null").select("event_id", fits.keyframe_needed(c("el"), c("way"), c("tracked"), c("rel"), c("ref"), c("kfs"), 86400.0, 3600.0, 3.0).alias("needed"))


@query("""WITH v AS (SELECT l_partkey AS segment, l_quantity AS x, l_discount AS y FROM lineitem) SELECT p_brand || '-' || p_size AS instance, count(*) AS n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM v JOIN part ON p_partkey = segment GROUP BY 1""")
def a37_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances from groups of segments: the box and the number of their vertices."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    i = v.join(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("instance")), "p_partkey")
    return i.groupBy("instance").agg(F.count("*").alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))


@query("""WITH d AS (SELECT p_partkey AS id, p_partkey // 40 AS node, (p_partkey*2654435761) % 4294967296 AS code FROM part), h AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.code, b.code)) AS dist FROM d a JOIN d b ON a.node = b.node AND a.id % 2 = 0 AND b.id % 2 = 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS n, lead(dist) OVER (PARTITION BY a ORDER BY dist, b) AS nxt FROM h) SELECT a, b, dist::INT AS dist FROM k WHERE n = 1 AND dist <= 14 AND (nxt IS NULL OR dist < 0.9*nxt)""")
def j31_descriptor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of two frames matched within a word of the vocabulary: the nearest by Hamming distance, if clearly nearer than the second."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 40).alias("node"), (k * F.lit(2654435761) % F.lit(4294967296)).alias("code"))
    other = d.where("id % 2 = 1").select(F.col("id").alias("b"), "node", F.col("code").alias("code_b"))
    h = d.where("id % 2 = 0").join(other, "node").select(F.col("id").alias("a"), "b", F.bit_count(F.col("code").bitwiseXOR(F.col("code_b"))).alias("dist"))
    by = Window.partitionBy("a").orderBy("dist", "b")
    h = h.withColumns({"n": F.row_number().over(by), "nxt": F.lead("dist").over(by)})
    return h.where("n = 1 and dist <= 14 and (nxt is null or dist < 0.9 * nxt)").select("a", "b", "dist")


def _met_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the keyframes b that are like a (each row's arrays, ascending) those that the keyframe before met within two."""
    for batch in batches:
        out = []
        for a, b, n, met in zip(batch.column(0).to_numpy().tolist(), *[[x.values.to_numpy(zero_copy_only=False) for x in batch.column(k)] for k in (1, 2, 3)], strict=True):
            at = np.minimum(np.searchsorted(met, b - 2), len(met) - 1)
            stay = abs(met[at] - b) <= 2
            out.append((np.full(stay.sum(), a), b[stay], n[stay]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["a", "b", "common"])


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS kf, l_partkey AS w FROM lineitem), c AS (SELECT a.kf AS a, b.kf AS b, count(*) AS n FROM s a JOIN s b ON a.w = b.w AND a.kf <> b.kf GROUP BY ALL), l AS (SELECT a, min(n) AS least FROM c WHERE abs(a-b) <= 3 GROUP BY a),
 k AS (SELECT c.a, c.b, c.n FROM c JOIN l USING (a) WHERE abs(c.a-c.b) > 10 AND c.n >= l.least) SELECT DISTINCT k.a, k.b, k.n AS common FROM k JOIN k p ON p.a = k.a-1 AND abs(p.b-k.b) <= 2""")
def j32_loop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loop candidates: keyframes as alike as the least alike neighbour, not near on the path, that the keyframe before met too (within two)."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("kf"), F.col("l_partkey").alias("w")).distinct()

    def alike(a: int, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        near = (b != a) & (abs(b - a) <= 3)
        return (abs(b - a) > 10) & (n >= n[near].min()) if near.any() else np.zeros(len(b), bool)

    k = written(shared.counts(s, "kf", "w", alike).select(F.col("kf").alias("a"), F.col("others").alias("b"), F.col("common").alias("n")))
    before = k.select((F.col("a") + 1).alias("a"), F.col("b").alias("met"))
    return k.join(before, "a").mapInArrow(_met_before, "a long, b long, common long")


# --- frames in order


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT event_id, i AS last_window, greatest(0, i-3) AS first_window, round(value*(1+0.01*(i % 5)), 6) AS value FROM e""")
def st07_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four frames, one apart: the last that holds a frame has the last word."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    w = st.windows(e, "user_id", ["ts", "event_id"], 4, 3)
    w = w.withColumn("value", F.col("value") * (1 + 0.01 * (F.col("window") % 5)))  # what a window says of the frame
    out = st.last_word(w, ["event_id"], "window", ["value"])
    first = w.groupBy("event_id").agg(F.min("window").alias("first_window"))
    return out.join(first, "event_id").select("event_id", F.col("window").alias("last_window"), "first_window", r6(F.col("value")).alias("value"))


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i FROM events) SELECT user_id, count(*) AS frames, count(*) FILTER (i % 3 = 0) AS kept, round((greatest(0, count(*) FILTER (i % 3 = 0)-2))/greatest(1, max(CASE WHEN i % 3 = 0 THEN i END)/10.0+0.25-0.6), 4) AS fps FROM e GROUP BY user_id""")
def st05_load_shedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at 10 a second that take 0.25 seconds each: which are skipped as the work is behind, and the rate after two frames of warm-up."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return st.shed(e, "user_id", ["ts", "event_id"], 10.0, 0.25, 2)


@query(f"""WITH {OBJECTS_SQL}, r AS (SELECT object_idx AS loser, CASE WHEN object_idx % 22 = 0 AND object_idx + 11 IN (SELECT object_idx FROM o) THEN object_idx + 12 WHEN object_idx % 22 = 0 THEN object_idx + 11 ELSE object_idx + 1 END AS winner FROM o WHERE object_idx % 11 = 0),
 c AS (SELECT event_id, ts, event_type || event_id AS caption, event_id % (SELECT count(*) FROM o) AS object_idx FROM events), t AS (SELECT c.*, coalesce(winner, c.object_idx) AS target FROM c LEFT JOIN r ON r.loser = c.object_idx),
 k AS (SELECT t.*, row_number() OVER (PARTITION BY target ORDER BY ts DESC, event_id DESC) AS n FROM t JOIN o ON o.object_idx = target WHERE o.active AND target % 17 <> 0) SELECT target AS object_idx, event_id, caption FROM k WHERE n = 1""")
def st04_late_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that come after their object was merged go to its winner; locked and inactive ones are left alone; the latest counts."""
    o = objects(spark, sf_dir)
    n = o.count()
    c = table(spark, sf_dir, "events").select("event_id", "ts", F.concat("event_type", F.col("event_id").cast("string")).alias("caption"), (F.col("event_id") % n).alias("object_idx"))
    states = o.select("object_idx", "active", (F.col("object_idx") % 17 == 0).alias("locked"))
    return st.late_results(c, states, redirects(spark, sf_dir), ["ts", "event_id"]).select("object_idx", "event_id", "caption")


@query("""WITH k AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn)-1 AS i FROM conversations) SELECT conv_id, turn, turn % 3 = 0 AS captions, turn % 5 = 0 AND turn > 0 AS regions, turn % 2 = 1 AS checkpoint FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn < 2)""")
def st08_st09_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due at which step, for the steps that aren't done yet."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    done = c.where("conv_id % 4 = 0 and turn < 2")
    t = st.remaining(c, done, ["conv_id", "turn"])
    return t.select("conv_id", "turn", st.due("turn", 3).alias("captions"), (st.due("turn", 5) & (F.col("turn") > 0)).alias("regions"), st.due("turn", 2, 1).alias("checkpoint"))


# --- the map as keyed state


@query("""WITH e AS (SELECT 'scene' || user_id % 8 AS scene, user_id AS track, event_id AS seq, epoch_ms(ts) AS ms, event_type = 'error' AS gone, value AS x, (event_id % 97)::DOUBLE AS y, (event_id % 5 + 1)::DOUBLE AS weight FROM events),
 g AS (SELECT *, coalesce(sum(gone::INT) OVER (PARTITION BY track ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM e),
 k AS (SELECT scene, track, gen, min(struct_pack(a := ms, b := seq)) FILTER (NOT gone) AS born, sum(x*weight) FILTER (NOT gone) AS x, sum(y*weight) FILTER (NOT gone) AS y, sum(weight) FILTER (NOT gone) AS weight, count(*) FILTER (NOT gone) AS n, bool_or(gone) AS gone FROM g GROUP BY ALL)
 SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY born)-1 AS object_idx, round(x, 3) AS x_moment, round(y, 3) AS y_moment, round(weight, 3) AS weight, n, NOT gone AS active FROM k WHERE n > 0""")
def st01_st03_live_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of tracks in eight scenes, an error ends a track's object: the stream's map after all of them, compacted."""
    e = table(spark, sf_dir, "events")
    seen = e.select(F.concat(F.lit("scene"), F.col("user_id") % 8).alias("scene"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", "gone").otherwise("seen").alias("kind"), F.col("user_id").cast("string").alias("track"), F.lit(None).cast("string").alias("other"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"), F.lit(0.0).alias("z"), (F.col("event_id") % 5 + 1).cast("double").alias("weight"))
    last = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit("end").alias("scene"), F.lit(-1).cast("long").alias("seq"), "ts", F.lit("end").alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("track", "string"), ("other", "string"), ("x", "double"), ("y", "double"), ("z", "double"), ("weight", "double"))])
    source = written(seen.unionByName(last))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(live.EVENTS).parquet(source._written_at)
    live.start(stream, f"{folder}/map", f"{folder}/progress", "1 hour").awaitTermination()
    live.compact(spark, f"{folder}/map")
    moment = lambda c: F.round(F.col(c) * F.col("weight"), 3).alias(f"{c}_moment")  # noqa: E731  has two places
    return live.objects(spark, f"{folder}/map").select("scene", "object_idx", moment("x"), moment("y"), F.round("weight", 3).alias("weight"), "n", "active")
