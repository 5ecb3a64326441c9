"""Queries of joins, aggregates, windows, set operations and graphs over the object map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomap.functions import math as m
from loomap.operators import aggregates as ag
from loomap.operators import graph, similar, spatial
from loomap.operators import predicates as p
from loomap.sources.scene import DETECTIONS_SQL, OBJECTS_SQL, anchors, detections, object_images, objects, table

S, A = ("x", "y", "z"), ("a_x", "a_y", "a_z")
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c.cast("double"), 6)


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


DIST = "sqrt(({0}.x-{1}.x)*({0}.x-{1}.x)+({0}.y-{1}.y)*({0}.y-{1}.y)+({0}.z-{1}.z)*({0}.z-{1}.z))"


@query(f"WITH {OBJECTS_SQL} SELECT i.object_idx AS i, j.object_idx AS j, round({DIST.format('i', 'j')}, 6) AS d FROM o i, o j WHERE i.object_idx < j.object_idx AND {DIST.format('i', 'j')} <= 0.8")
def g06_close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the cluster graph: objects within a radius, through the grid."""
    o = objects(spark, sf_dir).select("object_idx", *S)
    return spatial.pairs_within(o, renamed(o, "a_"), 0.8).where("object_idx < a_object_idx").select(F.col("object_idx").alias("i"), F.col("a_object_idx").alias("j"), r6(F.col("d")).alias("d"))


@query(
    f"""WITH RECURSIVE {OBJECTS_SQL}, e AS (SELECT i.object_idx AS a, j.object_idx AS b FROM o i, o j WHERE {DIST.format('i', 'j')} <= 0.8),
 w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT a AS object_idx, min(b) AS cluster FROM w GROUP BY a"""
)
def g06_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the close pairs; the least object names a cluster."""
    o = objects(spark, sf_dir).select("object_idx", *S)
    found = spatial.linked_within(o, 0.8)
    return o.select("object_idx").join(found, F.col("object_idx") == F.col("node"), "left").select("object_idx", F.coalesce("root", "object_idx").alias("cluster"))


HELL = """(1-exp(ln(i.vx*i.vy*i.vz)/4+ln(j.vx*j.vy*j.vz)/4-ln((i.vx+j.vx)/2*(i.vy+j.vy)/2*(i.vz+j.vz)/2)/2
 -((i.x-j.x)*(i.x-j.x)/((i.vx+j.vx)/2)+(i.y-j.y)*(i.y-j.y)/((i.vy+j.vy)/2)+(i.z-j.z)*(i.z-j.z)/((i.vz+j.vz)/2))/8))"""


@query(f"WITH {OBJECTS_SQL} SELECT i.object_idx AS i, j.object_idx AS j, round({HELL}, 6) AS h2 FROM o i, o j WHERE i.object_idx <> j.object_idx AND {DIST.format('i', 'j')} <= 2 AND (i.class_id = j.class_id OR i.class_id < 0) AND j.active AND list_cosine_similarity(i.feature, j.feature) > 0.15 AND {HELL} < 0.95")
def j01_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association: similar features, one class, overlapping Gaussians; blocked by class, all products of two blocks at once."""
    o = objects(spark, sf_dir)
    keep = [*S, "vx", "vy", "vz"]
    right = o.where("active").withColumn("grp", F.coalesce(F.col("class_id").cast("string"), F.lit("none")))
    left = o.where("class_id >= 0").withColumn("grp", F.col("class_id").cast("string"))
    left = left.unionByName(o.where("class_id < 0").join(right.select("grp").distinct()))  # an unknown class goes with all
    near = similar.alike_within(left, right, keep, 0.15, 2.0, most=0.95).where("object_idx <> a_object_idx")
    return near.select(F.col("object_idx").alias("i"), F.col("a_object_idx").alias("j"), (F.rint(F.col("h2") * 1e6) / 1e6 + 0.0).alias("h2"))


@query(f"""WITH {OBJECTS_SQL}, s AS (SELECT o.object_idx, a.object_idx AS a_object_idx, CASE WHEN {DIST.format('o', 'a')} > 5 THEN 0 ELSE exp(-pow({DIST.format('o', 'a')}, 2)/(2*0.5*0.5)) END AS score FROM o, o a WHERE a.object_idx % 100 = 0 AND a.object_idx <> o.object_idx),
 k AS (SELECT *, row_number() OVER (PARTITION BY object_idx ORDER BY round(score, 9) DESC, a_object_idx) AS n FROM s) SELECT object_idx, a_object_idx AS anchor, round(score, 6) AS score FROM k WHERE n = 1""")
def j04_best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each object the anchor that satisfies Near best; ties keep the earlier anchor."""
    o = objects(spark, sf_dir).select("object_idx", *S)
    x = o.join(anchors(o), F.col("object_idx") != F.col("a_object_idx")).withColumn("score", p.near(S, A))
    best = x.groupBy("object_idx").agg(F.max_by(F.struct("a_object_idx", "score"), F.struct(F.round("score", 9), -F.col("a_object_idx"))).alias("b"))
    return best.select("object_idx", F.col("b.a_object_idx").alias("anchor"), r6(F.col("b.score")).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 k AS (SELECT s_suppkey + 1000000 AS source, s_suppkey + 1000000 AS node, 0 AS hop FROM supplier WHERE s_suppkey % 100 = 0 UNION SELECT k.source, u.b, k.hop + 1 FROM k JOIN u ON k.node = u.a WHERE k.hop < 2)
 SELECT source, node, min(hop) AS hop FROM k GROUP BY source, node""")
def j07_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of the query set in the bipartite graph of parts and suppliers."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    start = table(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select((F.col("s_suppkey") + 1000000).alias("node"))
    return graph.reachable(e, start, 2)


@query("""WITH b AS (SELECT DISTINCT l_partkey AS object, l_orderkey AS image FROM lineitem)
 SELECT i.object AS i, j.object AS j, count(*) AS shared FROM b i JOIN b j ON i.image = j.image AND i.object < j.object GROUP BY i.object, j.object HAVING count(*) >= 2""")
def j08_j18_covisibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects seen together in at least two images."""
    b = object_images(spark, sf_dir)
    both = b.join(b.select(F.col("object").alias("j"), "image"), "image").where("object < j")
    return both.groupBy(F.col("object").alias("i"), "j").agg(F.count("*").alias("shared")).where("shared >= 2")


@query(f"""WITH {DETECTIONS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id, object ORDER BY score DESC, pixels DESC, det) AS n FROM det)
 SELECT det, image_id, CASE WHEN n = 1 THEN object ELSE -1 END AS assigned FROM k""")
def w03_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best detection of an object in an image keeps it, the others become new."""
    by = Window.partitionBy("image_id", "object").orderBy(F.desc("score"), F.desc("pixels"), "det")
    d = detections(spark, sf_dir).withColumn("n", F.row_number().over(by))
    return d.select("det", "image_id", F.when(F.col("n") == 1, F.col("object")).otherwise(F.lit(-1)).cast("long").alias("assigned"))


@query(f"""WITH {OBJECTS_SQL}, s AS (SELECT object_idx % 50 AS id, count(*)::DOUBLE AS n, {', '.join(f'sum({v}) AS s{k}, sum(v{v}+{v}*{v}) AS q{k}' for k, v in enumerate('xyz'))} FROM o WHERE object_idx >= 50 GROUP BY 1),
 j AS (SELECT o.object_idx AS id, weight AS w0, weight+coalesce(n, 0) AS w, {', '.join(f'{v}, v{v}, coalesce(s{k}, 0) AS s{k}, coalesce(q{k}, 0) AS q{k}' for k, v in enumerate('xyz'))} FROM o LEFT JOIN s ON s.id = o.object_idx WHERE o.object_idx < 50),
 k AS (SELECT *, {', '.join(f'(w0*{v}+s{k})/w AS m{k}' for k, v in enumerate('xyz'))} FROM j)
 SELECT id, round(w, 6) AS w, {', '.join(f'round(m{k}, 6) AS m{k}, round(greatest(1e-6, (w0*(v{v}+{v}*{v})+q{k})/w-m{k}*m{k}), 6) AS v{k}' for k, v in enumerate('xyz'))} FROM k""")
def a01_a03_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian fusion: the first fifty objects take in the rest as detections."""
    o = objects(spark, sf_dir)
    cols = [*[F.col(v).alias(f"m{k}") for k, v in enumerate("xyz")], *[F.col(f"v{v}").alias(f"v{k}") for k, v in enumerate("xyz")]]
    base = o.where("object_idx < 50").select(F.col("object_idx").alias("id"), F.col("weight").alias("w"), *cols)
    new = o.where("object_idx >= 50").select((F.col("object_idx") % 50).alias("id"), *cols)
    out = ag.fused_gaussians(base, new)
    return out.select("id", *[r6(F.col(c)).alias(c) for c in out.columns if c != "id"])


@query(f"""WITH {DETECTIONS_SQL}, v AS (SELECT object, class, sum(score*sqrt(pixels/500.0)) AS mass, count(*) AS n FROM det WHERE score >= 0.25 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER w AS r, lead(mass) OVER w AS nxt, sum(n) OVER (PARTITION BY object) AS total FROM v WINDOW w AS (PARTITION BY object ORDER BY mass DESC, class))
 SELECT object, class, round(mass, 4) AS mass, coalesce(mass >= 1.15*nxt, true) AND total >= 2 AS switched FROM k WHERE r = 1""")
def a11_w04_label_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.chosen_label(ag.class_votes(detections(spark, sf_dir))).withColumn("mass", F.round("mass", 4))


@query(f"""WITH {DETECTIONS_SQL}, k AS (SELECT object, class, pow(0.9::DOUBLE, count(*) OVER (PARTITION BY object, class)-row_number() OVER (PARTITION BY object, class ORDER BY det)) AS t FROM det)
 SELECT object, class, round(sum(t), 6) AS weight FROM k GROUP BY object, class""")
def a12_covisibility_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.decayed_weight(detections(spark, sf_dir), ["object", "class"], "det").withColumn("weight", r6(F.col("weight")))


CHANNELS = """c AS (SELECT o.object_idx, 'caption_target' AS channel, list_cosine_similarity(o.feature, q.feature) AS s FROM o, o q WHERE q.object_idx = 0
 UNION ALL SELECT o.object_idx, 'caption_raw', list_cosine_similarity(o.feature, q.feature) FROM o, o q WHERE q.object_idx = 1
 UNION ALL SELECT o.object_idx, 'siglip2', list_dot_product(o.feature, q.feature) FROM o, o q WHERE q.object_idx = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(s, 9) DESC, object_idx) AS rank FROM c),
 f AS (SELECT object_idx, sum(CASE channel WHEN 'caption_target' THEN 1.0 WHEN 'caption_raw' THEN 0.5 ELSE 0.75 END/(5.0+rank)) AS score FROM k GROUP BY object_idx)"""


def channel_ranks(o: DataFrame) -> DataFrame:
    """object_idx, channel, rank (from 1) by three similarities to the query vectors."""
    q = lambda i: F.broadcast(o.where(f"object_idx = {i}").select(F.col("feature").alias("q")))  # noqa: E731  one row
    base = o.select("object_idx", "feature")
    parts = [
        base.join(q(0)).select("object_idx", F.lit("caption_target").alias("channel"), m.cosine("feature", "q").alias("s")),
        base.join(q(1)).select("object_idx", F.lit("caption_raw").alias("channel"), m.cosine("feature", "q").alias("s")),
        base.join(q(0)).select("object_idx", F.lit("siglip2").alias("channel"), m.dot("feature", "q").alias("s")),
    ]
    return ag.global_ranks(parts[0].unionByName(parts[1]).unionByName(parts[2]), "channel", F.round("s", 9).desc(), F.col("object_idx"))


WEIGHTS = {"caption_target": 1.0, "caption_raw": 0.5, "siglip2": 0.75, "qwen3_vl": 1.0}


@query(f"WITH {OBJECTS_SQL}, {CHANNELS} SELECT object_idx, round(score, 6) AS score FROM f")
def a13_w01_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.rank_fusion(channel_ranks(objects(spark, sf_dir)), ["object_idx"], WEIGHTS).withColumn("score", r6(F.col("score")))


@query(
    f"""WITH {OBJECTS_SQL}, {CHANNELS}, x AS (SELECT o.object_idx, o.region_id, f.score AS sim, {DIST.format('o', 'a')} AS d FROM o JOIN f USING (object_idx), o a WHERE a.object_idx = 1 AND o.object_idx <> 1 AND o.active),
 y AS (SELECT *, CASE WHEN d > 5 THEN 0 ELSE exp(-d*d/(2*0.5*0.5)) END AS near FROM x)
 SELECT object_idx, round(sim, 6) AS sim, round(near, 6) AS near, round(sim*(0.5+0.5*exp(ln(greatest(1e-6, near)))), 6) AS score FROM y ORDER BY round(sim*(0.5+0.5*exp(ln(greatest(1e-6, near)))), 9) DESC, object_idx LIMIT 20"""
)
def relational_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the twenty active objects most like the query and near the anchor: channels, rank fusion, predicate, composition, top k."""
    o = objects(spark, sf_dir)
    sim = ag.rank_fusion(channel_ranks(o), ["object_idx"], WEIGHTS).withColumnRenamed("score", "sim")
    anchor = F.broadcast(renamed(o.where("object_idx = 1").select(*S), "a_"))
    x = o.where("active and object_idx <> 1").join(sim, "object_idx").join(anchor).withColumn("near", p.near(S, A))
    x = x.withColumn("score", p.composed("sim", F.array("near"), 0.5)).orderBy(F.round("score", 9).desc(), "object_idx").limit(20)
    return x.select("object_idx", r6(F.col("sim")).alias("sim"), r6(F.col("near")).alias("near"), r6(F.col("score")).alias("score"))


BOXES = "b AS (SELECT object_idx AS i, " + ", ".join(f"{v}-2.5*sqrt(greatest(v{v}, 1e-4)) AS {v}1, {v}+2.5*sqrt(greatest(v{v}, 1e-4)) AS {v}2" for v in "xyz") + " FROM o)"


@query(f"WITH {OBJECTS_SQL}, {BOXES} SELECT p.i, q.i AS j FROM b p JOIN b q ON p.i < q.i AND {' AND '.join(f'p.{v}1 < q.{v}2 AND q.{v}1 < p.{v}2' for v in 'xyz')}")
def j13_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = m.gaussian_box(S, ("vx", "vy", "vz"))
    b = objects(spark, sf_dir).select(F.col("object_idx").alias("i"), *[c.alias(n) for c, n in zip(box, ("x1", "y1", "z1", "x2", "y2", "z2"), strict=True)])
    return spatial.overlapping_boxes(b, 2.0)


@query(f"WITH {OBJECTS_SQL}, {BOXES} SELECT object_idx FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.i % 100 = 0 AND {' AND '.join(f'o.{v} BETWEEN {v}1 AND {v}2' for v in 'xyz')})")
def f12_j12_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside none of the query set's boxes."""
    o = objects(spark, sf_dir)
    box = m.gaussian_box(S, ("vx", "vy", "vz"))
    b = o.where("object_idx % 100 = 0").select(*[c.alias(n) for c, n in zip(box, ("x1", "y1", "z1", "x2", "y2", "z2"), strict=True)])
    return spatial.outside(o, b, 2.0).select("object_idx")


@query(f"WITH {OBJECTS_SQL} SELECT min(object_idx) AS object_idx, count(*) AS n, round(median(x), 6) AS mx, round(quantile_disc(y, 0.5), 6) AS my, round(var_pop(z), 6) AS vz FROM o GROUP BY floor(x/2), floor(y/2), floor(z/2)")
def a05_a09_voxel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of two metres: first point, count, interpolated and lower median, population variance."""
    o = objects(spark, sf_dir)
    keys = [m.voxel(v, 2.0) for v in S]
    return o.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min("object_idx").alias("object_idx"), F.count("*").alias("n"), F.round(F.median("x"), 6).alias("mx"), F.round(F.expr("percentile_disc(0.5) within group (order by y)"), 6).alias("my"), F.round(F.var_pop("z"), 6).alias("vz")).drop("k0", "k1", "k2")


RANKED = """r AS (SELECT o_custkey AS uid, o_orderpriority AS relation, o_orderstatus AS type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, (o_orderkey % 97)/97.0::DOUBLE AS iou FROM orders),
 q AS (SELECT uid, min(relation) AS relation, min(type) AS type, min(CASE WHEN iou >= 0.25 THEN rank END) AS r25, min(CASE WHEN iou >= 0.5 THEN rank END) AS r50 FROM r GROUP BY uid)"""


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query its first ranks with an IoU of 0.25 and 0.5; orders stand in for ranked predictions."""
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("relation"), F.col("o_orderstatus").alias("type"), F.row_number().over(by).alias("rank"), ((F.col("o_orderkey") % 97) / 97.0).alias("iou"))
    return r.groupBy("uid").agg(F.min("relation").alias("relation"), F.min("type").alias("type"), *[F.min(F.when(F.col("iou") >= t, F.col("rank"))).alias(f"r{int(t * 100)}") for t in (0.25, 0.5)])


METRICS_SQL = "count(*) AS n, " + ", ".join(", ".join([*[f"round(avg(CASE WHEN r{t} <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall{k}_{t}" for k in (1, 3, 5, 10)], f"round(avg(coalesce(1.0/r{t}, 0)), 6) AS mrr_{t}", f"round(avg(CASE WHEN r{t} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_{t}"]) for t in (25, 50))


@query(f"WITH {RANKED} SELECT relation, type, {METRICS_SQL} FROM q GROUP BY GROUPING SETS ((), (relation), (type)) HAVING count(*) >= 5")
def a21_a23_w07_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at k, reciprocal rank and hit rate, over all and by two dimensions; groups of five queries or more."""
    q = first_hits(spark, sf_dir)
    out = q.groupingSets([[], ["relation"], ["type"]], "relation", "type").agg(*ag.rank_metrics(q)).where("n >= 5")
    return out.select(*[F.round(c, 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in out.columns])


@query(f"""WITH {DETECTIONS_SQL} SELECT det, round(avg(score) OVER (PARTITION BY object ORDER BY det ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth,
 (row_number() OVER (PARTITION BY class ORDER BY det)-1) % 3 = 0 AS sampled, row_number() OVER (PARTITION BY object ORDER BY det DESC) <= 10 AS recent FROM det""")
def w06_w12_w13_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred moving average, per-camera stride, and the newest observations of each object."""
    d = detections(spark, sf_dir)
    by = Window.partitionBy("object")
    return d.select("det", r6(F.avg("score").over(by.orderBy("det").rowsBetween(-2, 2))).alias("smooth"), ((F.row_number().over(Window.partitionBy("class").orderBy("det")) - 1) % 3 == 0).alias("sampled"), (F.row_number().over(by.orderBy(F.desc("det"))) <= 10).alias("recent"))


@query("""WITH b AS (SELECT DISTINCT l_partkey AS i, l_suppkey AS j FROM lineitem), x AS (SELECT i FROM b WHERE j % 2 = 0), y AS (SELECT i FROM b WHERE j % 3 = 0)
 SELECT 'both' AS what, i FROM (SELECT i FROM x INTERSECT SELECT i FROM y) UNION ALL SELECT 'left', i FROM (SELECT i FROM x EXCEPT SELECT i FROM y) UNION ALL SELECT 'any', i FROM (SELECT i FROM x UNION SELECT i FROM y)""")
def u01_u03_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).distinct()
    x, y = b.where("j % 2 = 0").select("i"), b.where("j % 3 = 0").select("i")
    named = lambda what, df: df.select(F.lit(what).alias("what"), "i")
    return named("both", x.intersect(y)).unionByName(named("left", x.exceptAll(y).distinct().join(y, "i", "left_anti"))).unionByName(named("any", x.union(y).distinct()))


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS loser, o_orderkey - o_orderkey % 7 AS winner FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, o_orderkey - o_orderkey % 49 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 49 <> 0),
 w AS (SELECT loser, winner, 1 AS hops FROM r UNION ALL SELECT w.loser, r.winner, w.hops + 1 FROM w JOIN r ON w.winner = r.loser)
 SELECT loser, max_by(winner, hops) AS winner, max(hops) AS hops FROM w GROUP BY loser""")
def j16_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last winner of every merged object."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    r = o.select(k.alias("loser"), F.when(k % 7 != 0, k - k % 7).when(k % 49 != 0, k - k % 49).alias("winner")).where("winner is not null")
    return graph.resolve_redirects(r)


@query(f"""WITH {DETECTIONS_SQL}, p AS (SELECT DISTINCT least(a.object, b.object) AS a, greatest(a.object, b.object) AS b FROM det a JOIN det b ON a.image_id = b.image_id AND a.object < b.object)
 SELECT a, b FROM p""")
def g04_cannot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different objects of one image can't be the same; an image shows forty detections."""
    d = detections(spark, sf_dir).select("image_id", "object").distinct()
    return d.select("image_id", F.col("object").alias("a")).join(d.select("image_id", F.col("object").alias("b")), "image_id").where("a < b").select("a", "b").distinct()


@query("""WITH w AS (SELECT l_partkey % 300 AS a, l_suppkey % 300 AS b, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT a - a % 4 AS a, b - b % 4 AS b, n FROM w)
 SELECT least(a, b) AS a, greatest(a, b) AS b, sum(n)::BIGINT AS weight FROM r WHERE a <> b GROUP BY ALL""")
def g05_edge_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after merging: ends relabelled, self edges dropped, weights added."""
    w = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 300).alias("a"), (F.col("l_suppkey") % 300).alias("b")).agg(F.count("*").alias("n"))
    r = w.select((F.col("a") - F.col("a") % 4).alias("a"), (F.col("b") - F.col("b") % 4).alias("b"), "n").where("a <> b")
    return r.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("weight"))


@query()
def a34_j28_covering_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest images by greedy choice that show all objects of each cluster; a cluster is a supplier's parts."""
    line = table(spark, sf_dir, "lineitem")
    return ag.greedy_cover(line.select(F.col("l_suppkey").alias("cluster"), F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("object")).distinct())


@query(f"""WITH {OBJECTS_SQL}, s AS (SELECT a.object_idx AS q, o.object_idx AS i, list_cosine_similarity(o.feature, a.feature) AS s FROM o, o a WHERE a.object_idx % 100 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, i) AS n FROM s) SELECT q, i, n::INT AS rank, round(s, 6) AS cos FROM k WHERE n <= 10""")
def o01_j21_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar objects of each query object, exactly: the query set in blocks against all."""
    o = objects(spark, sf_dir).select("object_idx", "feature")
    s = similar.top_by_cosine(o, o.where("object_idx % 100 = 0"), 10)
    return s.select(F.col("query").alias("q"), F.col("object_idx").alias("i"), "rank", r6(F.col("s")).alias("cos"))


@query("""WITH c AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, sum((value < 1)::INT)::BIGINT AS low FROM events GROUP BY event_type)
 SELECT *, n >= 100 AND low * 2 < n AS passed FROM c""")
def a26_a30_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, percentiles and quality gates by class."""
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.1), 6).alias("p10"), F.round(F.percentile("value", 0.9), 6).alias("p90"), F.sum(F.when(F.col("value") < 1, 1).otherwise(0)).alias("low"))
    return c.withColumn("passed", (F.col("n") >= 100) & (F.col("low") * 2 < F.col("n")))


@query(f"""WITH {DETECTIONS_SQL} SELECT det FROM det WHERE pixels >= 50 AND score >= 0.3 AND score < 80 AND NOT ((det % 640 <= 5 OR 639 - det % 640 <= 5) AND pixels < 1000) AND class NOT IN ('error')""")
def f01_f05_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection filters: size, range (upper end open), slivers at the border, labels that tell nothing."""
    u = F.col("det") % 640
    sliver = ((u <= 5) | (639 - u <= 5)) & (F.col("pixels") < 1000)
    stop = spark.createDataFrame([("error",)], "class string")
    return detections(spark, sf_dir).where((F.col("pixels") >= 50) & (F.col("score") >= 0.3) & (F.col("score") < 80) & ~sliver).join(F.broadcast(stop), "class", "left_anti").select("det")


@query("""SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, value FROM events) GROUP BY ALL""")
def st10_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: tumbling windows; the streaming form is streaming.windows.hourly."""
    from loomap.streaming.windows import hourly

    return hourly(table(spark, sf_dir, "events"))
