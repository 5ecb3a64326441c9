"""Queries of filters, voxels, views, local maps and evaluation figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomap.functions import math as m
from loomap.operators import graph, nearest, similar, spatial
from loomap.plans.maps import DIST, r6
from loomap.sources.scene import DETECTIONS_SQL, OBJECTS_SQL, anchors, detections, objects, table

S, A = ("x", "y", "z"), ("a_x", "a_y", "a_z")
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH p AS (SELECT l_suppkey AS det, l_orderkey AS px, l_linenumber AS k, l_extendedprice/1000 AS depth FROM lineitem), a AS (SELECT det, quantile_disc(depth, 0.5) AS med, count(*) AS n FROM p GROUP BY det),
 b AS (SELECT det, quantile_disc(abs(depth-med), 0.5) AS mad FROM p JOIN a USING (det) GROUP BY det) SELECT det, px, k FROM p JOIN a USING (det) JOIN b USING (det) WHERE n < 50 OR abs(depth-med) <= 3*greatest(mad, 0.03)""")
def f13_depth_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels within three median deviations (lower medians) of their detection's depth; small detections stay whole."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("det"), F.col("l_orderkey").alias("px"), F.col("l_linenumber").alias("k"), (F.col("l_extendedprice") / 1000).alias("depth"))
    low = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    a = p.groupBy("det").agg(low("depth").alias("med"), F.count("*").alias("n"))
    b = p.join(a, "det").withColumn("off", F.abs(F.col("depth") - F.col("med"))).groupBy("det").agg(low("off").alias("mad"))
    return p.join(a, "det").join(b, "det").where("n < 50 or abs(depth - med) <= 3 * greatest(mad, 0.03)").select("det", "px", "k")


@query("""SELECT p_partkey AS landmark, round(found/visible, 6) AS ratio FROM (SELECT p_partkey, p_size::DOUBLE AS visible, (p_partkey % 13)::DOUBLE AS found FROM part) WHERE visible > 0 AND found/visible >= 0.3""")
def f18_a39_landmark_culling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks that are found often enough when they should be visible."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("landmark"), F.try_divide((F.col("p_partkey") % 13).cast("double"), F.col("p_size").cast("double")).alias("ratio"))
    return p.where("ratio >= 0.3").withColumn("ratio", r6(F.col("ratio")))


@query(f"""WITH {OBJECTS_SQL}, k AS (SELECT i.object_idx, i.class_id, {DIST.format('i', 'j')} AS d, row_number() OVER (PARTITION BY i.object_idx ORDER BY {DIST.format('i', 'j')}, j.object_idx) AS n FROM o i JOIN o j ON i.class_id = j.class_id AND i.object_idx <> j.object_idx),
 a AS (SELECT object_idx, class_id, avg(d) AS d FROM k WHERE n <= 5 GROUP BY ALL), t AS (SELECT class_id, avg(d)+2*stddev_pop(d) AS t FROM a GROUP BY class_id) SELECT object_idx FROM a JOIN t USING (class_id) WHERE d <= t""")
def f16_outlier_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose mean distance to their five nearest of the class isn't two deviations above the class's mean."""
    o = objects(spark, sf_dir).select("object_idx", "class_id", *S)
    k = nearest.k_nearest(o, o, 5, by="class_id")
    a = k.groupBy(F.col("id").alias("object_idx")).agg(F.avg("d").alias("d")).join(o.select("object_idx", "class_id"), "object_idx")
    t = a.groupBy("class_id").agg((F.avg("d") + 2 * F.stddev_pop("d")).alias("t"))
    return a.join(t, "class_id").where("d <= t").select("object_idx")


@query(f"""WITH {OBJECTS_SQL}, v AS (SELECT floor(x/1.0) AS a, floor(y/1.0) AS b, floor(z/1.0) AS c, min(object_idx) AS object_idx FROM o GROUP BY ALL) SELECT object_idx, round(x, 6) AS x FROM v JOIN o USING (object_idx)""")
def a07_voxel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first point of every voxel."""
    return spatial.first_per_voxel(objects(spark, sf_dir).select("object_idx", *S), 1.0, "object_idx").select("object_idx", r6(F.col("x")).alias("x"))


@query(f"""WITH {OBJECTS_SQL}, l AS (SELECT class_id, level, count(DISTINCT (floor(x/(0.5*pow(2, level))), floor(y/(0.5*pow(2, level))), floor(z/(0.5*pow(2, level))))) AS n FROM o, (SELECT unnest(range(0, 6)) AS level) GROUP BY ALL)
 SELECT class_id, min(level)::INT AS level FROM l WHERE n <= 20 GROUP BY class_id""")
def a08_voxel_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest level at which a class's voxels are few enough."""
    o = objects(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(5))))
    size = F.lit(0.5) * F.pow(F.lit(2.0), F.col("level"))
    n = o.groupBy("class_id", "level").agg(F.countDistinct(F.struct(*[F.floor(F.col(v) / size).alias(v) for v in S])).alias("n"))
    return n.where("n <= 20").groupBy("class_id").agg(F.min("level").alias("level"))


@query(f"""WITH {OBJECTS_SQL} SELECT class_id, round(min(floor(x/0.5)*0.5), 6) AS x1, round(max(floor(x/0.5)*0.5)+0.5, 6) AS x2, round(avg(floor(x/0.5)*0.5+0.25), 6) AS cx, round(var_pop(floor(x/0.5)*0.5+0.25), 6) AS vx, {', '.join(f'round(min(floor({a}/0.5)*0.5), 6) AS {a}1, round(max(floor({a}/0.5)*0.5)+0.5, 6) AS {a}2, round(avg(floor({a}/0.5)*0.5+0.25), 6) AS c{a}, round(var_pop(floor({a}/0.5)*0.5+0.25), 6) AS v{a}' for a in 'yz')} FROM o GROUP BY class_id""")
def a09_a10_voxel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, centre and population variance of an object's voxels."""
    low = {a: F.floor(F.col(a) / 0.5) * 0.5 for a in S}
    figures = [f for a, c in low.items() for f in (r6(F.min(c)).alias(f"{a}1"), r6(F.max(c) + 0.5).alias(f"{a}2"), r6(F.avg(c + 0.25)).alias(f"c{a}"), r6(F.var_pop(c + 0.25)).alias(f"v{a}"))]
    return objects(spark, sf_dir).groupBy("class_id").agg(*figures)


@query(f"""WITH {OBJECTS_SQL}, s AS (SELECT o.region_id, q.object_idx AS prompt, max(list_cosine_similarity(o.feature, q.feature)) AS s FROM o, o q WHERE q.object_idx % 100 = 0 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY round(s, 9) DESC, prompt) AS n FROM s) SELECT region_id, round(1/(1+exp(-(10*avg(s)-2))), 6) AS p FROM k WHERE n <= 3 GROUP BY region_id""")
def a14_prompt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best over an object's history for each prompt, the mean of the best three prompts, then a sigmoid; regions stand in for objects."""
    o = objects(spark, sf_dir).select("object_idx", "region_id", "feature")
    met = similar.cosines(o, o.where("object_idx % 100 = 0"), ("region_id",))
    s = met.groupBy("region_id", F.col("a_object_idx").alias("prompt")).agg(F.max("cos").alias("s"))
    k = s.withColumn("n", F.row_number().over(Window.partitionBy("region_id").orderBy(F.round("s", 9).desc(), "prompt"))).where("n <= 3")
    return k.groupBy("region_id").agg(r6(m.sigmoid(10 * F.avg("s") - 2)).alias("p"))


@query(f"""WITH {DETECTIONS_SQL} SELECT object AS cluster, round(max(score), 6) AS best, max_by(det, score*100000-det) AS det, max(pixels) AS pixels, count(DISTINCT image_id) AS images FROM det GROUP BY object""")
def a16_cluster_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest scores, best candidate and images of each cluster."""
    return detections(spark, sf_dir).groupBy(F.col("object").alias("cluster")).agg(r6(F.max("score")).alias("best"), F.max_by("det", F.col("score") * 100000 - F.col("det")).alias("det"), F.max("pixels").alias("pixels"), F.countDistinct("image_id").alias("images"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS mask, l_partkey AS px FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_suppkey AS mask, l_partkey AS px FROM lineitem WHERE l_linenumber >= 3),
 c AS (SELECT mask, count(*) AS common FROM a JOIN b USING (mask, px) GROUP BY mask), n AS (SELECT mask, count(*) AS na FROM a GROUP BY mask), k AS (SELECT mask, count(*) AS nb FROM b GROUP BY mask)
 SELECT mask, round(coalesce(common, 0)/(na+nb-coalesce(common, 0))::DOUBLE, 6) AS iou, round(coalesce(common, 0)/na::DOUBLE, 6) AS precision, round(coalesce(common, 0)/nb::DOUBLE, 6) AS recall FROM n JOIN k USING (mask) LEFT JOIN c USING (mask)""")
def a24_mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU, precision and recall of predicted and true pixel sets, in one pass of flags."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("mask"), "l_partkey").agg(F.max((F.col("l_linenumber") <= 4).cast("int")).alias("a"), F.max((F.col("l_linenumber") >= 3).cast("int")).alias("b"))
    n = p.groupBy("mask").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("both")).where("na > 0 and nb > 0")
    return n.select("mask", r6(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("iou"), r6(F.col("both") / F.col("na")).alias("precision"), r6(F.col("both") / F.col("nb")).alias("recall"))


@query(f"""WITH {DETECTIONS_SQL}, k AS (SELECT object, score/100 AS iou, pixels, row_number() OVER (PARTITION BY object ORDER BY score DESC, det) AS n FROM det)
 SELECT object, round(max(iou), 6) AS best, round(avg(iou) FILTER (n <= 3), 6) AS top3, round(sum(iou*pixels)/sum(pixels), 6) AS weighted FROM k GROUP BY object""")
def a25_w08_multi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over an object's views: best, mean of the best three, and weighted by pixels."""
    d = detections(spark, sf_dir).withColumn("iou", F.col("score") / 100).withColumn("n", F.row_number().over(Window.partitionBy("object").orderBy(F.desc("score"), "det")))
    return d.groupBy("object").agg(r6(F.max("iou")).alias("best"), r6(F.avg(F.when(F.col("n") <= 3, F.col("iou")))).alias("top3"), r6(F.sum(F.col("iou") * F.col("pixels")) / F.sum("pixels")).alias("weighted"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS kf, l_partkey AS lm FROM lineitem), n AS (SELECT lm, count(*) AS seen FROM s GROUP BY lm)
 SELECT kf, count(*) AS landmarks, round(avg(CASE WHEN seen-1 >= 3 THEN 1.0 ELSE 0.0 END), 6) AS redundancy FROM s JOIN n USING (lm) GROUP BY kf""")
def a29_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a keyframe's landmarks that at least three others see."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("kf"), F.col("l_partkey").alias("lm")).distinct()
    n = s.groupBy("lm").agg(F.count("*").alias("seen"))
    return s.join(n, "lm").groupBy("kf").agg(F.count("*").alias("landmarks"), r6(F.avg(F.when(F.col("seen") >= 4, 1.0).otherwise(0.0))).alias("redundancy"))


@query(f"""WITH {OBJECTS_SQL}, f AS (SELECT class_id, object_idx, unnest(feature) AS v, generate_subscripts(feature, 1) AS k FROM o), c AS (SELECT class_id, k, avg(v) AS c FROM f GROUP BY ALL)
 SELECT class_id, round(sqrt(sum((v-c)*(v-c))/count(DISTINCT object_idx)), 6) AS spread FROM f JOIN c USING (class_id, k) GROUP BY class_id""")
def a31_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean squared distance of a class's features to their mean."""
    f = objects(spark, sf_dir).select("class_id", "object_idx", F.posexplode("feature").alias("k", "v"))
    one = f.groupBy("class_id", "k").agg((F.var_pop("v") * F.count("*")).alias("ss"), F.count("*").alias("n"))
    return one.groupBy("class_id").agg(r6(F.sqrt(F.sum("ss") / F.max("n"))).alias("spread"))


@query("""WITH e AS (SELECT least(29, floor(value/10))::INT AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT b.bin, sum(coalesce(n, 0)) OVER (ORDER BY b.bin) AS upto, (SELECT count(*) FROM events) AS total FROM (SELECT unnest(range(0, 30))::INT AS bin) b LEFT JOIN e USING (bin))
 SELECT bin, round(upto/total::DOUBLE, 6) AS share FROM c""")
def a32_w14_error_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram of errors over thirty bins; its mean up to a bin is the area under the curve."""
    e = table(spark, sf_dir, "events").groupBy(F.least(F.lit(29), F.floor(F.col("value") / 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(30).select(F.col("id").cast("int").alias("bin"))  # thirty rows: one window is enough
    c = bins.join(e, "bin", "left").withColumn("upto", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bin")))
    return c.withColumn("total", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy())).select("bin", r6(F.col("upto") / F.col("total")).alias("share"))


@query("""WITH d AS (SELECT c_custkey // 20 AS lm, c_custkey AS i, (c_custkey*2654435761) % 65536 AS h FROM customer), p AS (SELECT a.lm, a.i, bit_count(xor(a.h, b.h))::INT AS dist FROM d a JOIN d b ON a.lm = b.lm AND a.i <> b.i),
 k AS (SELECT lm, i, quantile_disc(dist, 0.5) AS med FROM p GROUP BY ALL) SELECT lm, arg_min(i, med*1000000+i) AS i, min(med)::INT AS med FROM k GROUP BY lm""")
def a39_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each landmark's descriptor with the least median Hamming distance to its others (some dozens of views each)."""
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(F.floor(k / 20).alias("lm"), k.alias("i"), (k * 2654435761 % 65536).alias("h"))
    p = d.join(d.select("lm", F.col("i").alias("j"), F.col("h").alias("g")), "lm").where("i <> j").select("lm", "i", F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).alias("dist"))
    med = p.groupBy("lm", "i").agg(F.expr("percentile_disc(0.5) within group (order by dist)").cast("int").alias("med"))
    return med.groupBy("lm").agg(F.min_by("i", F.col("med") * 1000000 + F.col("i")).alias("i"), F.min("med").alias("med"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey AS kf, l_partkey AS lm FROM lineitem), q AS (SELECT kf FROM s WHERE kf % 100 = 0 GROUP BY kf), one AS (SELECT DISTINCT q.kf AS q, b.kf FROM q JOIN s a ON a.kf = q.kf JOIN s b ON a.lm = b.lm), lm AS (SELECT DISTINCT one.q, s.lm FROM one JOIN s USING (kf))
 SELECT q, count(*) AS landmarks FROM lm GROUP BY q""")
def j30_local_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks of the keyframes that share a landmark with each query keyframe."""
    return graph.local_maps(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("kf"), F.col("l_partkey").alias("lm")), 100)


@query(f"""WITH {OBJECTS_SQL} SELECT a.object_idx AS q, o.object_idx AS i FROM o, o a WHERE a.object_idx % 100 = 0 AND a.object_idx <> o.object_idx AND {DIST.format('o', 'a')} < 2 AND list_cosine_similarity(o.feature[1:3], a.feature[1:3]) > cos(0.6)""")
def j20_pose_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses near each query pose in place and direction."""
    o = objects(spark, sf_dir).select("object_idx", *S, F.slice("feature", 1, 3).alias("dir"))
    near = spatial.pairs_within(o, anchors(o), 2.0).where("object_idx <> a_object_idx and d < 2")
    return near.where(m.cosine("dir", "a_dir") > F.cos(F.lit(0.6))).select(F.col("a_object_idx").alias("q"), F.col("object_idx").alias("i"))


@query(f"""WITH {DETECTIONS_SQL}, k AS (SELECT object, det, row_number() OVER (PARTITION BY object ORDER BY score DESC, pixels DESC, day DESC, det) AS n, count(*) OVER (PARTITION BY object) AS c FROM det) SELECT object, det FROM k WHERE n <= greatest(10, ceil(0.5*c))""")
def o02_o05_kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each object's candidates, ten at least, by several keys."""
    by = Window.partitionBy("object")
    k = detections(spark, sf_dir).withColumns({"n": F.row_number().over(by.orderBy(F.desc("score"), F.desc("pixels"), F.desc("day"), "det")), "c": F.count("*").over(by)})
    return k.where("n <= greatest(10, ceil(0.5 * c))").select("object", "det")


@query("""SELECT p_brand AS winner, min(p_partkey) AS kept, count(*) - 1 AS losers, round(sum(p_size*p_retailprice)/sum(p_size), 4) AS mean, sum(p_size)::BIGINT AS weight FROM part GROUP BY p_brand""")
def g03_merge_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge leaves: the least member, how many were lost, the weighted mean and the sum of weights."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("winner")).agg(F.min("p_partkey").alias("kept"), (F.count("*") - 1).alias("losers"), F.round(F.sum(F.col("p_size") * F.col("p_retailprice")) / F.sum("p_size"), 4).alias("mean"), F.sum("p_size").alias("weight"))
