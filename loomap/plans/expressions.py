"""Queries of scalar expressions, predicates and compositions over all objects and the anchors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomap.functions import math as m
from loomap.functions import text as t
from loomap.operators import predicates as p
from loomap.operators import nearest, similar
from loomap.runtime import dealt
from loomap.sources.scene import DETECTIONS_SQL, OBJECTS_SQL, PAIRS_SQL, anchors, detections, objects, table

S, A = ("x", "y", "z"), ("a_x", "a_y", "a_z")
COV, A_COV = ("vx", 0.0, 0.0, "vy", 0.0, "vz"), ("a_vx", 0.0, 0.0, "a_vy", 0.0, "a_vz")
QUERIES, ORACLES = {}, {}


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects with each object of the query set (one in a hundred), but themselves; a task has 4,096 objects, however few files they are read from."""
    o = objects(spark, sf_dir).drop("feature")
    return dealt(o, "object_idx").join(F.broadcast(anchors(o)), F.col("object_idx") != F.col("a_object_idx"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their places and the cosine ``cos`` of their features."""
    o = objects(spark, sf_dir).select("object_idx", *S, "feature")
    return similar.cosines(o, o.where("object_idx % 100 = 0"), S).where("object_idx <> a_object_idx")


def on_pairs(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], where: str | None = None, of: Callable[[SparkSession, str], DataFrame] = pairs) -> None:
    """A query that gives some columns for every pair, rounded to six places."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = of(spark, sf_dir).select("object_idx", "a_object_idx", *[F.round(v.cast("double"), 6).alias(k) for k, v in columns().items()])
        return df.where(where) if where else df

    QUERIES[name] = query
    listed = ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in sql.items())
    ORACLES[name] = f"{PAIRS_SQL} SELECT * FROM (SELECT object_idx, a_object_idx, {listed} FROM p)" + (f" WHERE {where}" if where else "")


def on_objects(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return objects(spark, sf_dir).select("object_idx", *[v.alias(k) for k, v in columns().items()])

    QUERIES[name] = query
    listed = ", ".join(f"{v} AS {k}" for k, v in sql.items())
    ORACLES[name] = f"WITH {OBJECTS_SQL} SELECT object_idx, {listed} FROM o"


def r6(c):
    return F.round(c.cast("double"), 6)


GAUSS = "exp(-({0})*({0})/(2.0*{1}*{1}))"
SIG = "1/(1+exp(-(({0})-({1}))/({2})))"

on_objects(
    "x01_x05_memberships",
    lambda: {"gauss": r6(m.gaussian("x", 0.5)), "sig": r6(m.sigmoid("x", 0.2, 0.15)), "product": r6(m.t_norm(F.array(F.abs("x") / 10, F.abs("y") / 10))), "either": r6(m.t_conorm(F.array(F.abs("x") / 10, F.abs("y") / 10))), "weighted": r6(m.t_norm_weighted(F.array(F.col("x") / 10, F.abs("y") / 10), F.array(F.lit(0.5), F.lit(2.0)))), "unit": r6(m.unit_score(F.col("x") * 60)), "clamped": r6(m.clamp_probability(F.col("x")))},
    {"gauss": f"round({GAUSS.format('x', 0.5)}, 6)", "sig": f"round({SIG.format('x', 0.2, 0.15)}, 6)", "product": "round(abs(x)/10*abs(y)/10, 6)", "either": "round(abs(x)/10 + abs(y)/10 - abs(x)/10*abs(y)/10, 6)", "weighted": "round(CASE WHEN x <= 0 OR abs(y) <= 0 THEN 0 ELSE pow(x/10, 0.5)*pow(abs(y)/10, 2) END, 6)", "unit": "round(greatest(0, least(1, x*60/100)), 6)", "clamped": "round(greatest(1e-6, least(1-1e-6, x)), 6)"},
)
BINS = [(-10.0, 0.0, 0.1), (0.0, 1.0, 0.4), (1.0, 10.0, 0.8)]
on_objects(
    "x06_x07_calibration",
    lambda: {"logistic": r6(m.logistic("x", -0.5, 2.0)), "binned": r6(m.by_bins("x", BINS)), "joint": r6(m.logprob([m.sigmoid("x"), m.sigmoid("y"), F.lit(0.5)]))},
    {"logistic": "round(1/(1+exp(-greatest(-60, least(60, -0.5+2.0*x)))), 6)", "binned": "round(CASE WHEN x BETWEEN -10 AND 0 THEN 0.1 WHEN x BETWEEN 0 AND 1 THEN 0.4 WHEN x BETWEEN 1 AND 10 THEN 0.8 ELSE x END, 6)", "joint": "round(exp(greatest(-60, least(0, ln(greatest(1e-6, least(1-1e-6, 1/(1+exp(-x))))) + ln(greatest(1e-6, least(1-1e-6, 1/(1+exp(-y))))) + ln(0.5)))), 6)"},
)
on_pairs("x08_distances", lambda: {"d": m.distance(S, A), "h": m.horizontal(S, A), "dz": m.height(S, A)}, {"d": "d", "h": "h", "dz": "dz"})
on_pairs("x10_cosine", lambda: {"cos": F.col("cos")}, {"cos": "list_cosine_similarity(feature, a_feature)"}, of=compared)
on_objects("x11_normalized", lambda: {"first": r6(m.normalized("feature")[0]), "last": r6(m.normalized("feature")[63]), "length": r6(m.norm(m.normalized("feature")))}, {"first": "round(feature[1]/greatest(sqrt(list_dot_product(feature, feature)), 1e-12), 6)", "last": "round(feature[64]/greatest(sqrt(list_dot_product(feature, feature)), 1e-12), 6)", "length": "round(1.0::DOUBLE, 6)"})
HELL = """CASE WHEN vx*vy*vz > 0 AND a_vx*a_vy*a_vz > 0 THEN 1-exp(ln(vx*vy*vz)/4+ln(a_vx*a_vy*a_vz)/4-ln((vx+a_vx)/2*(vy+a_vy)/2*(vz+a_vz)/2)/2
 -((x-a_x)*(x-a_x)/((vx+a_vx)/2)+(y-a_y)*(y-a_y)/((vy+a_vy)/2)+(z-a_z)*(z-a_z)/((vz+a_vz)/2))/8) ELSE 1 END"""
on_pairs("x13_x14_gaussian_distances", lambda: {"hellinger2": m.hellinger2(S, COV, A, A_COV), "mahalanobis2": m.mahalanobis2(S, A, A_COV)}, {"hellinger2": HELL, "mahalanobis2": "(x-a_x)*(x-a_x)/(a_vx+1e-4)+(y-a_y)*(y-a_y)/(a_vy+1e-4)+(z-a_z)*(z-a_z)/(a_vz+1e-4)"})
#: A quarter turn about the vertical axis.
R = (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
T = (1.0, 2.0, 3.0)
on_objects(
    "x15_x16_rigid_motion",
    lambda: {"wx": r6(m.rotated(R, S, T)[0]), "wy": r6(m.rotated(R, S, T)[1]), "wz": r6(m.rotated(R, S, T)[2]), "cxx": r6(m.rotated_cov(R, COV)[0]), "cyy": r6(m.rotated_cov(R, COV)[3]), "bx": r6(m.rotated(m.inverse_rigid(R, T)[0], S, m.inverse_rigid(R, T)[1])[0]), "q00": r6(m.quaternion_rotation(F.lit(0.0), F.lit(0.0), F.sin(F.col("x") / 2), F.cos(F.col("x") / 2))[0])},
    {"wx": "round(-y+1, 6)", "wy": "round(x+2, 6)", "wz": "round(z+3, 6)", "cxx": "round(vy, 6)", "cyy": "round(vx, 6)", "bx": "round(y-2, 6)", "q00": "round(1-2*sin(x/2)*sin(x/2), 6)"},
)
on_objects(
    "x17_x18_projection",
    lambda: {"u": m.pinhole(S, 500.0, 500.0, 320.0, 240.0)[0], "v": m.pinhole(S, 500.0, 500.0, 320.0, 240.0)[1], "lon": r6(m.lon_lat(S)[0]), "lat": r6(m.lon_lat(S)[1])},
    {"u": "CASE WHEN z > 0.01 THEN round_even(x/z*500+320, 0)::BIGINT END", "v": "CASE WHEN z > 0.01 THEN round_even(y/z*500+240, 0)::BIGINT END", "lon": "round(atan2(x, z), 6)", "lat": "round(asin(greatest(-1, least(1, -y/sqrt(x*x+y*y+z*z)))), 6)"},
)


def cells():
    return [m.voxel(v, 0.05) for v in S]


KEY_SQL = "(((floor(x/0.05)::BIGINT+1048576) << 42) | ((floor(y/0.05)::BIGINT+1048576) << 21) | (floor(z/0.05)::BIGINT+1048576))"
KEY2_SQL = "((((floor(x/0.05)::BIGINT >> 2)+1048576) << 42) | (((floor(y/0.05)::BIGINT >> 2)+1048576) << 21) | ((floor(z/0.05)::BIGINT >> 2)+1048576))"
on_objects(
    "x19_x22_voxels",
    lambda: {"voxel_key": m.voxel_key(cells()), "back": m.voxel_of_key(m.voxel_key(cells()))[1], "coarse": m.promoted_key(m.voxel_key(cells()), 2), "center": r6(m.voxel_center(cells()[0], 0.05))},
    {"voxel_key": KEY_SQL, "back": "floor(y/0.05)::BIGINT", "coarse": KEY2_SQL, "center": "round(floor(x/0.05)*0.05+0.025, 6)"},
)
INTER = "*".join(f"greatest(0, least({v}+2.5*sqrt(greatest(v{v}, 1e-4)), a_{v}+2.5*sqrt(greatest(a_v{v}, 1e-4)))-greatest({v}-2.5*sqrt(greatest(v{v}, 1e-4)), a_{v}-2.5*sqrt(greatest(a_v{v}, 1e-4))))" for v in "xyz")
VOL = "*".join("5*sqrt(greatest({0}v" + v + ", 1e-4))" for v in "xyz")
on_pairs("x23_x25_boxes", lambda: {"volume": m.box_volume(m.gaussian_box(S, ("vx", "vy", "vz"))), "iou": m.box_iou(m.gaussian_box(S, ("vx", "vy", "vz")), m.gaussian_box(A, ("a_vx", "a_vy", "a_vz")))}, {"volume": VOL.format(""), "iou": f"CASE WHEN {INTER} > 0 THEN {INTER}/({VOL.format('')}+{VOL.format('a_')}-{INTER}) ELSE 0 END"})
on_objects("x24_turned_box", lambda: {f"b{k}": r6(v) for k, v in enumerate(m.turned_box(S, ("vx", "vy", "vz"), "x"))}, {f"b{k}": f"round({v}, 6)" for k, v in enumerate(["x-(vx*abs(cos(x))+vy*abs(sin(x)))/2", "y-(vx*abs(sin(x))+vy*abs(cos(x)))/2", "z-vz/2", "x+(vx*abs(cos(x))+vy*abs(sin(x)))/2", "y+(vx*abs(sin(x))+vy*abs(cos(x)))/2", "z+vz/2"])})


def x26_x33_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    u = F.col("det") % 640
    crop = m.padded_crop(u, F.col("det") % 480, u + 30, F.col("det") % 480 + 120, 640, 480)
    return d.select("det", r6(m.view_quality("score", "pixels")).alias("quality"), r6(m.vote_weight("score", "pixels")).alias("vote"), *[v.alias(f"crop{k}") for k, v in enumerate(crop)], r6(m.reciprocal_rank(F.when(F.col("det") % 3 > 0, F.col("det") % 7))).alias("rr"), r6(m.rerank_score(F.col("det") % 5 / 2.0 - 1)).alias("rerank"), m.image_id(F.col("day"), F.col("det") % 4).alias("image"), r6(m.depth_meters(F.col("pixels") - 5, 1e-3, 2.0)).alias("depth"))


QUERIES["x26_x33_views"] = x26_x33_views
ORACLES["x26_x33_views"] = f"""WITH {DETECTIONS_SQL}, b AS (SELECT *, (det % 640)::DOUBLE AS u, (det % 480)::DOUBLE AS v, (det % 5)/2.0 - 1 AS k FROM det)
SELECT det, round(score*sqrt(greatest(1, pixels)), 6) AS quality, round(score*sqrt(pixels/500.0), 6) AS vote,
 greatest(0, floor(u-8))::BIGINT AS crop0, greatest(0, floor(v-9.6))::BIGINT AS crop1,
 greatest(least(640, ceil(u+30+8))::BIGINT, greatest(0, floor(u-8))::BIGINT+1) AS crop2, greatest(least(480, ceil(v+120+9.6))::BIGINT, greatest(0, floor(v-9.6))::BIGINT+1) AS crop3,
 round(CASE WHEN det % 3 > 0 THEN 1/(5.0+det % 7) ELSE 0 END, 6) AS rr,
 round(CASE WHEN k BETWEEN 0 AND 1 THEN k WHEN k >= -1 AND k < 0 THEN (k+1)/2 ELSE 1/(1+exp(-k)) END, 6) AS rerank,
 (day*4 + det % 4)::BIGINT AS image, round(CASE WHEN (pixels-5)*1e-3 < 0 OR (pixels-5)*1e-3 > 2 THEN 0 ELSE (pixels-5)*1e-3 END, 6) AS depth FROM b"""

# --- predicates
on_pairs("p01_near", lambda: {"score": p.near(S, A), "linear": p.near_linear(S, A)}, {"score": f"CASE WHEN d > 5 THEN 0 ELSE {GAUSS.format('d', 0.5)} END", "linear": "CASE WHEN d > 5 THEN 0 ELSE exp(-d/2) END"})
on_pairs("p02_on", lambda: {"score": p.on(S, A)}, {"score": f"CASE WHEN h > 1 OR dz < -0.2 OR dz > 0.8 THEN 0 ELSE {GAUSS.format('h', 0.7)}*least(1, ({SIG.format('dz', 0, 0.1)})*({SIG.format('0.5-dz', 0, 0.1)})) END"})
OVER = "CASE WHEN {0} < -0.1 OR h > 2 THEN 0 ELSE (" + SIG.format("{0}", 0.2, 0.15) + ")*" + GAUSS.format("h", 1.0) + " END"
on_pairs("p03_p04_above_below", lambda: {"above": p.above(S, A), "below": p.below(S, A)}, {"above": OVER.replace("{0}", "dz"), "below": OVER.replace("{0}", "(-dz)")})
on_pairs("p05_next_to", lambda: {"score": p.next_to(S, A)}, {"score": f"CASE WHEN h > 2 OR abs(dz) > 1 THEN 0 ELSE {GAUSS.format('h', 1.0)} END"})
on_pairs(
    "p07_inside",
    lambda: {"box": p.inside(S, A, ("a_vx", "a_vy", "a_vz")), "center": p.inside(S, A)},
    {"box": "CASE WHEN {0} <= 1e-6 THEN 1 ELSE exp(-{0}*{0}/(2*0.35*0.35)) END".replace("{0}", "sqrt(" + "+".join(f"pow(greatest(0, abs({v}-a_{v})-(2.5*sqrt(greatest(a_v{v}, 1e-6))+0.1)), 2)" for v in "xyz") + ")"), "center": GAUSS.format("d", 0.75)},
)


def p06_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects between the asked pairs of anchors, each of the query set with the one after it; only those that score at all."""
    o = objects(spark, sf_dir).select("object_idx", "x", "y").dropna()
    # columns that can't be null (nothing is between with NaN) keep the code of the score short enough to be compiled
    o = o.select("object_idx", *[F.coalesce(v, F.lit(float("nan"))).alias(v) for v in "xy"])
    a = anchors(o)
    b = a.select(*[F.col(c).alias("b" + c[1:]) for c in a.columns])
    both = a.join(b, F.col("a_object_idx") + 100 == F.col("b_object_idx")).where(m.horizontal((*A[:2], F.lit(0.0)), ("b_x", "b_y", F.lit(0.0))) >= 0.01)
    # a place has few cells within six metres of a line, so all meet: by cell the fullest one would be one task
    x = dealt(o, "object_idx").join(F.broadcast(both), ~F.col("object_idx").isin(F.col("a_object_idx"), F.col("b_object_idx")))
    score = p.between((*S[:2], None), (*A[:2], None), ("b_x", "b_y", None))
    x = x.where(F.abs(score) >= 1e-6).select("object_idx", "a_object_idx", "b_object_idx", r6(score).alias("score"))
    return x.withColumn("clamped", F.greatest("score", F.lit(0.0)))


QUERIES["p06_j05_between"] = p06_between
ORACLES["p06_j05_between"] = f"""WITH {OBJECTS_SQL}, t AS (SELECT o.object_idx, a.object_idx AS a_object_idx, b.object_idx AS b_object_idx, b.x-a.x AS dx, b.y-a.y AS dy, o.x-a.x AS px, o.y-a.y AS py
 FROM o, o a, o b WHERE a.object_idx % 100 = 0 AND b.object_idx = a.object_idx + 100 AND o.object_idx NOT IN (a.object_idx, b.object_idx)),
 u AS (SELECT *, (px*dx+py*dy)/(dx*dx+dy*dy) AS t FROM t), w AS (SELECT *, (1-2*abs(t-0.5))*exp(-(pow(px-t*dx, 2)+pow(py-t*dy, 2))/2) AS s FROM u)
 SELECT object_idx, a_object_idx, b_object_idx, round(CASE WHEN sqrt(dx*dx+dy*dy) < 0.01 OR t < -0.1 OR t > 1.1 THEN 0 ELSE s END, 6) AS score,
 round(CASE WHEN sqrt(dx*dx+dy*dy) < 0.01 OR t < -0.1 OR t > 1.1 THEN 0 ELSE greatest(s, 0) END, 6) AS clamped FROM w WHERE sqrt(dx*dx+dy*dy) >= 0.01 AND t BETWEEN -0.1 AND 1.1 AND abs(s) >= 1e-6"""


def p08_p10_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, attribute and category predicates; documents stand in for captions, sources for categories, languages for attributes."""
    d = table(spark, sf_dir, "documents")
    region = p.in_region("lang", F.lit("EN "), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.5))
    return d.select("doc_id", region.alias("region"), p.has_attribute("text", F.array("lang"), F.lit("the ")).alias("attribute"), p.is_category("source", "text", F.lit("src1")).alias("category"))


QUERIES["p08_p10_semantic"] = p08_p10_semantic
ORACLES["p08_p10_semantic"] = """SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 WHEN doc_id % 2 = 0 THEN 0.0 END::DOUBLE AS region,
 CASE WHEN contains(lower(text), 'the ') OR lang = 'the ' THEN 1.0 END::DOUBLE AS attribute, CASE WHEN lower(source) = 'src1' THEN 1.0 WHEN contains(lower(text), 'src1') THEN 0.9 END::DOUBLE AS category FROM documents"""


def p11_p12_superlatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir).select("object_idx", *S)
    x = nearest.distance_ranks(o, o.where("object_idx % 100 = 0"))
    # p.rank_score to six places: 1/n's by whole numbers, as rounding each pair's double takes longer than its rank
    score = lambda rank, desired=0: F.floor((F.abs(F.col(rank) - desired) + 2_000_001) / (2 * F.abs(F.col(rank) - desired) + 2)) / 1e6
    return x.select("object_idx", "a_object_idx", score("closest").alias("closest"), score("closest", 1).alias("second"), score("farthest").alias("farthest"))


QUERIES["p11_p12_superlatives"] = p11_p12_superlatives
ORACLES["p11_p12_superlatives"] = f"""{PAIRS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY a_object_idx ORDER BY d, object_idx)-1 AS n, row_number() OVER (PARTITION BY a_object_idx ORDER BY d DESC, object_idx)-1 AS f FROM p)
 SELECT object_idx, a_object_idx, round(1/(n+1.0)::DOUBLE, 6) AS closest, round(1/(abs(n-1)+1.0)::DOUBLE, 6) AS second, round(1/(f+1.0)::DOUBLE, 6) AS farthest FROM k"""
on_pairs(
    "p13_p16_view_relations",
    lambda: {"left": p.beside(F.col("x") * 10 + 320, F.col("a_x") * 10 + 320, 640.0, True), "right": p.beside(F.col("x") * 10 + 320, F.col("a_x") * 10 + 320, 640.0, False), "front": p.in_front("z", "a_z"), "behind": p.in_front("z", "a_z", False)},
    {"left": SIG.format("(a_x-x)*10/640", 0, 0.03), "right": SIG.format("(x-a_x)*10/640", 0, 0.03), "front": f"CASE WHEN z > 1e-6 AND a_z > 1e-6 THEN {SIG.format('a_z-z', 0, 0.3)} ELSE 0 END", "behind": f"CASE WHEN z > 1e-6 AND a_z > 1e-6 THEN {SIG.format('z-a_z', 0, 0.3)} ELSE 0 END"},
)
on_pairs(
    "a17_a18_composition",
    lambda: {"geo": p.geometric([p.near(S, A), F.lit(1.0), F.lit(0.2)]), "soft": p.composed("cos", [p.near(S, A), F.lit(0.6)], 0.25), "hard": F.when((p.near(S, A) >= 0.5) & (p.next_to(S, A) >= 0.5), F.col("cos")).otherwise(0.0)},
    {"geo": f"exp((ln(greatest(1e-6, CASE WHEN d > 5 THEN 0 ELSE {GAUSS.format('d', 0.5)} END))+ln(0.2))/3)", "soft": f"list_cosine_similarity(feature, a_feature)*(0.75+0.25*exp((ln(greatest(1e-6, CASE WHEN d > 5 THEN 0 ELSE {GAUSS.format('d', 0.5)} END))+ln(0.6))/2))", "hard": f"CASE WHEN d <= 5 AND {GAUSS.format('d', 0.5)} >= 0.5 AND h <= 2 AND abs(dz) <= 1 AND {GAUSS.format('h', 1.0)} >= 0.5 THEN list_cosine_similarity(feature, a_feature) ELSE 0 END"},
    of=compared,
)


def t01_t17_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark")
    words = F.split(t.normalized("text"), " ")
    return d.select("item_id", t.normalized("text").alias("norm"), t.singular(F.get(words, F.lit(1))).alias("single"), t.phrase_match("text", F.lit("The")).alias("has_the"), t.any_token_in("text", F.array(F.lit("tion"), F.lit("zzz"))).alias("any_token"), r6(t.overlap_score(words, F.array(F.lit("the"), F.lit("of"), F.lit("with")))).alias("overlap"), t.informative(F.get(words, F.lit(0))).alias("informative"), t.without_article("text").alias("plain"), t.safe_token("text", 20).alias("token"))


QUERIES["t01_t17_strings"] = t01_t17_strings
ORACLES["t01_t17_strings"] = r"""WITH b AS (SELECT item_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM benchmark), w AS (SELECT *, string_split(norm, ' ') AS ws FROM b)
 SELECT item_id, norm, CASE WHEN length(ws[2]) > 3 AND ends_with(ws[2], 'ies') THEN regexp_replace(ws[2], 'ies$', 'y') WHEN length(ws[2]) > 3 AND ends_with(ws[2], 's') THEN regexp_replace(ws[2], 's$', '') ELSE ws[2] END AS single,
 contains(' ' || norm || ' ', ' the ') AS has_the, contains(lower(text), 'tion') OR contains(lower(text), 'zzz') AS any_token,
 round(len(list_intersect(ws, ['the', 'of', 'with']))/sqrt((len(list_distinct(ws))*3)::DOUBLE), 6) AS overlap,
 ws[1] NOT IN ('none', 'object', 'other', 'target', 'thing', 'unknown') AND length(ws[1]) > 0 AS informative,
 regexp_replace(regexp_replace(trim(text), '(?i)^(the|a|an)\s+', ''), '(?i)\s+(that|which)\s+(is|are)$', '') AS plain,
 substring(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 20) AS token FROM w"""


def t11_t12_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('so ```json\n{"score": '), F.col("event_id") % 130, F.lit("}\n``` ok"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('I say "score": '), F.col("event_id") % 77)).otherwise(F.concat(F.lit("about "), F.col("event_id") % 100, F.lit(" of it")))
    return e.select("event_id", r6(t.answer_score(said)).alias("score"))


QUERIES["t11_t12_answers"] = t11_t12_answers
ORACLES["t11_t12_answers"] = "SELECT event_id, round(least(1, CASE event_id % 3 WHEN 0 THEN event_id % 130 WHEN 1 THEN event_id % 77 ELSE event_id % 100 END/100.0)::DOUBLE, 6) AS score FROM events"
