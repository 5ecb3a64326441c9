"""Fits and statistics by group: weighted covariances, robust scales, merge guards, representative views."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomap.functions.math import Vec, c
from loomap.runtime import written

AXES = ("x", "y", "z")
#: The packed covariance: pairs of axes.
PACKED = ("xx", "xy", "xz", "yy", "yz", "zz")


def weighted_moments(points: DataFrame, key: str, weight: str = "w") -> DataFrame:
    """By key: n (sum of weights), mx my mz and the packed sample covariance cxx .. czz; only sums are shuffled."""
    w = F.col(weight)
    sums = [F.sum(w).alias("n"), *[F.sum(w * F.col(a)).alias(f"s{a}") for a in AXES], *[F.sum(w * F.col(p[0]) * F.col(p[1])).alias(f"q{p}") for p in PACKED]]
    s = points.groupBy(key).agg(*sums)
    n = F.greatest(F.col("n"), F.lit(1.0))
    cov = [((F.col(f"q{p}") - F.col(f"s{p[0]}") * F.col(f"s{p[1]}") / n) / F.greatest(F.col("n") - 1, F.lit(1.0))).alias(f"c{p}") for p in PACKED]
    return s.select(key, "n", *[(F.col(f"s{a}") / n).alias(f"m{a}") for a in AXES], *cov)


def fused_gaussians_full(objects: DataFrame, detections: DataFrame) -> DataFrame:
    """Objects (id, w, mx.., cxx..) with detections (id, mx.., cxx..) folded in, weight 1 each, on full covariances."""
    second = lambda p: F.col(f"c{p}") + F.col(f"m{p[0]}") * F.col(f"m{p[1]}")
    sums = detections.groupBy("id").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"m{a}").alias(f"s{a}") for a in AXES], *[F.sum(second(p)).alias(f"q{p}") for p in PACKED])
    both = objects.join(sums, "id", "left").fillna(0.0, ["n", *[f"s{a}" for a in AXES], *[f"q{p}" for p in PACKED]])
    w = F.col("w") + F.col("n")
    mean = {a: (F.col("w") * F.col(f"m{a}") + F.col(f"s{a}")) / w for a in AXES}
    cov = [((F.col("w") * second(p) + F.col(f"q{p}")) / w - mean[p[0]] * mean[p[1]]).alias(f"c{p}") for p in PACKED]
    return both.select("id", w.alias("w"), *[mean[a].alias(f"m{a}") for a in AXES], *cov)


def mean_features(rows: DataFrame, key: str, weight: Column, feature: str = "feature", size: int = 64) -> DataFrame:
    """(key, weight, feature): the weighted mean of features of ``size`` values; an element is a sum, so nothing is collected."""
    w = rows.select(key, weight.alias("_w"), feature)
    total = w.groupBy(key).agg(F.sum("_w").alias("weight"), *[F.sum(F.col("_w") * F.col(feature)[k]).alias(f"_f{k}") for k in range(size)])
    return total.select(key, "weight", F.array(*[F.col(f"_f{k}") / F.col("weight") for k in range(size)]).alias(feature))


def scale_fit(pairs: DataFrame, key: str, rounds: int = 3, times: float = 2.0, least: int = 8) -> DataFrame:
    """(key, alpha, n_inliers, n_total, ok): metric = alpha * sparse through the origin, refitted on the pairs within ``times`` the median residual.

    pairs: key, metric, sparse, w (weights).  A round is two aggregates by key, and a table in the shared folder; groups with too few pairs have alpha 1.
    """
    good = pairs.where("metric > 1e-6 and sparse > 1e-6 and abs(metric) < 1e300 and abs(sparse) < 1e300").withColumn("_in", F.lit(True))
    total = good.groupBy(key).agg(F.count("*").alias("n_total"))
    for k in range(rounds):
        inlier = F.col("_in")
        sums = good.groupBy(key).agg(F.count(F.when(inlier, 1)).alias("_n"), F.sum(F.when(inlier, F.col("w") * F.col("metric") * F.col("sparse"))).alias("_ms"), F.sum(F.when(inlier, F.col("w") * F.col("sparse") * F.col("sparse"))).alias("_ss"))
        fit = sums.select(key, (F.col("_n") >= least).alias("_go"), (F.col("_ms") / F.col("_ss")).alias("_alpha"))
        good = good.join(fit, key).withColumn("_r", F.abs(F.col("metric") - F.col("_alpha") * F.col("sparse")))
        if k:
            good = good.withColumn("alpha", F.when(F.col("_go"), F.col("_alpha")).otherwise(F.col("alpha")))
        else:
            good = good.withColumn("alpha", F.when(F.col("_go"), F.col("_alpha")).otherwise(F.lit(1.0)))
        middle = good.groupBy(key).agg(F.median(F.when(F.col("_in"), F.col("_r"))).alias("_m"))
        good = good.join(middle, key).withColumn("_in", F.when(F.col("_go"), F.col("_r") <= F.greatest(F.col("_m") * times, F.lit(1e-6))).otherwise(F.col("_in"))).drop("_go", "_alpha", "_r", "_m")
        good = written(good)  # a round uses the pairs three times
    found = good.groupBy(key).agg(F.first("alpha").alias("alpha"), F.count(F.when(F.col("_in"), 1)).alias("n_inliers"))
    return found.join(total, key).withColumn("ok", (F.col("n_inliers") >= least) & (F.col("n_total") >= least))


@pandas_udf(T.ArrayType(T.DoubleType()))
def eigen_clipped(packed: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Packed covariances with their eigenvalues clipped to [low, high]; a batch of matrices at once."""
    s = np.stack(packed.to_numpy()).astype(float) if len(packed) else np.zeros((0, 6))
    full = s[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(full)
    values = np.clip(values, low.to_numpy(float)[:, None], high.to_numpy(float)[:, None])
    out = (vectors * values[:, None, :]) @ vectors.transpose(0, 2, 1)
    return pd.Series(list(out.reshape(-1, 9)[:, [0, 1, 2, 4, 5, 8]]))


def guarded_winners(proposed: DataFrame, cannot: DataFrame, most: float = 1.0, growth: float = 2.75) -> DataFrame:
    """(object_idx, winner): proposed merges after three guards; whoever is refused wins itself.

    proposed: object_idx, winner, d (their distance), and the object's box x1 .. z2.  Merges over ``most`` apart are refused; then
    groups with a forbidden pair (cannot: a, b) dissolve; then groups whose common box is more than ``growth`` times their largest member's.
    """
    near = proposed.withColumn("winner", F.when((F.col("object_idx") != F.col("winner")) & (F.col("d") > most), F.col("object_idx")).otherwise(F.col("winner")))
    who = near.select("object_idx", "winner")
    sides = cannot.join(who.select(F.col("object_idx").alias("a"), F.col("winner").alias("_wa")), "a").join(who.select(F.col("object_idx").alias("b"), F.col("winner").alias("_wb")), "b")
    broken = sides.where("_wa = _wb").select(F.col("_wa").alias("winner")).distinct().withColumn("_broken", F.lit(True))
    near = near.join(broken, "winner", "left")
    near = near.withColumn("winner", F.when(F.col("_broken"), F.col("object_idx")).otherwise(F.col("winner"))).drop("_broken")
    volume = lambda low, high: (high("x2") - low("x1")) * (high("y2") - low("y1")) * (high("z2") - low("z1"))
    boxes = near.groupBy("winner").agg(F.count("*").alias("_n"), volume(lambda k: F.min(k), lambda k: F.max(k)).alias("_whole"), F.max(volume(F.col, F.col)).alias("_largest"))
    grown = boxes.where((F.col("_n") >= 2) & (F.col("_whole") > growth * F.col("_largest"))).select("winner", F.lit(True).alias("_grown"))
    near = near.join(grown, "winner", "left")
    return near.select("object_idx", F.when(F.col("_grown"), F.col("object_idx")).otherwise(F.col("winner")).alias("winner"))


def two_views(views: DataFrame, key: str, view: str, area: str, vector: Sequence[str], other: str = "unlike") -> DataFrame:
    """(key, first, second): each key's view of largest area (ties to the first), and of the rest the one least like it by cosine (ties to the first).

    Both picks are aggregates; the first goes back to its views by a join.
    """
    first = views.groupBy(key).agg(F.max_by(F.struct(view, *vector), F.struct(area, -F.col(view))).alias("_f"))
    both = views.join(first, key).where(F.col(view) != F.col(f"_f.{view}"))
    dot = lambda p, q: sum((c(f"{p}{a}") * c(f"{q}{a}") for a in vector[1:]), c(f"{p}{vector[0]}") * c(f"{q}{vector[0]}"))
    cos = dot("", "_f.") / (F.sqrt(dot("", "")) * F.sqrt(dot("_f.", "_f.")))
    second = both.groupBy(key).agg(F.min_by(F.col(view), F.struct(F.round(cos, 9), F.col(view))).alias("second"))
    return first.select(key, F.col(f"_f.{view}").alias("first")).join(second, key, "left")


def tracked_landmarks(seen: DataFrame, least: int) -> DataFrame:
    """(kf, tracked): how many of a keyframe's landmarks at least ``least`` keyframes see; seen: distinct kf, lm."""
    often = seen.groupBy("lm").agg(F.count("*").alias("n"))
    return seen.join(often, "lm").groupBy("kf").agg(F.count(F.when(F.col("n") >= least, 1)).alias("tracked"))


def keyframe_needed(elapsed: Column, distance: Column, tracked: Column, reliable: Column, reliable_ref: Column, keyframes: Column, max_interval: float = 1.0, min_interval: float = 0.1, max_distance: float = 1.0, changed: float = 0.5, enough: int = 100, almost_all: float = 0.9) -> Column:
    """Whether a frame becomes a keyframe: time, way, a changed view or few landmarks ask for it, and neither haste, loss of tracking nor an unchanged view forbids it."""
    asked = (elapsed >= max_interval) | (distance > max_distance) | (reliable < reliable_ref * changed) | (reliable < enough)
    return asked & ((keyframes <= 5) | (elapsed >= min_interval)) & (tracked >= 15) & ~(reliable > reliable_ref * almost_all)


def capped_sample(rows: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows a group: those whose seeded digest is least; reruns agree."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(digest, key))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def visible(z: Column, depth: Column) -> Column:
    """Whether a point isn't hidden: its depth agrees with the map's to 15 cm or a twentieth."""
    return (depth > 0) & ~F.isnan(depth) & (F.abs(z - depth) < F.greatest(F.lit(0.15), 0.05 * z))


def sky(r: Column, g: Column, b: Column, row: Column, height: int, bright: float = 160.0, pale: float = 80.0, share: float = 0.65) -> Column:
    """Whether a pixel of the image's upper part is bright and pale."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    return (row < share * height) & (top >= bright) & (F.when(top > 0, 255 * (top - low) / top).otherwise(0.0) <= pale)


def unprojected(points: DataFrame, fx: float, fy: float, cx: float, cy: float, stride: int, far: float, least: float, height: int) -> DataFrame:
    """Every ``stride``-th pixel (u, v, depth, conf, r, g, b) as a point px, py, pz, without what is too far, unsure or sky."""
    kept = points.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0) & (F.col("depth") > 0) & (F.col("depth") <= far) & (F.col("conf") >= least) & ~sky(F.col("r"), F.col("g"), F.col("b"), F.col("v"), height))
    return kept.withColumns({"px": (F.col("u") - cx) / fx * F.col("depth"), "py": (F.col("v") - cy) / fy * F.col("depth"), "pz": F.col("depth").cast("double")})


def merged_history(objects: DataFrame, winners: DataFrame) -> DataFrame:
    """(winner, history): the winner's history and current value, then each loser's in order; objects: object_idx, history, current."""
    own = objects.withColumn("_whole", F.concat("history", F.array("current")))
    rows = winners.select("loser", "winner").unionByName(winners.select(F.col("winner").alias("loser"), "winner").distinct())
    both = rows.join(own, F.col("loser") == F.col("object_idx"))
    parts = F.array_sort(F.collect_list(F.struct((F.col("loser") != F.col("winner")).alias("_after"), "loser", "_whole")))
    return both.groupBy("winner").agg(F.flatten(F.transform(parts, lambda p: p["_whole"])).alias("history"))


def box_of(mean: Vec, variance: Vec, k: float = 2.5) -> list[Column]:
    """x1, y1, z1, x2, y2, z2 by deviations."""
    half = [k * F.sqrt(F.greatest(c(v), F.lit(1e-4))) for v in variance]
    return [(c(a) - h).alias(f"{n}1") for a, h, n in zip(mean, half, AXES, strict=True)] + [(c(a) + h).alias(f"{n}2") for a, h, n in zip(mean, half, AXES, strict=True)]
