"""Candidate pools, class filters, anchors and predictions of the relational query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.functions import text as t
from loomap.functions.math import distance
from loomap.operators.graph import resolve_redirects

#: Anchors that are tried for a candidate, and the deepest a pool by similarity goes.
TRIED, DEEP = 3, 30


def candidates(objects: DataFrame, redirects: DataFrame, mode: str = "active") -> DataFrame:
    """The objects of a pool: ``active``, ``all``, or ``active_plus_redirect`` (also those merged into one that is active)."""
    if mode == "all":
        return objects
    active = objects.where("active")
    if mode == "active":
        return active
    if mode != "active_plus_redirect":
        raise ValueError(f"unknown pool: {mode}")
    ends = resolve_redirects(redirects).join(active.select(F.col("object_idx").alias("winner")), "winner", "left_semi")
    return active.unionByName(objects.where("not active").join(ends.select(F.col("loser").alias("object_idx")), "object_idx", "left_semi"))


def of_class(objects: DataFrame, phrase: str, least: int = 2) -> DataFrame:
    """Objects with ``matched`` (category or, where that tells nothing, caption names the phrase's class) and ``kept``: matched, or all if fewer than ``least`` are."""
    terms = t.class_terms(F.lit(phrase))
    told = t.informative(t.normalized("category"))
    matched = F.when(told, t.matches_class("category", terms)).otherwise(t.matches_class("caption", terms))
    found = objects.withColumn("matched", matched)
    enough = found.agg((F.count(F.when(F.col("matched"), 1)) >= least).alias("_enough"))  # one row
    return found.join(F.broadcast(enough)).withColumn("kept", F.col("matched") | ~F.col("_enough")).drop("_enough")


def with_head_noun(objects: DataFrame, phrase: str) -> DataFrame:
    """Objects with ``gate``: whether caption or category has the phrase's head noun; null if no object does."""
    found = objects.withColumn("gate", t.has_head_noun("caption", "category", t.head_noun_keys(phrase)))
    some = found.agg(F.max("gate").alias("_some"))  # one row
    return found.join(F.broadcast(some)).withColumn("gate", F.when(F.col("_some"), F.col("gate"))).drop("_some")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; all of them where k isn't positive."""
    return df.orderBy(*order).limit(k) if k > 0 else df


def anchors(scored: DataFrame, k: int = 5, ratio: float = 0.0, prune: Column | None = None) -> DataFrame:
    """The anchors of one description, (object_idx, score, rank): the k best, or (with a ratio) of the DEEP best those of at least ratio times the best score.

    ``prune`` tells which of them a predicate of the anchor itself leaves; if it leaves none, the best stays.
    """
    best = top(scored, DEEP if ratio > 0 else k, F.round("score", 9).desc(), "object_idx")
    rank = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "object_idx"))  # of at most DEEP rows
    best = best.withColumn("rank", rank)
    if ratio > 0:
        most = F.max("score").over(Window.partitionBy())
        best = best.withColumn("_most", most).where((F.col("_most") <= 0) | (F.col("score") >= ratio * F.col("_most"))).drop("_most")
    if prune is not None:
        left = F.max(prune.cast("int")).over(Window.partitionBy())
        best = best.withColumn("_left", left).where(prune | ((F.col("_left") == 0) & (F.col("rank") == 1))).drop("_left")
    return best


def nearest_anchors(objects: DataFrame, pool: DataFrame, tried: int = TRIED) -> DataFrame:
    """Objects with each of the ``tried`` nearest anchors of a pool (object_idx, x, y, z as a_*), itself never; the pool has DEEP rows at most."""
    row = pool.agg(F.collect_list(F.struct("a_object_idx", "a_x", "a_y", "a_z")).alias("_pool"))  # one row of DEEP at most
    both = objects.join(F.broadcast(row))
    others = F.filter("_pool", lambda a: a["a_object_idx"] != F.col("object_idx"))
    apart = lambda a: distance(("x", "y", "z"), (a["a_x"], a["a_y"], a["a_z"]))
    near = F.slice(F.sort_array(F.transform(others, lambda a: F.struct(apart(a).alias("d"), a["a_object_idx"].alias("a_object_idx"), a["a_x"].alias("a_x"), a["a_y"].alias("a_y"), a["a_z"].alias("a_z")))), 1, tried)
    return both.withColumn("_a", F.explode(near)).select(*objects.columns, "_a.*")


def relative_decay(scored: DataFrame, satisfied: Column, floor: float = 1.0, scale: float = 0.35) -> DataFrame:
    """Rows (score, d) with score decayed by how much farther than the nearest satisfied row they are; others keep theirs."""
    least = scored.agg(F.min(F.when(satisfied, F.col("d"))).alias("_least"))  # one row
    tau = F.greatest(F.lit(floor), scale * F.col("_least"))
    decayed = F.col("score") * F.exp(-F.greatest(F.lit(0.0), F.col("d") - F.col("_least")) / tau)
    return scored.join(F.broadcast(least)).withColumn("score", F.when(satisfied, decayed).otherwise(F.col("score"))).drop("_least")


def predictions(clusters: DataFrame, geometry: DataFrame, most: int = 20) -> DataFrame:
    """(rank, object_idx): clusters (cluster_rank, place, object_idx) one after another, each object where it comes first, objects without geometry left out."""
    first = clusters.join(geometry.select("object_idx"), "object_idx", "left_semi").groupBy("object_idx").agg(F.min(F.struct("cluster_rank", "place")).alias("at"))
    best = first.orderBy("at", "object_idx").limit(most)
    return best.select(F.row_number().over(Window.orderBy("at", "object_idx")).alias("rank"), "object_idx")  # of ``most`` rows


def aliases(objects: DataFrame, redirects: DataFrame, most: int = 2) -> DataFrame:
    """(canonical, alias, place): each object that others were merged into, and of itself and these the first ``most`` by weight, itself first."""
    group = resolve_redirects(redirects).select(F.col("winner").alias("canonical"), F.col("loser").alias("alias"))
    heads = group.select("canonical").distinct().withColumn("alias", F.col("canonical"))
    rows = group.unionByName(heads).join(objects.select(F.col("object_idx").alias("alias"), "weight"), "alias")
    place = F.row_number().over(Window.partitionBy("canonical").orderBy((F.col("alias") != F.col("canonical")), F.desc("weight"), "alias"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("canonical", "alias", "place")


def mentioned_rooms(queries: DataFrame, key: str, said: str, labels: DataFrame) -> DataFrame:
    """(key, region): of the labels (label, region) that stand after a preposition in a query the longest, the first of equally long ones; null if there is none.

    A preposition's occurrences are cut out of the query, so a label is looked up by what follows and not held against every query.
    """
    low = F.lower(F.col(said))
    # a preposition inside another one ends where that does, so matches that don't overlap are enough
    after = F.explode(F.regexp_extract_all(low, F.lit(f"(?s)(?:{'|'.join(sorted(t.ROOM_PREPOSITIONS, key=len, reverse=True))})(?=(.*))"), F.lit(1)))
    sizes = labels.select(F.length("label").alias("_n")).where("_n > 0").distinct()  # a few lengths
    rest = queries.select(key, after.alias("_rest")).join(F.broadcast(sizes), F.length("_rest") >= F.col("_n")).select(key, F.expr("substring(_rest, 1, _n)").alias("_label"))
    hit = rest.join(labels.select(F.lower("label").alias("_label"), "region"), "_label")
    best = hit.groupBy(key).agg(F.max_by("region", F.struct(F.length("_label"), -F.col("region"))).alias("region"))
    return queries.select(key).join(best, key, "left")
