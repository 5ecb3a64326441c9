"""Regions of a map: components of near objects, halved while they are too wide, with the small ones taken in by their neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomap.operators import graph, spatial

SPLIT = "object_idx long, x double, y double, z double, region long"
#: Above so many members a region's diameter is twice its radius.
EXACT = 50


def diameter(p: np.ndarray) -> float:
    if len(p) > EXACT:
        return 2 * float(np.linalg.norm(p - p.mean(0), axis=1).max())
    return float(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)).max()) if len(p) else 0.0


def halves(p: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Which of two means each point is nearer to, from the point farthest from the middle and the one farthest from that."""
    ends = [int(np.linalg.norm(p - p.mean(0), axis=1).argmax())]
    ends.append(int(np.linalg.norm(p - p[ends[0]], axis=1).argmax()))
    means = p[ends].copy()
    for _ in range(rounds):
        second = np.linalg.norm(p - means[1], axis=1) < np.linalg.norm(p - means[0], axis=1)
        if second.all() or not second.any():
            return np.arange(len(p)) >= len(p) // 2
        new = np.stack([p[~second].mean(0), p[second].mean(0)])
        if np.allclose(new, means):
            break
        means = new
    return second


def split(members: pd.DataFrame, widest: float, least: int) -> pd.DataFrame:
    """A component's members by the region that they end in (named by its least member); halves that are too small are dropped."""
    todo, out = [members.sort_values("object_idx")], []
    while todo:
        part = todo.pop()
        if len(part) < least:
            continue
        p = part[["x", "y", "z"]].to_numpy()
        if diameter(p) <= widest:
            out.append(part.assign(region=part["object_idx"].min()))
            continue
        second = halves(p)
        todo += [part[~second], part[second]]
    columns = ["object_idx", "x", "y", "z", "region"]
    return pd.concat(out)[columns] if out else pd.DataFrame([], columns=columns)


def regions(objects: DataFrame, edges: DataFrame, radius: float = 2.0, least: int = 2, widest: float = 5.0) -> DataFrame:
    """(object_idx, region): objects (object_idx, x, y, z) joined by edges (a, b), in regions named by their least member.

    A component is a scene's at most, and is split in one pandas group.  Small components go to the nearest region within 1.5 times the
    radius; if no component is large, all the small ones are one region.
    """
    roots = graph.components(edges).select(F.col("node").alias("object_idx"), "root")
    o = objects.select("object_idx", "x", "y", "z").join(roots, "object_idx", "left").withColumn("root", F.coalesce("root", "object_idx"))
    sizes = o.groupBy("root").agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    o = o.join(sizes.select("root", "n"), "root")
    if sizes.where(F.col("n") >= least).isEmpty():
        total = o.agg(F.min("object_idx").alias("region"), F.count("*").alias("all"))
        return o.join(F.broadcast(total.where(F.col("all") >= least))).select("object_idx", "region")
    large = o.where(F.col("n") >= least).drop("n").groupBy("root").applyInPandas(lambda part: split(part, widest, least), SPLIT)
    middles = large.groupBy("region").agg(*[F.avg(a).alias(f"a_{a}") for a in "xyz"])
    small = sizes.where(F.col("n") < least).select("root", *[F.col(f"c{a}").alias(a) for a in "xyz"])
    near = spatial.pairs_within(small, middles, 1.5 * radius).groupBy("root").agg(F.min(F.struct("d", "region")).alias("best"))
    taken = o.join(near, "root").select("object_idx", F.col("best.region").alias("region"))
    return large.select("object_idx", "region").unionByName(taken)
