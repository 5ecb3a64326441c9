"""Frames in order: windows over them, load shedding, late results, triggers and what is left to do."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.operators.graph import resolve_redirects


def windows(rows: DataFrame, key: str, order: list[str], size: int, overlap: int) -> DataFrame:
    """Each row once for every window of ``size`` rows of its key that holds it (window: the place of its first row); the last ones may be shorter."""
    step = max(1, size - overlap)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    at = rows.withColumn("_i", place)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (size - 1)) / step)) * step
    last = F.floor(F.col("_i") / step) * step
    # the first window starts at row 0 and is there whatever the step
    return at.withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long")))).where(F.col("_i") - F.col("window") < size).drop("_i")


def last_word(rows: DataFrame, key: list[str], window: str, values: list[str]) -> DataFrame:
    """Of several windows' values for a key those of the last."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(window, *values), window).alias("_v")).select(*key, "_v.*")


def shed(frames: DataFrame, key: str, order: list[str], hz: float, cost: float, warm: int) -> DataFrame:
    """(key, frames, kept, fps): frames that come at ``hz`` and take ``cost`` seconds each; those due while the work is behind are skipped.

    With one cost for all, every ceil(cost * hz)-th is kept.  The rate leaves out the first ``warm`` kept frames and their time.
    """
    each = max(1, math.ceil(cost * hz))
    i = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    kept = F.when(F.col("_i") % each == 0, F.col("_i"))
    out = frames.withColumn("_i", i).groupBy(key).agg(F.count("*").alias("frames"), F.count(kept).alias("kept"), F.max(kept).alias("_last"))
    spent = F.col("_last") / hz + cost - warm * each / hz
    return out.select(key, "frames", "kept", F.round(F.greatest(F.lit(0), F.col("kept") - warm) / F.greatest(F.lit(1.0), spent), 4).alias("fps"))


def late_results(results: DataFrame, objects: DataFrame, redirects: DataFrame, order: list[str]) -> DataFrame:
    """The latest result of each object that is active and not locked; results of merged objects count for their winner.

    results: object_idx and more; objects: object_idx, active, locked; redirects: loser, winner.
    """
    ends = resolve_redirects(redirects).select(F.col("loser").alias("object_idx"), "winner")
    at = results.join(ends, "object_idx", "left").withColumn("object_idx", F.coalesce("winner", "object_idx")).drop("winner")
    open_ = at.join(objects.where("active and not locked").select("object_idx"), "object_idx", "left_semi")
    rest = [c for c in open_.columns if c != "object_idx"]
    return open_.groupBy("object_idx").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select("object_idx", "_r.*")


def due(step: str, every: int, after: int = 0) -> Column:
    """Whether something is done at this step."""
    return F.col(step) % every == after


def remaining(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What isn't done yet, by key."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")
