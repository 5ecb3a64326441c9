"""Aggregates of the object map: fusion, votes, rank fusion, metrics, covers."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.runtime import written


def fused_gaussians(objects: DataFrame, detections: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Objects (id, w, mean m0..m2, variance v0..v2) with detections (id, m0..m2, v0..v2) folded in, weight 1 each.

    Only sums of moments are shuffled; objects without detections stay as they are.
    """
    moments = [F.sum(f"m{k}").alias(f"s{k}") for k in range(3)] + [F.sum(F.col(f"v{k}") + F.col(f"m{k}") * F.col(f"m{k}")).alias(f"q{k}") for k in range(3)]
    sums = detections.groupBy("id").agg(F.count("*").cast("double").alias("n"), *moments)
    both = objects.join(sums, "id", "left")
    n = F.coalesce("n", F.lit(0.0))
    w = F.col("w") + n
    mean = [(F.col("w") * F.col(f"m{k}") + F.coalesce(f"s{k}", F.lit(0.0))) / w for k in range(3)]
    var = [F.greatest(F.lit(floor), (F.col("w") * (F.col(f"v{k}") + F.col(f"m{k}") * F.col(f"m{k}")) + F.coalesce(f"q{k}", F.lit(0.0))) / w - mean[k] * mean[k]) for k in range(3)]
    return both.select("id", w.alias("w"), *[mean[k].alias(f"m{k}") for k in range(3)], *[var[k].alias(f"v{k}") for k in range(3)])


def class_votes(detections: DataFrame, least: float = 0.25) -> DataFrame:
    """(object, class, mass): sum of score * sqrt(pixels / 500) of the scores that are high enough."""
    return detections.where((F.col("score") >= least) & F.col("class").isNotNull()).groupBy("object", "class").agg(F.sum(F.col("score") * F.sqrt(F.col("pixels") / 500)).alias("mass"), F.count("*").alias("n"))


def chosen_label(votes: DataFrame, margin: float = 1.15, least: int = 2) -> DataFrame:
    """(object, class, switched): the class of most mass; switched if it leads the runner-up by the margin on enough votes."""
    by = Window.partitionBy("object").orderBy(F.desc("mass"), "class")
    ranked = votes.withColumns({"_rank": F.row_number().over(by), "_next": F.lead("mass").over(by), "_all": F.sum("n").over(Window.partitionBy("object"))})
    clear = F.coalesce(F.col("mass") >= margin * F.col("_next"), F.lit(True)) & (F.col("_all") >= least)
    return ranked.where("_rank = 1").select("object", "class", "mass", clear.alias("switched"))


def decayed_weight(events: DataFrame, key: Sequence[str], order: str, decay: float = 0.9) -> DataFrame:
    """Weight of the recurrence w = decay * w + 1 over each key's events."""
    by = Window.partitionBy(*key)
    ago = F.count("*").over(by) - F.row_number().over(by.orderBy(order))
    return events.withColumn("_t", F.pow(F.lit(decay), ago)).groupBy(*key).agg(F.sum("_t").alias("weight"))


def rank_fusion(ranks: DataFrame, key: Sequence[str], weights: dict[str, float], k: float = 5.0) -> DataFrame:
    """Sum of weight / (k + rank) over channels; ranks: key, channel, rank (from 1)."""
    w = F.create_map(*[x for c, v in weights.items() for x in (F.lit(c), F.lit(v))])[F.col("channel")]
    return ranks.groupBy(*key).agg(F.sum(w / (F.lit(k) + F.col("rank"))).alias("score"))


def global_ranks(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """Rows with ``rank`` (from 1) within ``by``, of which there may be few with any number of rows.

    The rows are sorted across partitions by range; a row's rank is its place in its partition and the counts of the partitions before, so no task
    holds a whole group.  The sorted rows are written, as their partitions must not change between the two steps.
    """
    at = F.monotonically_increasing_id()
    place = written(rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn("_at", at))
    part, local = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = place.groupBy(part, by).agg(F.count("*").alias("_n"), F.min(local).alias("_low"))  # a row for each partition and group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    both = place.withColumn("_part", part).join(F.broadcast(offsets), ["_part", by])
    return both.withColumn("rank", F.col("_before") + local - F.col("_low") + 1).select(*rows.columns, "rank")


def rank_metrics(ranked: DataFrame, thresholds: Sequence[float] = (0.25, 0.5), tops: Sequence[int] = (1, 3, 5, 10)) -> list[Column]:
    """Aggregates over rows (first_rank by threshold r<t>, null if none): recall at k, mean reciprocal rank, hit rate."""
    out = [F.count("*").alias("n")]
    for t in thresholds:
        r, name = F.col(f"r{int(t * 100)}"), int(t * 100)
        out += [F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall{k}_{name}") for k in tops]
        out += [F.avg(F.coalesce(1 / r, F.lit(0.0))).alias(f"mrr_{name}"), F.avg(F.when(r.isNotNull(), 1.0).otherwise(0.0)).alias(f"hit_{name}")]
    return out


def greedy_cover(pairs: DataFrame) -> DataFrame:
    """(cluster, image, step, covers): images that cover all objects of a cluster, most new ones first, ties by the least image.

    pairs: cluster, image, object.  A cluster is a query's answer of some dozens of objects, so each is one group.
    """

    def pick(pdf):
        left = {image: set(g) for image, g in pdf.groupby("image")["object"]}
        shows: dict = {}
        for image, s in left.items():
            for o in s:
                shows.setdefault(o, []).append(image)
        # an image's count only falls: the first of the heap whose count still holds is the best
        heap = [(-len(s), image) for image, s in left.items()]
        heapq.heapify(heap)
        rows = []
        while heap:
            count, best = heapq.heappop(heap)
            new = left[best]
            if -count != len(new):
                heapq.heappush(heap, (-len(new), best))
            elif new:
                rows.append((pdf["cluster"].iloc[0], best, len(rows), len(new)))
                for o in list(new):
                    for image in shows.pop(o):
                        left[image].discard(o)
        return type(pdf)(rows, columns=["cluster", "image", "step", "covers"])

    return pairs.groupBy("cluster").applyInPandas(pick, "cluster long, image long, step int, covers long")
