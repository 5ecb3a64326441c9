"""The map as a stream: each micro-batch of detections is folded into the object table.

State is a table of moments (id, w, s0..s2, q0..q2): sums, so a batch is one more row for each object and
the fold is an addition.  A batch is written under its id, so one that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MOMENTS = ["w", *[f"{a}{k}" for a in "sq" for k in range(3)]]


def moments(detections: DataFrame) -> DataFrame:
    """Sums over detections (id, m0..m2, v0..v2)."""
    return detections.groupBy("id").agg(F.count("*").cast("double").alias("w"), *[F.sum(f"m{k}").alias(f"s{k}") for k in range(3)], *[F.sum(F.col(f"v{k}") + F.col(f"m{k}") * F.col(f"m{k}")).alias(f"q{k}") for k in range(3)])


def start(detections: DataFrame, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Folds a stream of detections into the table at ``state``."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        moments(batch).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return detections.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def objects(spark: SparkSession, state: str, floor: float = 1e-6) -> DataFrame:
    """The object table: id, w, means and variances."""
    total = spark.read.parquet(state).groupBy("id").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    mean = [F.col(f"s{k}") / F.col("w") for k in range(3)]
    return total.select("id", "w", *[mean[k].alias(f"m{k}") for k in range(3)], *[F.greatest(F.lit(floor), F.col(f"q{k}") / F.col("w") - mean[k] * mean[k]).alias(f"v{k}") for k in range(3)])
