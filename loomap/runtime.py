"""Where intermediate results go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where none is set and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found is None and current.isDefined():
        return current.get()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomap-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, and read it back.

    What a job shuffled is removed when it ends, as the table is all that is read later: the first call sets this for the session.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/loomap-{uuid.uuid4().hex}"
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dealt(df: DataFrame, key: str, rows: int = 4096) -> DataFrame:
    """The rows in as many partitions as have ``rows`` each, by a hash of ``key``: for joins without a key, whose work is not the bytes read."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made, once all that needs them is written too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
