"""Stand-in scenes: the driver's tables as objects, detections, images and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_idx, position x y z, variances vx vy vz, class_id, weight, active, region_id, feature."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    return e.select(
        F.col("vec_id").alias("object_idx"),
        *[(10 * at(k)).alias(n) for k, n in enumerate("xyz")],
        *[(0.01 + F.abs(at(3 + k))).alias(n) for k, n in enumerate(("vx", "vy", "vz"))],
        F.col("label").cast("int").alias("class_id"),
        (F.col("vec_id") % 5 + 1).cast("double").alias("weight"),
        (F.col("vec_id") % 11 != 0).alias("active"),
        (F.col("vec_id") % 25).cast("int").alias("region_id"),
        F.col("embedding").cast("array<double>").alias("feature"),
    )


#: The same in DuckDB, for the start of a WITH list.
OBJECTS_SQL = """o AS (SELECT vec_id AS object_idx, 10*embedding[1]::DOUBLE AS x, 10*embedding[2]::DOUBLE AS y, 10*embedding[3]::DOUBLE AS z,
  0.01+abs(embedding[4]::DOUBLE) AS vx, 0.01+abs(embedding[5]::DOUBLE) AS vy, 0.01+abs(embedding[6]::DOUBLE) AS vz, label::INT AS class_id,
  (vec_id % 5 + 1)::DOUBLE AS weight, vec_id % 11 <> 0 AS active, (vec_id % 25)::INT AS region_id, embedding::DOUBLE[] AS feature FROM embeddings)"""


def anchors(objects_: DataFrame) -> DataFrame:
    """The query set: every object whose index is divisible by 100, its columns with a_ before them."""
    some = objects_.where("object_idx % 100 = 0")
    return some.select(*[F.col(k).alias(f"a_{k}") for k in some.columns])


PAIRS_SQL = f"""WITH {OBJECTS_SQL}, p AS (SELECT o.*, a.object_idx AS a_object_idx, a.x AS a_x, a.y AS a_y, a.z AS a_z, a.vx AS a_vx, a.vy AS a_vy, a.vz AS a_vz,
  a.class_id AS a_class_id, a.region_id AS a_region_id, a.feature AS a_feature,
  sqrt((o.x-a.x)*(o.x-a.x)+(o.y-a.y)*(o.y-a.y)+(o.z-a.z)*(o.z-a.z)) AS d, sqrt((o.x-a.x)*(o.x-a.x)+(o.y-a.y)*(o.y-a.y)) AS h, o.z-a.z AS dz
  FROM o, o AS a WHERE a.object_idx % 100 = 0 AND a.object_idx <> o.object_idx)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det, image_id (forty events one after another), object (user), day, class, score, pixels, ts."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.select(F.col("event_id").alias("det"), F.floor(F.col("event_id") / 40).alias("image_id"), F.col("user_id").alias("object"), day.cast("int").alias("day"), F.col("event_type").alias("class"), F.col("value").alias("score"), (F.col("event_id") % 3000).cast("long").alias("pixels"), "ts")


DETECTIONS_SQL = """det AS (SELECT event_id AS det, event_id // 40 AS image_id, user_id AS object,
  date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, event_type AS class, value AS score, (event_id % 3000)::BIGINT AS pixels, ts FROM events)"""


def object_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object, image: the parts and orders of lineitem."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_orderkey").alias("image")).distinct()


#: What the parts' nouns stand for.
FURNITURE = {"ring": "dining table", "plate": "chair", "gear": "doors", "bolt": "window", "rod": "shelf", "widget": "picture frame", "gizmo": "trash can", "anvil": "couch"}


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_brand, noun, phrase, caption: the parts as pieces of furniture."""
    part = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    noun = F.create_map(*[F.lit(x) for pair in FURNITURE.items() for x in pair])[word[1]]
    part = part.withColumn("noun", F.coalesce(noun, word[1])).withColumn("phrase", F.concat_ws(" ", word[0], "noun"))
    return part.select("p_partkey", "p_brand", "noun", "phrase", F.concat("phrase", F.lit(" by the "), F.lower("p_type")).alias("caption"))


CAPTIONED_SQL = f"""named AS (SELECT *, phrase || ' by the ' || lower(p_type) AS caption FROM (SELECT p_partkey, p_brand, p_type, noun, split_part(p_name, ' ', 1) || ' ' || noun AS phrase
  FROM (SELECT *, CASE split_part(p_name, ' ', 2) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FURNITURE.items())} ELSE split_part(p_name, ' ', 2) END AS noun FROM part)))"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(loser, winner): the objects that aren't active were merged, every second of them into one that was merged itself."""
    o = objects(spark, sf_dir).where("not active").select(F.col("object_idx").alias("loser"))
    return o.withColumn("winner", F.when(F.col("loser") % 22 == 0, F.col("loser") + 11).otherwise(F.col("loser") + 1))
