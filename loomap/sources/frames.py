"""Frame indices, benchmark tables and vocabularies as DataFrames.

Two dialects of a frame index are read: one names `rgb, depth, K, T_wc, timestamp`, the other
`rgb_path, depth_path, T_world_cam, frame_id, timestamp_ns`; both come out with the second's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = """struct<cameras:array<string>,frames:array<struct<camera:string,frame_id:bigint,rgb:string,rgb_path:string,depth:string,depth_path:string,
K:array<array<double>>,T_wc:array<array<double>>,T_world_cam:array<array<double>>,timestamp:double,timestamp_ns:bigint>>>"""


def frames(spark: SparkSession, path: str, cameras: list[str] | None = None, stride: int = 1, start: int = 0, end: int | None = None, hz: float = 10.0) -> DataFrame:
    """Frames of an index, in each camera every ``stride``-th from ``start`` to ``end``; an unknown camera is an error.

    A missing stamp is made from the frame number and the rate.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", FRAMES).alias("v"))
    f = whole.select(F.posexplode("v.frames").alias("pos", "f")).select("pos", "f.*")
    f = f.select(F.coalesce("camera", F.lit("0")).alias("camera"), F.coalesce("frame_id", F.col("pos").cast("long")).alias("frame_id"), F.coalesce("rgb_path", "rgb").alias("rgb_path"), F.coalesce("depth_path", "depth").alias("depth_path"), F.flatten("K").alias("K"), F.flatten(F.coalesce("T_world_cam", "T_wc")).alias("T_world_cam"), F.coalesce("timestamp_ns", (F.col("timestamp") * 1e9).cast("long")).alias("stamp_ns"))
    if cameras is not None:
        unknown = set(cameras) - {r["camera"] for r in f.select("camera").distinct().collect()}
        if unknown:
            raise ValueError(f"unknown cameras: {sorted(unknown)}")
        f = f.where(F.col("camera").isin(cameras))
    at = F.row_number().over(Window.partitionBy("camera").orderBy("frame_id")) - 1
    f = f.withColumn("_at", at).where((F.col("_at") >= start) & ((F.col("_at") - start) % stride == 0))
    f = f if end is None else f.where(F.col("_at") < end)
    return f.withColumn("stamp_ns", F.coalesce("stamp_ns", (F.col("frame_id") * F.lit(1e9 / hz)).cast("long"))).drop("_at").orderBy("frame_id", "camera")


def write_frames(df: DataFrame, path: str) -> None:
    """An index as one document that frames() reads, in the second dialect; it is one document by its format, and holds a row for each frame only."""
    rows = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / F.sqrt(F.size(c).cast("double"))).cast("int") - 1), lambda i: F.slice(c, i * F.sqrt(F.size(c).cast("double")).cast("int") + 1, F.sqrt(F.size(c).cast("double")).cast("int")))  # noqa: E731  a square matrix by rows
    f = df.select("frame_id", "camera", F.struct("camera", "frame_id", "rgb_path", "depth_path", rows("K").alias("K"), rows("T_world_cam").alias("T_world_cam"), F.col("stamp_ns").alias("timestamp_ns")).alias("f"))
    whole = f.agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_id", "camera", "f"))), lambda x: x["f"]).alias("frames"))
    whole.select(F.to_json(F.struct("frames")).alias("value")).coalesce(1).write.text(path)


def truth(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def utterances(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark's CSV of utterances: flags, integers and lists are parsed; what can't be is null.

    Distractors are the list column where there is one, else the numbers of a stimulus id
    `scan-class-n-id-id-...` after its third part, without the target.
    """
    t = spark.read.option("header", True).option("escape", '"').csv(path)
    target = F.col("target_id").try_cast("long")
    out = t.select(F.col("scan_id"), target.alias("target_id"), F.col("instance_type"), F.col("utterance"), truth(F.col("mentions_target_class")).alias("mentions_target_class") if "mentions_target_class" in t.columns else F.lit(None).cast("boolean").alias("mentions_target_class"), *[F.col(c) for c in ("stimulus_id", "distractor_ids", "anchor_ids") if c in t.columns])
    listed = F.from_json("distractor_ids", "array<bigint>") if "distractor_ids" in t.columns else F.lit(None).cast("array<bigint>")
    named = F.transform(F.slice(F.split("stimulus_id", "-"), 4, 1000), lambda x: x.try_cast("long")) if "stimulus_id" in t.columns else F.lit(None).cast("array<bigint>")
    out = out.withColumn("distractors", F.filter(F.coalesce(listed, named), lambda x: x.isNotNull() & (x != F.col("target_id"))))
    if "anchor_ids" in t.columns:
        out = out.withColumn("anchor_ids", F.from_json("anchor_ids", "array<bigint>"))
    return out.drop("stimulus_id", "distractor_ids")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Nested statements (regions, texts, variants) as one row each, with a stable uid."""
    schema = "struct<regions:map<string,map<string,array<struct<target_index:string,target_class:string,distractor_ids:array<string>,anchors:map<string,struct<index:string,class:string>>,relation:string,relation_type:string>>>>>"
    v = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]+)*$", 1).alias("scene"), F.from_json("value", schema).alias("v"))
    r = v.select("scene", F.explode("v.regions").alias("region", "texts")).select("scene", "region", F.explode("texts").alias("text", "variants"))
    s = r.select("scene", "region", "text", F.posexplode("variants").alias("variant", "s"))
    uid = F.concat_ws("/", "scene", "region", F.substring(F.sha1("text"), 1, 10), "variant")
    return s.select(uid.alias("uid"), "scene", "region", "text", F.col("s.target_index").try_cast("long").alias("target_id"), F.col("s.target_class").alias("target_class"), F.transform("s.distractor_ids", lambda x: x.try_cast("long")).alias("distractors"), F.transform(F.map_values("s.anchors"), lambda a: a["index"].try_cast("long")).alias("anchors"), F.col("s.relation").alias("relation"), F.col("s.relation_type").alias("relation_type"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of a vocabulary file in its order; blank lines and comments are skipped.  One small file, read as one."""
    whole = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")).alias("v"))
    return whole.select(F.posexplode("v").alias("class_id", "name"))


def detection_packs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all packs under a folder, with kf_index: the place of the pack's file in sorted order."""
    p = spark.read.parquet(path).withColumn("_file", F.input_file_name())
    files = p.select("_file").distinct()
    index = files.withColumn("kf_index", F.row_number().over(Window.orderBy("_file")) - 1)  # one row for each file
    return p.join(index, "_file").drop("_file")
