"""Stored maps: scene states, databases, sparse models, arrays, runs; and what is written for viewers and evaluation."""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomap.functions import math as m
from loomap.operators.aggregates import global_ranks

#: What a scene state has: columns, their types and what they hold where a stored state is older.
STATE = {
    "object_idx": ("bigint", None), "x": ("double", 0.0), "y": ("double", 0.0), "z": ("double", 0.0), "cov6": ("array<double>", None), "class_id": ("int", -1), "weight": ("double", 1.0),
    "active": ("boolean", True), "caption": ("string", ""), "category": ("string", ""), "feature": ("array<double>", None), "views": ("array<bigint>", None),
}
#: Columns of observations, which are stored only where asked for.
OBSERVATIONS = ("mask_observations", "rgb_observations")


def save_state(state: DataFrame, path: str, with_observations: bool = False, most_views: int | None = None) -> None:
    """Writes a scene state, without its observations unless asked; with at most so many views an object."""
    kept = state if with_observations else state.drop(*OBSERVATIONS)
    if most_views is not None and "views" in kept.columns:
        kept = kept.withColumn("views", F.slice("views", 1, most_views))
    kept.write.parquet(path)


def load_state(spark: SparkSession, path: str, feature_dim: int) -> DataFrame:
    """A scene state with all columns of STATE: absent ones and nulls have their defaults, features are padded or cut to a length."""
    stored = spark.read.parquet(path)
    filled = []
    for name, (kind, default) in STATE.items():
        value = F.col(name).cast(kind) if name in stored.columns else F.lit(None).cast(kind)
        filled.append((value if default is None else F.coalesce(value, F.lit(default))).alias(name))
    rest = [F.col(c) for c in stored.columns if c not in STATE]
    zeros = F.array_repeat(F.lit(0.0), feature_dim)
    whole = stored.select(*filled, *rest)
    return whole.withColumns({"feature": F.slice(F.concat(F.coalesce("feature", zeros), zeros), 1, feature_dim), "views": F.coalesce("views", F.array().cast("array<bigint>"))})


def snapshot(objects: DataFrame, values: DataFrame) -> DataFrame:
    """Objects (object_idx, start, end: pointers) with their rows of a long table (row, value) as an array, in order."""
    at = objects.where("end > start").withColumn("row", F.explode(F.sequence("start", F.col("end") - 1)))
    lists = at.join(values, "row").groupBy("object_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("values"))
    return objects.join(lists, "object_idx", "left").withColumn("values", F.coalesce("values", F.array().cast(dict(lists.dtypes)["values"])))


def sqlite_table(spark: SparkSession, path: str, tables: Sequence[str], columns: dict[str, str], order: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the first of some tables that each database file under a path has; ``columns``: names and types, blobs as binary.

    A file is opened in memory inside a task, so only Spark reads the path.
    """
    schema = ", ".join(f"{n} {t}" for n, t in columns.items())
    kinds = spark.createDataFrame([], schema).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with sqlite3.connect(":memory:") as con:
                    con.deserialize(content.as_py())
                    there = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                    name = next((t for t in tables if t in there), None)
                    if name is None:
                        continue
                    tail = (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else "")
                    cursor = con.execute(f"SELECT {', '.join(columns)} FROM {name}{tail}")
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema=to_arrow(kinds))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def numbers(blob: Column | str, kind: str = "float64") -> Column:
    """A blob's numbers."""
    spark_kind = {"float64": "double", "float32": "float", "int32": "int", "int64": "bigint"}[kind]
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else np.frombuffer(b, kind).tolist()), f"array<{spark_kind}>")(blob)


FACE = r"^pano_camera(\d+)/(.*)$"


def face_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Rows with face_id and frame_id out of an image name; a name of another form is an error."""
    bad = F.raise_error(F.concat(F.lit("unexpected face image name: "), F.col(name)))
    ok = F.col(name).rlike(FACE)
    return names.withColumns({"face_id": F.when(ok, F.regexp_extract(name, FACE, 1).cast("int")).otherwise(bad.cast("int")), "frame_id": F.when(ok, F.regexp_extract(name, FACE, 2)).otherwise(bad.cast("string"))})


def sparse_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """cameras, images, observations and points of a sparse model in its text form (cameras.txt, images.txt, points3D.txt)."""
    num = lambda c, i, kind="double": c[i].cast(kind)
    lines = lambda name: spark.read.text(f"{folder}/{name}").where("value not like '#%' and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("v"))
    v = F.col("v")
    cameras = lines("cameras.txt").select(num(v, 0, "int").alias("camera_id"), v[1].alias("model"), num(v, 2, "int").alias("width"), num(v, 3, "int").alias("height"), F.transform(F.slice(v, 5, 100), lambda x: x.cast("double")).alias("params"))
    points = lines("points3D.txt").select(num(v, 0, "bigint").alias("point_id"), *[num(v, i + 1).alias(a) for i, a in enumerate("xyz")], num(v, 7).alias("error"), F.floor((F.size(v) - 8) / 2).cast("int").alias("track"))
    # an image is two lines, so the file is read as one
    whole = spark.read.text(f"{folder}/images.txt", wholetext=True).select(F.filter(F.split("value", "\r?\n"), lambda x: ~x.startswith("#")).alias("l"))
    pairs = whole.select(F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 2) / 2).cast("int"))).alias("i"), "l").select(F.split(F.trim(F.col("l")[F.col("i") * 2]), r"\s+").alias("v"), F.split(F.trim(F.col("l")[F.col("i") * 2 + 1]), r"\s+").alias("p"))
    image = pairs.where(F.size("v") >= 10).select(num(v, 0, "bigint").alias("image_id"), *[num(v, i + 1).alias(q) for i, q in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))], num(v, 8, "int").alias("camera_id"), F.array_join(F.slice(v, 10, 1000), " ").alias("name"), "p")
    seen = image.where(F.size("p") >= 3).select("image_id", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int") - 1)).alias("i"), "p").select("image_id", *[F.col("p")[F.col("i") * 3 + k].cast("double").alias(a) for k, a in enumerate("uv")], F.col("p")[F.col("i") * 3 + 2].cast("bigint").alias("point_id"))
    return {"cameras": cameras, "images": image.drop("p"), "observations": seen.where("point_id >= 0"), "points": points}


def sparse_depths(model: dict[str, DataFrame], least_track: int = 3, most_error: float = 4.0) -> DataFrame:
    """(image_id, point_id, u, v, depth): the points that an image sees, with tracks and errors that are good enough, before the camera."""
    q = model["images"].select("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
    good = model["points"].where((F.col("track") >= least_track) & (F.col("error") <= most_error))
    both = model["observations"].join(good, "point_id").join(q, "image_id")
    r = m.quaternion_rotation("qx", "qy", "qz", "qw")
    depth = m.rotated(r, ("x", "y", "z"), ("tx", "ty", "tz"))[2]
    return both.select("image_id", "point_id", "u", "v", depth.alias("depth")).where("depth > 1e-6")


def array_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, index, shape, kind, values): the entries along the first axis of an array in each NPZ or NPY file; files in sorted order give ``index`` within each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                loaded = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                array = loaded if isinstance(loaded, np.ndarray) else loaded[key]
                for i, one in enumerate(array):
                    yield pa.RecordBatch.from_pylist([{"file": path_, "index": i, "shape": list(np.shape(one)), "kind": str(array.dtype), "values": np.ascontiguousarray(one).tobytes()}], schema=ARRAY)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "file string, index int, shape array<int>, kind string, values binary")


ARRAY = pa.schema([("file", pa.string()), ("index", pa.int32()), ("shape", pa.list_(pa.int32())), ("kind", pa.string()), ("values", pa.binary())])


def depth_values(values: Column | str, kind: str, scale: float = 1.0, far: float | None = None) -> Column:
    """A depth map's metres: float, or 16-bit numbers times a scale; not a number, negative or too far: 0."""

    def decode(s):
        def one(b):
            d = np.frombuffer(b, kind).astype(float) * scale
            bad = ~np.isfinite(d) | (d < 0) | ((d > far) if far is not None else False)
            return np.where(bad, 0.0, d).tolist()

        return s.map(one)

    return F.pandas_udf(decode, "array<double>")(values)


# --- runs


def _listed(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def latest_run(spark: SparkSession, folder: str) -> str | None:
    """The last of a folder's subfolders by name."""
    fs, path = _listed(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return f"{folder.rstrip('/')}/{names[-1]}" if names else None


def signature(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a stored state was last changed and its size: a state with the same signature needn't be read again."""
    fs, where = _listed(spark, path)
    files = [s for s in fs.listStatus(where) if s.isFile()]
    return max((s.getModificationTime() for s in files), default=0), sum(s.getLen() for s in files)


# --- what is written for others


def ply_lines(points: DataFrame, n: int) -> DataFrame:
    """The lines of an ASCII point cloud: a header, then x y z r g b of each point by ``point_id``."""
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {a}" for a in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    first = points.sparkSession.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "at long, value string")
    body = points.select(F.col("point_id").alias("at"), F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", F.col("r").cast("int"), F.col("g").cast("int"), F.col("b").cast("int")).alias("value"))
    return first.unionByName(body).orderBy("at")


def write_ply(points: DataFrame, path: str) -> None:
    """An ASCII point cloud in one part, as its format is one file; a task writes it line by line."""
    ply_lines(points, points.count()).coalesce(1).select("value").write.text(path)


CLOUD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("pad", "u1")])
MAGIC = b"BGCLOUD\n"


def packed_cloud(points: DataFrame, most: int = 2_000_000) -> bytes:
    """A background cloud of at most ``most`` points for a viewer: magic, count, four zero bytes, then 16 bytes a point."""
    digest = F.md5(F.col("point_id").cast("string"))
    rows = points.orderBy(digest, "point_id").limit(most).select("x", "y", "z", "r", "g", "b").collect()
    out = np.zeros(len(rows), CLOUD)
    for i, name in enumerate(("x", "y", "z", "r", "g", "b")):
        out[name] = [r[i] for r in rows]
    return MAGIC + np.uint32(len(rows)).tobytes() + bytes(4) + out.tobytes()


def viewer_objects(objects: DataFrame, votes: DataFrame) -> DataFrame:
    """One JSON line an active object: its box, colour, caption and three strongest votes; objects: object_idx, x1 .. z2, caption, active; votes: object_idx, class, mass."""
    top = votes.groupBy("object_idx").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("mass")).alias("m"), "class", "mass"))), 1, 3).alias("_top"))
    both = objects.where("active").join(top, "object_idx", "left")
    strongest = F.transform(F.coalesce("_top", F.array().cast(dict(top.dtypes)["_top"])), lambda v: F.struct(v["class"].alias("class"), F.round(v["mass"], 4).alias("mass")))
    box = F.struct(F.array(*[F.round(f"{a}1", 4) for a in "xyz"]).alias("min"), F.array(*[F.round(f"{a}2", 4) for a in "xyz"]).alias("max"))
    return both.select(F.to_json(F.struct("object_idx", "caption", box.alias("aabb"), m.hue_color("object_idx").alias("color"), strongest.alias("votes"))).alias("value"))


def trajectory_lines(poses: DataFrame) -> DataFrame:
    """Lines `time x y z qx qy qz qw` by time; poses: ts (seconds), x y z, qx qy qz qw."""
    line = F.format_string("%.9f %.9g %.9g %.9g %.9g %.9g %.9g %.9g", *[F.col(c).cast("double") for c in ("ts", "x", "y", "z", "qx", "qy", "qz", "qw")])
    return poses.orderBy("ts").select(line.alias("value"))


def traced(events: DataFrame, *order: Column) -> DataFrame:
    """Trace events as JSON lines with a sequence number from 1 in their order; numbers come from a sort across partitions, not from one task."""
    all_ = F.struct(*[F.col(c) for c in events.columns])
    ranked = global_ranks(events.withColumn("_all", F.lit(0)), "_all", *order)
    return ranked.select("rank", F.to_json(F.struct(F.col("rank").alias("seq"), all_.alias("event"))).alias("value"))


def overall_table(metrics: dict[str, float]) -> str:
    """Metrics as a table in Markdown, in their order."""
    rows = [f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in metrics.items()]
    return "\n".join(["| metric | value |", "|-|-|", *rows])


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as one JSON line a row."""
    metrics.coalesce(1).write.json(path)
