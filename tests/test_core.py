"""The object map: every query against its SQL, golden values, sources and streams."""

import json
import math
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from loomap import catalog
from loomap.functions import math as m
from loomap.operators import graph
from loomap.operators import predicates as p
from loomap.sources import frames
from loomap.streaming import fold, windows

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.8g}"
    return str(v) if not isinstance(v, (list, tuple)) else [plain(x) for x in v]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cur = tables.execute(catalog.ORACLES[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == columns
    assert got == sorted(str([plain(r[at.index(c)]) for c in columns]) for r in cur.fetchall())


def test_cover_covers(spark):
    df = catalog.QUERIES["a34_j28_covering_images"](spark, SF)
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    want = line.groupBy(F.col("l_suppkey").alias("cluster")).agg(F.countDistinct("l_partkey").alias("n"))
    assert df.groupBy("cluster").agg(F.sum("covers").alias("n")).join(want, ["cluster", "n"], "left_anti").count() == 0


def test_golden_values(spark):
    row = spark.range(1).select(
        p.near((0.5, 0.0, 0.0), (0.0, 0.0, 0.0)).alias("near"), p.on((0.3, 0.0, 0.25), (0.0, 0.0, 0.0)).alias("on"), p.above((0.4, 0.0, 0.5), (0.0, 0.0, 0.0)).alias("above"),
        p.next_to((0.8, 0.0, 0.0), (0.0, 0.0, 0.0)).alias("next"), p.between((0.3, 0.5, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)).alias("between"), p.between((-0.05, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)).alias("behind"),
        p.inside((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.04, 0.04, 0.04)).alias("inside"), p.beside(F.lit(288.0), F.lit(320.0), 640.0, True).alias("left"), p.in_front(F.lit(1.0), F.lit(1.3)).alias("front"),
        p.geometric(F.array(F.lit(0.6), F.lit(1.0), F.lit(0.2))).alias("geo"), m.logprob([F.lit(0.5), F.lit(0.8), F.lit(0.25)]).alias("logprob"),
        m.hellinger2((0.0, 0.0, 0.0), (0.04, 0.0, 0.0, 0.04, 0.0, 0.04), (0.2, 0.0, 0.0), (0.04, 0.0, 0.0, 0.04, 0.0, 0.04)).alias("hellinger"),
        m.voxel_key([F.lit(1), F.lit(-2), F.lit(3)]).alias("key"), m.promoted_key(m.voxel_key([F.lit(1), F.lit(-2), F.lit(3)]), 1).alias("coarse"),
        m.box_iou((0.0, 0.0, 0.0, 2.0, 2.0, 2.0), (1.0, 0.0, 0.0, 3.0, 2.0, 2.0)).alias("iou"), m.view_quality(F.lit(0.8), F.lit(2000)).alias("quality"), m.rerank_score(F.lit(-0.2)).alias("r1"), m.rerank_score(F.lit(2.0)).alias("r2"),
    ).first()
    want = {"near": 0.6065306597, "on": 0.7790997416, "above": 0.8130781805, "next": 0.7261490370, "between": 0.5294981416, "behind": -0.1, "inside": 0.5204501210, "left": 0.8411308951, "front": 0.7310585786, "geo": 0.4932424149, "logprob": 0.1, "hellinger": 0.1175030974, "key": 4611692615494008835, "coarse": 4611688217449594881, "iou": 1 / 3, "quality": 35.7770876400, "r1": 0.4, "r2": 0.8807970780}
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=1e-9), k


def test_components_and_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (9, 9)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    hops = {r.node: r.hop for r in graph.reachable(edges, spark.createDataFrame([(5,)], "node long"), 3).collect()}
    assert hops == {i: abs(i - 5) for i in range(2, 9)}


def test_frames(spark, tmp_path):
    one = {"frames": [{"camera": c, "frame_id": i, "rgb_path": f"{c}{i}.jpg", "depth_path": "d", "K": [[1, 0], [0, 1]], "T_world_cam": [[1, 0], [0, 1]]} for c in "ab" for i in range(6)]}
    two = {"frames": [{"timestamp": 0.5, "rgb": "r.jpg", "depth": "d.npy", "K": [[1, 0], [0, 1]], "T_wc": [[1, 0], [0, 1]], "camera": "z"}]}
    for name, x in (("one", one), ("two", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    got = frames.frames(spark, str(tmp_path / "one.json"), cameras=["a"], stride=2, start=1).collect()
    assert [(r.frame_id, r.stamp_ns) for r in got] == [(1, 100000000), (3, 300000000), (5, 500000000)]
    with pytest.raises(ValueError):
        frames.frames(spark, str(tmp_path / "one.json"), cameras=["q"])
    row = frames.frames(spark, str(tmp_path / "two.json")).first()
    assert (row.rgb_path, row.stamp_ns, row.frame_id) == ("r.jpg", 500000000, 0)


def test_benchmark_tables(spark, tmp_path):
    (tmp_path / "u.csv").write_text('stimulus_id,scan_id,target_id,instance_type,utterance,mentions_target_class\nscene0525_00-plant-5-9-10-11-12-62,scene0525_00,9,plant,"the ""big"" one",yes\ns-x-1-z,s,bad,x,y,maybe\n')
    a, b = frames.utterances(spark, str(tmp_path / "u.csv")).collect()
    assert a.distractors == [10, 11, 12, 62] and a.mentions_target_class is True and a.utterance == 'the "big" one'
    assert b.target_id is None and b.mentions_target_class is None
    (tmp_path / "v.txt").write_text("# c\nchair\n\n table \n")
    assert [(r.class_id, r.name) for r in frames.vocabulary(spark, str(tmp_path / "v.txt")).collect()] == [(0, "chair"), (1, "table")]
    (tmp_path / "s1.json").write_text(json.dumps({"regions": {"r0": {"near the door": [{"target_index": "4", "target_class": "chair", "distractor_ids": ["5", "x"], "anchors": {"anchor_1": {"index": "7", "class": "door"}}, "relation": "near", "relation_type": "binary"}]}}}))
    s = frames.statements(spark, str(tmp_path / "s1.json")).first()
    assert (s.scene, s.region, s.target_id, s.distractors, s.anchors) == ("s1", "r0", 4, [5, None], [7])


def test_stream_fold_equals_batch(spark, tmp_path):
    rows = [(i % 3, float(i), 1.0, 2.0, 0.5, 0.5, 0.5) for i in range(30)]
    schema = "id long, m0 double, m1 double, m2 double, v0 double, v1 double, v2 double"
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    fold.start(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: (r.w, round(r.m0, 6), round(r.v0, 6)) for r in fold.objects(spark, str(tmp_path / "state")).collect()}
    for i in range(3):
        x = [r[1] for r in rows if r[0] == i]
        mean = sum(x) / len(x)
        assert got[i] == (len(x), round(mean, 6), round(sum(v * v for v in x) / len(x) + 0.5 - mean * mean, 6))


def test_stream_windows(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 5), "a", 1.0), (1, datetime(2024, 1, 1, 0, 5), "a", 1.0), (2, datetime(2024, 1, 1, 0, 55), "a", 2.0), (3, datetime(2024, 1, 1, 9, 0), "b", 5.0)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.hourly_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("hours").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}
