"""Stored maps, and what is written for others; fits and choices against plain versions."""

import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomap.functions import math as m
from loomap.operators import aggregates, fits, graph, order, regions
from loomap.sources import frames, state
from loomap.streaming import frames as st


def test_state(spark, tmp_path):
    old = spark.createDataFrame([(1, 0.5, [1.0, 2.0], [5, 6, 7], "m", "kept"), (2, 0.25, None, None, "n", None)], "object_idx long, x double, feature array<double>, views array<bigint>, mask_observations string, caption string")
    state.save_state(old, str(tmp_path / "s"), most_views=2)
    a, b = state.load_state(spark, str(tmp_path / "s"), 3).orderBy("object_idx").collect()
    assert "mask_observations" not in a.asDict() and a.views == [5, 6] and b.views == []
    assert a.feature == [1.0, 2.0, 0.0] and b.feature == [0.0] * 3 and a.class_id == -1 and a.active and b.caption == ""
    assert state.load_state(spark, str(tmp_path / "s"), 1).where("object_idx = 1").first().feature == [1.0]
    assert state.latest_run(spark, str(tmp_path)) == f"{tmp_path}/s" and state.signature(spark, str(tmp_path / "s"))[1] > 0


def test_snapshot(spark):
    o = spark.createDataFrame([(1, 0, 2), (2, 2, 2), (3, 2, 3)], "object_idx long, start long, end long")
    v = spark.createDataFrame([(2, 9), (1, 8), (0, 7)], "row long, value long")
    assert {r.object_idx: r["values"] for r in state.snapshot(o, v).collect()} == {1: [7, 8], 2: [], 3: [9]}


def test_databases(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE landmarks (id INTEGER, pos_w BLOB)")
    con.executemany("INSERT INTO landmarks VALUES (?, ?)", [(2, np.array([1.0, 2.0, 3.0]).tobytes()), (1, np.zeros(3).tobytes())])
    con.commit()
    con.close()
    t = state.sqlite_table(spark, str(tmp_path / "*.db"), ["dense_points", "landmarks"], {"id": "bigint", "pos_w": "binary"}, order="id")
    assert [(r.id, r.p) for r in t.select("id", state.numbers("pos_w").alias("p")).collect()] == [(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0])]
    assert state.sqlite_table(spark, str(tmp_path / "*.db"), ["dense_points"], {"id": "bigint"}).count() == 0


def test_sparse_model(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 64 64 100 100 32 32\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 0 0 0 1 pano_camera0/f0.jpg\n32 32 10 40 32 11 5 5 -1\n2 1 0 0 0 0 0 1 1 pano_camera2/seq/a.png\n\n")
    (tmp_path / "points3D.txt").write_text("10 0 0 5 1 2 3 0.5 1 0 2 0 3 0 4 0\n11 1 0 5 1 2 3 0.5 1 1\n")
    model = state.sparse_model(spark, str(tmp_path))
    got = state.sparse_depths(model).collect()
    assert [(r.point_id, r.u, r.v, round(r.depth, 9)) for r in got] == [(10, 32.0, 32.0, 5.0)]
    faces = state.face_names(model["images"]).orderBy("image_id").collect()
    assert [(r.face_id, r.frame_id) for r in faces] == [(0, "f0.jpg"), (2, "seq/a.png")]
    assert model["cameras"].first().params == [100.0, 100.0, 32.0, 32.0]
    with pytest.raises(Exception, match="unexpected face image name"):
        state.face_names(spark.createDataFrame([("camera0/foo.jpg",)], "name string")).collect()


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "c.npz", depth=np.arange(12, dtype=np.uint16).reshape(2, 2, 3))
    rows = state.array_files(spark, str(tmp_path / "*.npz"), "depth").orderBy("index").collect()
    assert [(r["index"], r.shape, r.kind) for r in rows] == [(0, [2, 3], "uint16"), (1, [2, 3], "uint16")]
    d = spark.createDataFrame([(rows[0]["values"],)], "v binary").select(state.depth_values("v", "uint16", 0.5, 2.0).alias("d")).first().d
    assert d == [0.0, 0.5, 1.0, 1.5, 2.0, 0.0]
    f = spark.createDataFrame([(np.array([1.0, np.nan, -1.0], np.float32).tobytes(),)], "v binary")
    assert f.select(state.depth_values("v", "float32").alias("d")).first().d == [1.0, 0.0, 0.0]


def test_frames_are_read_back(spark, tmp_path):
    index = {"frames": [{"camera": c, "frame_id": i, "rgb_path": f"{c}{i}.jpg", "depth_path": "d", "K": [[1, 0, 2], [0, 1, 3], [0, 0, 1]], "T_world_cam": [[1, 0, 0, i], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], "timestamp_ns": i * 10} for c in "ab" for i in range(3)]}
    (tmp_path / "one.json").write_text(json.dumps(index))
    one = frames.frames(spark, str(tmp_path / "one.json"))
    frames.write_frames(one, str(tmp_path / "out"))
    assert one.collect() == frames.frames(spark, str(tmp_path / "out")).collect() and one.count() == 6


def test_written_for_others(spark, tmp_path):
    pts = spark.createDataFrame([(1, 0.5, 1.0, 2.0, 1, 2, 3), (0, 0.25, 0.0, 0.0, 255, 0, 9)], "point_id long, x double, y double, z double, r int, g int, b int")
    state.write_ply(pts, str(tmp_path / "ply"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "ply")).collect()]
    assert lines[0] == "ply" and lines[2] == "element vertex 2" and lines[-2:] == ["0.2500 0.0000 0.0000 255 0 9", "0.5000 1.0000 2.0000 1 2 3"]
    raw = state.packed_cloud(pts)
    cloud = np.frombuffer(raw[16:], state.CLOUD)
    assert raw[:8] == state.MAGIC and raw[8:16] == b"\2\0\0\0\0\0\0\0" and sorted(cloud["r"].tolist()) == [1, 255]
    o = spark.createDataFrame([(4, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, "c", True), (5, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, "d", False)], "object_idx long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, caption string, active boolean")
    v = spark.createDataFrame([(4, c, w) for c, w in zip("abcd", (1.0, 3.0, 2.0, 0.5), strict=True)], "object_idx long, class string, mass double")
    (row,) = [json.loads(r.value) for r in state.viewer_objects(o, v).collect()]
    assert [x["class"] for x in row["votes"]] == ["b", "c", "a"] and row["aabb"]["max"] == [1, 1, 1]
    poses = spark.createDataFrame([(2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "ts double, x double, y double, z double, qx double, qy double, qz double, qw double")
    assert [r.value.split()[0] for r in state.trajectory_lines(poses).collect()] == ["1.500000000", "2.000000000"]
    seq = [json.loads(r.value) for r in state.traced(poses, F.col("ts")).orderBy("rank").collect()]
    assert [(s["seq"], s["event"]["ts"]) for s in seq] == [(1, 1.5), (2, 2.0)]
    assert state.overall_table({"n": 3, "acc": 0.5}).splitlines()[-1] == "| acc | 0.5000 |"


def test_scale_fit(spark):
    rng = np.random.default_rng(1)
    sparse = rng.uniform(1, 10, 200)
    metric = 0.9 * sparse
    metric[:30] = rng.uniform(50, 100, 30)
    rows = [("clean", float(1.25 * s), float(s), 1.0) for s in sparse] + [("outliers", float(a), float(s), 1.0) for a, s in zip(metric, sparse, strict=True)] + [("few", 1.0, 1.0, 1.0)] * 2
    got = {r.face: r for r in fits.scale_fit(spark.createDataFrame(rows, "face string, metric double, sparse double, w double"), "face", 5, 2.0, 20).collect()}
    assert abs(got["clean"].alpha - 1.25) < 0.02 and got["clean"].ok and abs(got["outliers"].alpha - 0.9) < 0.08 and got["outliers"].ok
    assert got["few"].alpha == 1.0 and not got["few"].ok


def test_eigenvalues(spark):
    rng = np.random.default_rng(3)
    full = [a @ a.T * s for a, s in zip(rng.normal(size=(40, 3, 3)), rng.uniform(0.01, 4, 40), strict=True)] + [np.eye(3) * 0.3, np.diag([1.0, 1.0, -0.5])]
    rows = [tuple(map(float, (f[0, 0], f[0, 1], f[0, 2], f[1, 1], f[1, 2], f[2, 2]))) for f in full]
    names = [f"c{p}" for p in fits.PACKED]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = df.select(*[c.alias(f"e{k}") for k, c in enumerate(m.symmetric_eigenvalues(names))], fits.eigen_clipped(F.array(*names), F.lit(0.1), F.lit(2.0)).alias("c")).collect()
    for f, r in zip(full, got, strict=True):
        values = np.linalg.eigvalsh(f)
        assert np.allclose([r.e2, r.e1, r.e0], values, atol=1e-6)
        c = r.c
        back = np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]])
        assert np.allclose(np.linalg.eigvalsh(back), np.clip(values, 0.1, 2.0), atol=1e-6)


def test_global_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, s int, i long").repartition(5)
    got = {(r.k, r.i): r["rank"] for r in aggregates.global_ranks(df, "k", F.desc("s"), F.col("i")).collect()}
    for k in "ab":
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            assert got[k, i] == n


def test_greedy_choices_in_rounds(spark):
    rng = random.Random(2)
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b}
    kept = []
    for n in range(60):
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    got = graph.first_independent(spark.createDataFrame(sorted(edges), "a long, b long"), spark.range(60).withColumnRenamed("id", "node"))
    assert sorted(r.node for r in got.collect()) == kept
    pairs = [(s, a, b, round(rng.random(), 6)) for s in range(3) for a in range(25) for b in range(25) if rng.random() < 0.2]
    want = []
    for s in range(3):
        used = set()
        for a in range(25):
            free = sorted((d, b) for t, x, b, d in pairs if t == s and x == a and b not in used)
            if free:
                used.add(free[0][1])
                want.append((s, a, free[0][1]))
    got = order.matched_runs(spark.createDataFrame(pairs, "scene long, a long, b long, d double"))
    assert sorted((r.scene, r.a, r.b) for r in got.collect()) == sorted(want)


def test_regions(spark):
    """Two clumps joined by a chain are halved, a lone object near one goes to it, one far away to none."""
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0, 0.2, (12, 3)), rng.normal(0, 0.2, (12, 3)) + [4, 0, 0], [[1, 0, 0], [2, 0, 0], [3, 0, 0], [0, 2.4, 0], [40, 0, 0]]])
    o = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "object_idx long, x double, y double, z double")
    edges = [(i, j) for i in range(len(pts)) for j in range(i) if np.linalg.norm(pts[i] - pts[j]) <= 1.3]
    got = {r.object_idx: r.region for r in regions.regions(o, spark.createDataFrame(edges, "a long, b long"), 2.0, 2, 3.5).collect()}
    assert 28 not in got and len(set(got.values())) == 2 and got[27] == got[0] and len({got[i] for i in range(12)}) == 1 and got[0] != got[12] and len({got[i] for i in range(12, 24)}) == 1
    alone = regions.regions(o, spark.createDataFrame([], "a long, b long"), 2.0, 2, 3.5)
    assert {r.region for r in alone.collect()} == {0} and alone.count() == len(pts)


def test_diverse_views(spark):
    rows = [(1, 1, 1.0, 0.0, 0.0), (1, 2, 0.99, 0.1, 0.0), (1, 3, 0.0, 1.0, 0.0), (1, 4, 0.5, 0.01, 0.0), (1, 5, 0.0, 0.0, 0.0), (2, 9, 0.0, 0.0, 2.0)]
    got = order.diverse_views(spark.createDataFrame(rows, "object long, view long, dx double, dy double, dz double"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3), (1, 4), (2, 9)]


def test_windows_of_frames(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 0)], "k string, i long")
    for size, overlap in ((4, 3), (3, 1), (5, 0)):
        got = {(r.k, r.i, r.window) for r in st.windows(rows, "k", ["i"], size, overlap).collect()}
        step = max(1, size - overlap)
        assert got == {(k, i, w) for k, n in (("a", 7), ("b", 1)) for w in range(0, n, step) for i in range(w, min(n, w + size))}
