"""Pairs of all objects with the query set: how they are dealt, and what odd rows give."""

import math
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomap import catalog
from loomap.operators import graph, nearest, order, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def embeddings(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["x08_distances", "x16_x24_relative_poses"])
def test_pairs_are_shared_out(spark, tmp_path, name):
    """Objects that lie in one file meet the query set in tasks of some 4,096."""
    sf = str(tmp_path)
    spark.range(9000).selectExpr("id as vec_id", "transform(sequence(1, 6), i -> cast(id % (i + 90) / 50 as float)) as embedding", "1 as label").coalesce(1).write.parquet(f"{sf}/embeddings.parquet")
    df = catalog.QUERIES[name](spark, sf)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 90 * 9000 - 90 and len(sizes) == 3


def test_between_is_not_dealt_by_cell(spark, tmp_path):
    """All objects lie in one cell: no task may hold it alone, and the score's code is short enough to be compiled."""
    sf = embeddings(spark, tmp_path, [(i, [0.001 * (i % 7), 0.0005 * (i % 11), 0.0, 0.1, 0.1, 0.1], 1) for i in range(301)] + [(901, None, 1), (902, [float("nan")] * 6, 1)])
    df = catalog.QUERIES["p06_j05_between"](spark, sf)
    assert "hashpartitioning(_x" not in plan(df) and "BroadcastNestedLoopJoin" in plan(df)
    rows = df.collect()
    assert rows and {(r.a_object_idx, r.b_object_idx) for r in rows} <= {(0, 100), (100, 200), (200, 300)}
    assert all(r.object_idx < 901 and r.clamped == pytest.approx(max(r.score, 0.0)) for r in rows)


def places(spark, n, spread, seed):
    rng = random.Random(seed)
    rows = [(i, *[rng.gauss(0, spread) for _ in range(3)], rng.randrange(4)) for i in range(n)]
    rows += [(n + k, *rows[k][1:4], k % 2) for k in range(20)]  # copies
    rows += [(5, 40.0, 0.0, 0.0, 1), (n + 30, 40.2, 0.0, 0.0, 1), (n + 31, float("nan"), 0.0, 0.0, 1), (n + 32, None, 0.0, 0.0, None), (n + 33, 0.0, 0.0, 0.0, None)]
    return spark.createDataFrame(rows, "object_idx long, x double, y double, z double, mark long")


@pytest.mark.parametrize(("n", "spread", "radius"), [(300, 1.0, 0.4), (200, 3.0, 0.8), (150, 0.2, 0.5)])
def test_linked_and_merged_without_pairs(spark, n, spread, radius):
    """Components and constrained unions as from all close pairs; an id with two places links both."""
    o = places(spark, n, spread, n)
    a = o.select(*[F.col(c).alias(f"a_{c}") for c in o.columns])
    near = spatial.pairs_within(o, a, radius).where("object_idx < a_object_idx").select(F.col("object_idx").alias("a"), F.col("a_object_idx").alias("b"), F.coalesce(F.col("mark") == F.col("a_mark"), F.lit(False)).alias("forbidden"))
    comp = graph.components(near.select("a", "b"))
    got = {r.node: r.root for r in spatial.linked_within(o, radius).collect()}
    want = {r.node: r.root for r in comp.collect()}
    assert {k: got[k] for k in want} == want and all(got[k] == k for k in set(got) - set(want))
    merged = order.constrained_merge(near.join(comp, F.col("a") == F.col("node")).select(F.col("root").alias("component"), "a", "b", "forbidden"))
    nodes = o.where("abs(x) < 1e9").join(spatial.linked_within(o, radius), F.col("object_idx") == F.col("node")).select(F.col("root").alias("component"), "node", "x", "y", "z", "mark")
    assert sorted(map(str, order.merged_within(nodes, radius).select("component", "node", "root").collect())) == sorted(map(str, merged.select("component", "node", "root").collect()))


@pytest.mark.parametrize("name", ["g01_constrained_merge", "g06_clusters"])
def test_merge_forms_no_pairs(spark, tmp_path, monkeypatch, name):
    """Of 400 objects within the radius there are 80,000 pairs; the merge and the clusters never ask for them."""
    sf = embeddings(spark, tmp_path, [(i, [0.001 * (i % 20), 0.0, 0.0, 0.1, 0.1, 0.1], i % 3) for i in range(400)])
    monkeypatch.setattr(spatial, "pairs_within", lambda *a, **k: pytest.fail("all close pairs are formed"))
    assert catalog.QUERIES[name](spark, sf).count() == 400


@pytest.mark.parametrize("rows", [16, 2048])
def test_crowded_cell_is_shared_out(spark, rows):
    """Most boxes touch one cell: its blocks meet in many tasks, and the pairs are those of a plain loop."""
    rng = random.Random(2)
    boxes = []
    for i in range(160):
        low = [rng.uniform(-0.8, 0.8) for _ in range(3)]
        boxes.append((i, *low, *[v + rng.choice([0.2, 0.9, 5.0]) for v in low]))
    boxes += [(3, 0.1, 0.1, 0.1, 0.5, 0.5, 0.5), (200, 30.0, 0.0, 0.0, 31.0, 1.0, 1.0), (201, 30.5, 0.5, 0.5, 32.5, 1.5, 1.5), (202, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0), (203, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "i long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    found = spatial.overlapping_boxes(df, 2.0, rows).withColumn("task", F.spark_partition_id()).collect()
    sound = [b for b in boxes if b[1] is not None and b[1] == b[1]]
    want = [(p[0], q[0]) for p in sound for q in sound if p[0] < q[0] and all(p[k] < q[k + 3] and q[k] < p[k + 3] for k in (1, 2, 3))]
    assert sorted((r.i, r.j) for r in found) == sorted(want) and (200, 201) in want
    assert rows > len(boxes) or len({r.task for r in found}) > 4


@pytest.mark.parametrize("band_rows", [40, 1 << 20])
def test_distance_ranks(spark, band_rows):
    """Ranks from both ends as windows give them, in one band and in several: equal distances, places that aren't known, NaN."""
    rng = random.Random(7)
    rows = [(i, *[float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(180)] + [(300, None, 0.0, 0.0), (301, float("nan"), 0.0, 0.0), (302, float("nan"), 1.0, 0.0), (None, 0.0, 0.0, 0.0)]
    o = spark.createDataFrame(rows, "object_idx long, x double, y double, z double")
    a = o.where("object_idx % 50 = 0").select(*[F.col(c).alias(f"a_{c}") for c in o.columns])
    x = o.join(a, F.col("object_idx") != F.col("a_object_idx")).withColumn("d", F.sqrt(sum((F.pow(F.col(c) - F.col(f"a_{c}"), 2) for c in "xyz"), F.lit(0.0))))
    by = lambda d: F.row_number().over(Window.partitionBy("a_object_idx").orderBy(d, "object_idx")) - 1
    want = x.select("object_idx", "a_object_idx", by(F.col("d")).alias("closest"), by(F.col("d").desc()).alias("farthest"))
    got = nearest.distance_ranks(o, o.where("object_idx % 50 = 0"), band_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5 * 182


def test_superlatives_shuffle_no_pairs(spark, tmp_path):
    """Scores as rounded by Spark, and no window over the pairs."""
    sf = embeddings(spark, tmp_path, [(i, [0.01 * (i % 7), 0.02 * (i % 11), 0.0], 1) for i in range(701)])
    df = catalog.QUERIES["p11_p12_superlatives"](spark, sf)
    assert "Window" not in plan(df)
    want = spark.range(700).select(F.round(1 / (F.col("id") + 1), 6).alias("s")).collect()
    assert sorted(r.closest for r in df.where("a_object_idx = 100").collect()) == sorted(r.s for r in want)
    assert sorted(r.farthest for r in df.where("a_object_idx = 700").collect()) == sorted(r.s for r in want)


def test_rounded_and_far_distances(spark):
    """A distance that is rounded to the radius reaches over a whole cell; cells of far places are no overflow; what isn't finite is near none."""
    for radius, x, y in ((1.0, -1e-17, 1.0), (0.8, -1e-17, 0.8), (2.0, -1e-17, 2.0), (1.0, 1e20, 1e20), (1.0, -3e39, -3e39)):
        df = spark.createDataFrame([(1, x, 0.0, 0.0), (2, y, 0.0, 0.0), (3, math.inf, 0.0, 0.0), (4, math.nan, 0.0, 0.0), (5, None, 0.0, 0.0)], "object_idx long, x double, y double, z double")
        both = spatial.pairs_within(df, df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns]), radius).where("object_idx < a_object_idx")
        assert [(r.object_idx, r.a_object_idx) for r in both.collect()] == [(1, 2)]


def test_candidates_further_than_a_metre(spark, tmp_path):
    """Wide Gaussians meet at any distance: the reference has no bound on it, so there is none in code or SQL."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(3)] + [rng.choice([0.02, 0.5, 40.0]) * rng.random() for _ in range(3)] + [rng.gauss(0, 1)], rng.randrange(3)) for i in range(120)]
    rows += [(200, [0.0] * 7, 1), (201, [0.0] * 7, 1), (202, rows[0][1], None), (203, None, 1), (204, [math.nan] * 7, 1), (205, [math.inf] * 7, 1), (206, [1e20] * 7, 1), (206, rows[1][1], 1), (207, rows[1][1], 2)]
    sf = embeddings(spark, tmp_path, rows)
    got = catalog.QUERIES["j02_j03_merge_candidates"](spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select i, j, h2, merge from ({catalog.ORACLES['j02_j03_merge_candidates']})").fetchall()
    plain = lambda rows: sorted(str((i, j, round(h, 6) + 0.0, g)) for i, j, h, g in rows)
    assert plain((r.i, r.j, r.h2, r.merge) for r in got) == plain(want)
    at = {i: v for i, v, _ in rows if v}
    assert any(10 * math.dist(at[r.i][:3], at[r.j][:3]) > 5 for r in got) and (200, 201) in {(r.i, r.j) for r in got}


@pytest.mark.parametrize("size", [16, 60, 4096])
def test_gaussians_meet_in_blocks(spark, size):
    """The pairs of small blocks, of crowded ones (half of the objects are in one place) and of a single one are those of a plain loop."""
    rng = random.Random(size)
    rows = [(i, *([rng.gauss(0, 9) for _ in range(3)] if i % 2 else [1.0, 2.0, 3.0]), *[rng.choice([0.05, 1.0, 30.0]) * (rng.random() + 0.01) for _ in range(3)], i % 4, [1.0, float(i % 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "object_idx long, x double, y double, z double, vx double, vy double, vz double, class_id int, feature array<double>")
    want = {}
    for p in rows:
        for q in rows:
            h2 = 1 - math.prod(math.sqrt(2 * math.sqrt(a * b) / (a + b)) for a, b in zip(p[4:7], q[4:7], strict=True)) * math.exp(-sum((a - b) ** 2 / (v + w) for a, b, v, w in zip(p[1:4], q[1:4], p[4:7], q[4:7], strict=True)) / 4)
            if p[0] < q[0] and h2 < 0.8:
                want[p[0], q[0]] = h2
    found = spatial.overlapping_gaussians(df, 0.8, 0.65, size).collect()
    assert len(found) == len(want) and all(r.h2 == pytest.approx(want[r.i, r.j], abs=1e-9) for r in found)
    assert all(r.same == (r.i % 4 == r.j % 4) and (r.cos is not None) == (r.same and r.h2 < 0.65) for r in found)


def test_box_pairs_are_dealt_by_id(spark):
    """A task's pairs have the j of one block, so that few different ids are written: ids lie at random in space, and are in neither the order of rows nor dense."""
    rng = random.Random(9)
    boxes = [(i * i, *(low := [rng.uniform(-0.5, 0.5) for _ in range(3)]), *[v + 0.8 for v in low]) for i in range(100)]
    rng.shuffle(boxes)
    df = spark.createDataFrame(boxes, "i long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double").repartition(5)
    found = spatial.overlapping_boxes(df, 2.0, 20).withColumn("task", F.spark_partition_id())
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and all(p[k] < q[k + 3] and q[k] < p[k + 3] for k in (1, 2, 3)))
    most = found.groupBy("task").agg(F.countDistinct("j").alias("n")).agg(F.max("n")).first()[0]
    assert 10 < most <= 20
