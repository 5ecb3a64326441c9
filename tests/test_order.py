"""The order-dependent operators against hand-made cases."""

from loomap.operators import order


def test_unique_masks(spark):
    d = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.9, 0.0, 0.0, 10.0, 9.0), (1, 2, 0.9, 20.0, 0.0, 30.0, 9.0), (2, 3, 0.9, 0.0, 0.0, 10.0, 9.0)], "image_id long, det long, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.det for r in order.unique_masks(d).collect()) == [0, 2, 3]


def test_matched_runs(spark):
    d = spark.createDataFrame([(0, 1, 8, 0.5), (0, 1, 9, 0.7), (0, 2, 8, 0.1), (0, 3, 8, 0.2), (1, 2, 8, 0.3)], "scene long, a long, b long, d double")
    assert sorted((r.scene, r.a, r.b) for r in order.matched_runs(d).collect()) == [(0, 1, 8), (1, 2, 8)]


def test_suppressed_loops(spark):
    d = spark.createDataFrame([(0, 5, 100, 0.9), (0, 8, 105, 0.8), (0, 50, 100, 0.7)], "run long, i long, j long, s double")
    assert sorted((r.i, r.j) for r in order.suppressed_loops(d).collect()) == [(5, 100), (50, 100)]


def test_constrained_merge(spark):
    d = spark.createDataFrame([(1, 1, 2, False), (1, 2, 3, False), (1, 1, 3, True), (1, 3, 4, False)], "component long, a long, b long, forbidden boolean")
    assert {r.node: r.root for r in order.constrained_merge(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
