"""The exact k-nearest join against all pairs: crowds, places far from all, equal places, groups, rows without a place."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomap.operators import nearest, spatial


def plain(left, right, k, by, others):
    out = []
    ok = lambda r: all(v is not None and math.isfinite(v) for v in r[1:4]) and (not by or r[4] is not None)
    for a in filter(ok, left):
        near = sorted((math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])), b[0]) for b in filter(ok, right) if (not by or a[4] == b[4]) and (not others or a[0] != b[0]))
        out += [(a[0], j, round(d, 9), n + 1) for n, (d, j) in enumerate(near[:k])]
    return sorted(out)


def cloud(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            p = (1.0, -2.0, 0.5)  # a third in one place
        elif kind < 0.7:
            p = tuple(rng.gauss(0, 0.01) for _ in range(3))
        elif kind < 0.95:
            p = (float(rng.randint(0, 5)), float(rng.randint(0, 5)), 0.0)
        else:
            p = tuple(rng.uniform(-300, 300) for _ in range(3))
        rows.append((i, *p, rng.choice("ab")))
    return rows


ODD = [(9001, None, 1.0, 1.0, "a"), (9002, math.nan, 1.0, 1.0, "a"), (9003, math.inf, 0.0, 0.0, "b"), (9004, 0.0, 0.0, 0.0, None)]
KIND = "object_idx long, x double, y double, z double, g string"


@pytest.mark.parametrize(("seed", "k", "by", "leaf"), [(1, 3, None, 8), (3, 10, "g", 4)])
def test_against_all_pairs(spark, seed, k, by, leaf):
    rows = cloud(seed, 300) + ODD
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = sorted((r.id, r.other, round(r.d, 9), r["rank"]) for r in nearest.k_nearest(df, df, k, by=by, leaf=leaf).collect())
    assert got == plain(rows, rows, k, by, True)


def test_two_sides_and_few_rows(spark):
    left, right = cloud(4, 150), cloud(5, 90)
    l, r = spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND)  # noqa: E741
    got = sorted((x.id, x.other, round(x.d, 9), x["rank"]) for x in nearest.k_nearest(l, r, 4, others=False, leaf=5).collect())
    assert got == plain(left, right, 4, None, False)
    few = r.limit(2)
    pair = [tuple(x) for x in few.collect()]
    got = sorted((x.id, x.other, round(x.d, 9), x["rank"]) for x in nearest.k_nearest(l, few, 4, others=False).collect())
    assert got == plain(left, pair, 4, None, False)
    assert nearest.k_nearest(l, r.where("false"), 2).count() == 0 and nearest.k_nearest(l.where("false"), r, 2).count() == 0


def test_kth_within_a_leaf():
    rng = random.Random(6)
    rows = [(rng.choice([0.0, 1.0, rng.gauss(0, 1)]), rng.gauss(0, 1), 0.5, rng.randint(1, 3)) for _ in range(60)]
    leaf = pd.DataFrame([("", 2, 7, *r) for r in rows], columns=["grp", "level", "cell", "px", "py", "pz", "n"])
    for need in (1, 4, 100, 1000):
        got = nearest._kth(leaf, need)["kth"].tolist()
        for a, kth in zip(rows, got, strict=True):
            d = sorted(d for b in rows for d in [math.dist(a[:3], b[:3])] * b[3])
            assert kth == pytest.approx(d[need - 1] if need <= len(d) else math.inf)


def test_pairs_of_one_scene_only(spark):
    rows = [(i, float(i % 7), 0.0, 0.0, i % 3 if i % 5 else None) for i in range(40)]
    o = spark.createDataFrame(rows, "object_idx long, x double, y double, z double, scene long")
    pairs = spatial.pairs_within(o, o.select(*[F.col(c).alias("a_" + c) for c in o.columns]), 1.0, by=("scene", "a_scene"))
    got = sorted((r.object_idx, r.a_object_idx) for r in pairs.collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[4] is not None and a[4] == b[4] and abs(a[1] - b[1]) <= 1)
