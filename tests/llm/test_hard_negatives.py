"""op12: plain versions over whole small tables, brackets, ties, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomap.llm import hard_negatives as hn


def plain(rows, anchors, low=30, high=90, positives=5, negatives=10):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    first = lambda found, n: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:n]
    out = []
    for i, label, v in rows:
        if i is None or not anchors(i):
            continue
        near = first([(dot(v, w), j) for j, other, w in rows if other == label and j != i], positives)
        far = [(dot(v, w), j) for j, other, w in rows if other != label]
        for p, j in near:
            for k, (s, m) in enumerate(first([x for x in far if low * p <= 100 * x[0] <= high * p], negatives)):
                out.append((i, j, k + 1, m, int(p), int(s)))
    return sorted(map(repr, out))


def table(seed, n, spread):
    rng = random.Random(seed)
    centres = [[rng.randint(-spread, spread) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = rng.randrange(4)
        rows.append((i, label, [float(c + rng.randint(-spread // 2, spread // 2)) for c in centres[(label + rng.choice([0, 0, 1])) % 4]]))
    return rows


@pytest.mark.parametrize(("seed", "spread", "block"), [(1, 40, 1 << 20), (2, 3, 1 << 20), (3, 40, 400), (4, 3, 1)])
def test_against_plain(spark, seed, spread, block, monkeypatch):
    """Few different components make many ties; small blocks, slabs and pieces change nothing."""
    monkeypatch.setattr(hn, "SAMPLE", 20)
    rows = table(seed, 300, spread)
    rows += [(1000, 1, [0.0] * 6), (1001, 1, []), (1002, 2, [5.0, 1.0]), (1010, None, [1.0] * 6), (1020, 3, None), (1030, 3, [1.0, None]), (1040, 3, [math.nan] * 6), (1050, 3, [math.inf] * 6)]
    rows += [(None, 1, rows[0][2]), (None, 2, rows[0][2]), (10, rows[10][1], rows[10][2]), (11, rows[11][1], rows[11][2]), (20, 3, rows[5][2])] + [(2000 + i, i % 3, rows[0][2]) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, vector array<double>, score string").repartition(5)
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, block_bytes=block)
    assert got.columns == [c.split()[0] for c in hn.MINED.split(", ")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0)
    assert hn.hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(False)).count() == 0


def test_brackets_hold_and_exclude():
    """Every score lies in its bracket, and with vectors in clusters most pairs are ruled out without their score."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 60
    x = np.floor(centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16)) * 4)
    pivots = hn.Pivots(x[:200], float((x**2).sum(1).max()))
    anchors = hn.Anchors(pivots, np.arange(50), np.zeros(50, np.int64), x[:50])
    d = pivots.distances(pivots.augmented(x))
    low, high = anchors.bracket(np.arange(50), d, d)
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    tenth = np.sort(exact, axis=1)[:, -10]
    assert (high >= tenth[:, None]).mean() < 0.35


def test_rows_of_the_query(spark):
    """Labels of every seventh id move on, components are floors."""
    rows = [(7, 9, [0.1, -0.1]), (8, 9, [1e300, -0.5]), (9, None, None), (None, 3, [math.nan, None])]
    got = {r.vec_id: (r.label, r.vector) for r in hn.relabelled(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got[7] == (0, [25.0, -26.0]) and got[8] == (9, [256e300, -128.0]) and got[9] == (None, None) and got[None][0] == 3 and math.isnan(got[None][1][0])
