"""Sets by what they share against plain loops."""

import math
import random
from itertools import combinations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomap import catalog
from loomap.operators import aggregates, graph, shared
from loomap.plans import graphs


def test_counts(spark):
    rng = random.Random(2)
    rows = {(rng.randrange(30), rng.randrange(40)) for _ in range(300)} | {(i, 99) for i in range(30)}  # a word that all have
    df = spark.createDataFrame([*rows, (None, 3), (4, None)], "kf long, w long").repartition(3)
    got = {(r.kf, b, n) for r in shared.counts(df, "kf", "w", lambda a, b, n: (b != a) & (n > 1)).collect() for b, n in zip(r.others, r.common, strict=True)}
    of = {a: {w for k, w in rows if k == a} for a in range(30)}
    assert got == {(a, b, len(of[a] & of[b])) for a in of for b in of if a != b and len(of[a] & of[b]) > 1}
    assert shared.counts(df, "kf", "w", lambda a, b, n: np.zeros(len(b), bool)).count() == 0


def test_most_common(spark):
    rng = random.Random(5)
    sets = {i: sorted({rng.choice("abcdefghij") + rng.choice("ké") for _ in range(rng.randrange(12))} | {""}) for i in range(80)} | {100: ["only"], 200: []}
    df = spark.createDataFrame([*sets.items()], "doc_id long, words array<string>").repartition(3)
    queries = df.where("doc_id % 10 = 0")
    want = set()
    for q in (i for i in sets if i % 10 == 0):
        common = {i: len({*sets[q]} & {*sets[i]}) for i in sets if i != q}
        want |= {(q, i, n) for i, n in common.items() if n and 10 * n > 8 * max(common.values())}
    for block in (1 << 20, 15):
        assert {tuple(r) for r in shared.most_common(df, queries, block).collect()} == want
    assert shared.most_common(df, df.where("false")).count() == 0 and shared.most_common(df.where("false"), queries).count() == 0


def test_cover_of_many_images_by_a_heap(spark):
    rng = random.Random(8)
    rows = {(c, rng.randrange(40), rng.randrange(60)) for c in range(3) for _ in range(150)} | {(7, i, i) for i in range(6000)}  # the last has a step for each of its images
    got = sorted((r.cluster, r.step, r.image, r.covers) for r in aggregates.greedy_cover(spark.createDataFrame([*rows], "cluster long, image long, object long")).collect())
    want = [(7, i, i, 1) for i in range(6000)]
    for c in range(3):
        left, step = {i: {o for k, j, o in rows if (k, j) == (c, i)} for i in range(40)}, 0
        while any(left.values()):
            best = max(sorted(left), key=lambda i: len(left[i]))
            new = left.pop(best)
            want.append((c, step, best, len(new)))
            left, step = {i: s - new for i, s in left.items()}, step + 1
    assert got == sorted(want)


def test_hops_keep_no_distinct_edges(spark):
    """Repeated edges lead where single ones do; the edges are dealt by their number and aren't made distinct first, which held a partition of them in memory."""
    rows = [(i % 40, 1000 + i % 7) for i in range(300)]
    edges, start = spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(1003,)], "node long")
    df = graph.reachable(edges, start, 2)
    want, hops = {1003: 0}, [1003]
    for hop in (1, 2):
        hops = {b for x in hops for p, q in rows for a, b in ((p, q), (q, p)) if a == x} - set(want)
        want |= dict.fromkeys(hops, hop)
    assert sorted((r.source, r.node, r.hop) for r in df.collect()) == sorted((1003, n, h) for n, h in want.items())
    assert "keys=[a#" not in df._jdf.queryExecution().optimizedPlan().toString() and "Aggregate [a#" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_local_maps_send_no_lists_of_queries(spark, tmp_path):
    """As in SQL, with repeated rows, nulls, negative keys and more than one word; a keyframe's queries are bits and no list that goes to each of its landmarks."""
    rng = random.Random(6)
    rows = [(rng.choice([rng.randrange(-300, 300), 100 * rng.randrange(-90, 90)]), rng.randrange(150)) for _ in range(900)]
    rows += rows[:50] + [(100, None), (7, None), (None, 3), (None, None), (900000000000000000, 3), (12300, 999)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_partkey long").repartition(3)
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(f"select q, landmarks from ({catalog.ORACLES['j30_local_map']})").fetchall())
    got = catalog.QUERIES["j30_local_map"](spark, str(tmp_path))
    assert sorted((r.q, r.landmarks) for r in got.collect()) == want and len(want) > 64
    few = graph.local_maps(df.toDF("kf", "lm"), 100, 200)  # the words go to the rows in several parts
    assert sorted((r.q, r.landmarks) for r in few.collect()) == want
    assert "collect_" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_dealt_by_their_number(spark):
    """All pairs of a word's sets with what goes along, nulls in none; tasks follow the pairs, before and after they are dealt, and nothing is summed up in between."""
    rng = random.Random(9)
    has = {(rng.choice([None, *range(-20, 20)]), rng.choice([None, *range(25)])) for _ in range(300)} | {(i, 99) for i in range(-20, 20)}  # a word that all have
    rows = [(o, w, o * 7 if o is not None and o % 3 else None) for o, w in has]
    got = shared.pairs(spark.createDataFrame(rows, "of long, word long, x long").repartition(3), "of", "word", F.col("word"), F.least("a_x", "b_x").alias("x"), each=50)
    least = lambda *x: min((y for y in x if y is not None), default=None)
    of = {w: sorted((o, x) for o, k, x in rows if k == w and o is not None) for w in {k for _, k, _ in rows} - {None}}
    want = sorted(((i, j, w, least(x, y)) for w, found in of.items() for (i, x), (j, y) in combinations(found, 2)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    n = math.ceil(len(want) / 50)
    assert got.rdd.getNumPartitions() == n > 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {n}\n") == 3 and "Aggregate" not in plan
    few = shared.pairs(spark.createDataFrame(rows, "of long, word long, x long"), "of", "word", F.col("word"), F.least("a_x", "b_x").alias("x"), each=200)
    assert sorted(map(tuple, few.collect()), key=str) == want and "RepartitionByExpression [a#" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert shared.pairs(spark.createDataFrame(rows, "of long, word long, x long").where("of is null"), "of", "word").count() == 0


def test_links_are_made_once(spark, tmp_path, monkeypatch):
    """What is seen together twice, as in SQL, with rows that are null or repeated; it is a table when the hops read it, several times."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(12)])) for _ in range(200)]
    df = spark.createDataFrame(rows + rows[:40], "l_partkey long, l_orderkey long").repartition(3)
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(f"with {graphs.LINKS[1:]} select i, j from e0").fetchall())
    monkeypatch.setattr(graphs, "run", lambda *a, links: links)
    got = catalog.QUERIES["q213_graphs_linked"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_shared_views_pair_once(spark, tmp_path):
    """The image that shows two objects best, with users that are null and events that come twice; two objects are paired one way round, in tasks that follow the pairs."""
    rng = random.Random(4)
    events = [(i, rng.choice([None, *range(-6, 12)])) for i in rng.sample(range(9000), 700)]
    df = spark.createDataFrame(events + events[:50], "event_id long, user_id long")
    df.selectExpr("event_id", "timestamp'2024-01-05' as ts", "user_id", "'view' as event_type", "1D as value").write.parquet(f"{tmp_path}/events.parquet")
    best: dict = {}
    for e, u in events:
        if u is not None:
            key = (e // 40, u)
            best[key] = max(best.get(key, (-1, 0)), (e % 3000 * 100000 + e, e))
    want: dict = {}
    for (image, i), (_, di) in best.items():
        for (other, j), (_, dj) in best.items():
            if image == other and i != j:
                want[i, j] = max(want.get((i, j), (-(1 << 62), 0)), (min(di % 3000, dj % 3000) * 1000000 - image, image))
    got = catalog.QUERIES["p17_shared_view"](spark, str(tmp_path))
    assert got.columns == ["i", "j", "image_id"]
    assert sorted(map(tuple, got.collect())) == sorted((i, j, image) for (i, j), (_, image) in want.items()) and len(want) > 100
    assert "RepartitionByExpression [image_id#" in got._jdf.queryExecution().optimizedPlan().toString()
