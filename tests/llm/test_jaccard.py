"""op7 against all pairs of small documents, and its parts."""

import random
import re

import numpy as np
import pytest

from loomap.llm import jaccard
from loomap.operators.graph import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(rows, k=5, percent=75):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(str((d, len(sets[i]), best.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def documents(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    line = " ".join(rng.choices(vocabulary, k=25))
    base = [rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 7, 8, 10, 14, 25, 60, 200])) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = rng.choices(vocabulary, k=rng.choice([0, 1]))
        if i % 4 == 0:
            w += line.split()
        rows.append((i * 2, rng.choice([" ", "\n"]).join(w)))
    rows += [(1, None), (3, ""), (5, " \t"), (rows[7][0], rows[7][1]), (None, rows[9][1]), (7, rows[20][1].lower()), (None, "all alone here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "margin"), [(1, 6.0), (2, 6.0), (3, 0.0), (4, -3.0)])
def test_near_duplicates(spark, seed, margin):
    rows = documents(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").coalesce(1)
    got = jaccard.near_duplicates(docs, bucket_bytes=8000, margin=margin).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain(rows)


def test_every_similar_pair_is_a_candidate():
    """In every instance and for many sizes, similar sets share a signature with which the larger probes, however its slack is used, or are told to be hard."""
    rng = np.random.default_rng(3)
    for size in [*range(1, 40), 60, 100, 150, 333]:
        for _ in range(6):
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            gone = int(rng.integers(0, size // 3 + 1))
            new = int(rng.integers(0, size // 3 + 1 - gone))
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
            both = len(a) - gone
            if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
                continue
            s = object.__new__(jaccard.Sets)
            s.tokens, s.size = np.concatenate([a, b]), np.array([len(a), len(b)])
            s.first = np.array([0, len(a), len(a) + len(b)])
            h, which, flag, hard = jaccard.signatures_of(s, np.array([0, 1]), None, 75)
            x, y = ({k: f for k, f in zip(h[which == w].tolist(), flag[which == w].tolist(), strict=True)} for w in ((0, 1) if len(a) >= len(b) else (1, 0)))
            probing = [k for k, f in x.items() if f >= jaccard.PROBES]
            common = [k for k in probing if k in y]
            weight = sum(1 + (x[k] & jaccard.WEIGHT_2 > 0) for k in common)
            assert hard or weight > jaccard.LADDER[x[probing[0]] & 63]


def test_slack_drops_the_largest_groups():
    names, flags = np.array([7, 7, 7, 9], np.uint64), np.array([jaccard.PROBES + 2, jaccard.PROBES + 2, jaccard.PROBES + 2, 0], np.uint8)
    import pyarrow as pa

    appeal = {"part": 0, "bucket": 4, "names": jaccard.narrow(names, 5, 0), "flags": flags.tobytes(), "counts": np.array([3, 9, 5, 9], np.uint32).tobytes(), "places": np.array([0, 1, 2, 3], np.uint32).tobytes()}
    reply = jaccard._replies(pa.Table.from_pylist([appeal], schema=jaccard.APPEAL_SCHEMA)).to_pylist()[0]
    got = dict(zip(np.frombuffer(reply["places"], np.uint32).tolist(), np.frombuffer(reply["dropped"], bool).tolist(), strict=True))
    assert got == {0: False, 1: True, 2: True, 3: False}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x in got} and all(x == r for x, r in root.items() if x not in got)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_keep_one_of_each_group(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = a + " end"
    rows = [(1, a, None), (1, a, None), (1, a, "x"), (None, b, None), (None, b, None), (None, b, "y"), (2, near, None), (2, c, None), (3, c + " end", None), (4, "", None), (None, None, None), (None, None, None)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = [tuple(r) for r in got.collect()]
    texts = sorted((r[0] or 0, r[1]) for r in got if r[1])
    assert texts == [(0, b), (1, a), (2, c)]
    assert sum(not r[1] for r in got) == 3  # empty sets are in no group
