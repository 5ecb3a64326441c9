"""op6: targets, flow and selection against plain versions."""

import re
from fractions import Fraction

import pytest

from loomap.llm import mix


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        share = {s: (total - sum(capped.values())) * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s: Fraction(2 * sizes[s]) for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_targets():
    for sizes in ({"a": 10, "b": 1000, None: 3}, {"a": 0}, {}, {"x": 5, "é": 50, "z": 500, "zz": 4, "~": 9}):
        assert mix.targets(sizes) == plain_targets(sizes)
        assert all(mix.targets(sizes)[s] <= 2 * n for s, n in sizes.items())


def test_route_overlapping():
    # only the shared pattern can fill b, and repeating comes last
    got = mix.route({("a",): 100, ("a", "b"): 50}, {"a": 100, "b": 60})
    assert got == {("a",): 100, ("a", "b"): 60}
    got = mix.route({("a",): 100, ("a", "b"): 50}, {"a": 100, "b": 50})
    assert got == {("a",): 100, ("a", "b"): 50}
    assert mix.route({("a",): 10}, {"a": 100}) == {("a",): 20}


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join("w" * (1 + i % 7) for _ in range(1 + i * 37 % 50)), ["hot", "hot", "b", None, "é"][i % 5], 1) for i in range(600)]
    rows += [(3, None, "b", 1), (4, "", "b", 1), (None, "a b c", "hot", 1), (5, rows[5][1], "hot", 1), (5, rows[5][1], "hot", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _p int")


def test_mix_comes_near_targets(docs):
    rows = mix.mix(docs).collect()
    again = mix.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r._copies)
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == docs.count()
    size = {}
    for r in rows:
        assert r._size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r._copies <= 2
        size[r.source] = size.get(r.source, 0) + r._size
    want = plain_targets(size)
    for s, n in size.items():
        own = [r for r in rows if r.source == s]
        assert {(r._source_size, r._target) for r in own} == {(n, float(want[s]))}
        assert abs(sum(r._copies * r._size for r in own) - want[s]) <= 3


def test_repeated_gives_rows(docs):
    assert mix.repeated(docs).columns == docs.columns
    assert mix.repeated(docs).count() == sum(r._copies for r in mix.mix(docs).collect())


def test_refined_zone(docs, monkeypatch):
    monkeypatch.setattr(mix, "BINS", 4)
    monkeypatch.setattr(mix, "ZONE", 10)
    monkeypatch.setattr(mix, "LEAST_ZONE", 3)
    rows = mix.mix(docs).collect()
    for s in ("hot", "b", None, "é"):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r._copies * r._size for r in own) - own[0]._target) <= 30


def test_fullest():
    for sizes, room in (([3, 5, 8], 10), ([], 4), ([7], 6), ([2, 2, 2], 6), ([10**7, 3 * 10**6], 10**7 + 5), ([4, 9], 0)):
        best = max(s for k in range(1 << len(sizes)) if (s := sum(x for i, x in enumerate(sizes) if k >> i & 1)) <= room)
        got = sum(sizes[i] for i in mix.fullest(sizes, room))
        assert got <= room and best - got <= max(1, room // 4_000_000) * len(sizes) * (room >= 8_000_000)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix.mix(empty).count() == 0 and mix.repeated(empty).count() == 0


def test_array_of_sources(spark):
    rows = [(i, "a b c d", [["x"], ["x", "y"], []][i % 3]) for i in range(300)]
    got = mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert sum(r._copies * r._size for r in got if not r.source) == 0
    assert sum(r._copies * r._size for r in got) > 0
