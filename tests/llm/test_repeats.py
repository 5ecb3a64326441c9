"""op4 and op8 against plain versions on small, repetitive documents."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomap.llm import dedup_bytes, dedup_words
from loomap.llm._repeats import Packs


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    line = [" ".join(rng.choices(words, k=20)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 3), line[i % 2])
        if i % 7 == 0 and rows:
            parts.append(rng.choice(rows)[1] or "")
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(rows[5][0], rows[5][1]), (1, rows[10][1]), (2, None), (4, ""), (5, "é" * 300 + " " + "é" * 300), (None, rows[3][1]), (7, "x " * 400), (8, "x " * 30), (10, "a" * 5000)]
    rng.shuffle(rows)
    return rows


def plain_words(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("window", "first", "pack"), [(13, 4, 1 << 20), (13, 7, 300), (13, 3, 700), (5, 2, 500)])
def test_dedup_words(spark, window, first, pack):
    rows = documents()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, pack int").repartition(3)
    got = dedup_words.dedup_words(docs, window, first, pack_bytes=pack, bucket_bytes=2000).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_words(rows, window)


def test_dedup_words_without_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert dedup_words.dedup_words(docs).count() == 2
    assert dedup_words.dedup_words(docs.where("false")).count() == 0


def test_levels():
    assert dedup_words.lengths() == [4, 8, 13] and dedup_words.lengths(50, 7) == [7, 14, 28, 50]


def test_windows_are_removed_through_the_levels_only(spark, monkeypatch):
    """With one pack too: where a level lets nothing survive, nothing is removed."""
    rows = [(1, " ".join(f"w{i}" for i in range(40))), (2, " ".join(f"w{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_removed for r in dedup_words.dedup_words(docs).collect()) == 40
    for level in (0, 1):
        real, calls = dedup_words.written, []

        def written(df, level=level, real=real, calls=calls):
            calls.append(0)
            return real(df.where("false")) if len(calls) == level + 1 else real(df)

        monkeypatch.setattr(dedup_words, "written", written)
        assert sum(r.n_removed for r in dedup_words.dedup_words(docs).collect()) == 0
        monkeypatch.setattr(dedup_words, "written", real)


def skewed():
    """Nine in ten rows without an id, one row very often, and ids that cluster."""
    rng = random.Random(4)
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(None, " ".join(rng.choices("abcdefgh", k=30))) for _ in range(270)] + [(3, text)] * 60
    return rows + [(10**12 + i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(30)] + [(9, text + " more")]


def test_no_pack_is_large(spark):
    docs = spark.createDataFrame(skewed(), "doc_id long, text string")
    packs = Packs(docs, 4000)
    sizes = [r.n for r in packs.groups().agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert len(packs.parts) == 1 and max(sizes) <= 2 * 4000


@pytest.mark.parametrize("pack", [1 << 20, 4000])
def test_skewed_ids(spark, pack):
    docs = spark.createDataFrame(skewed(), "doc_id long, text string").repartition(3)
    got = dedup_words.dedup_words(docs, pack_bytes=pack, bucket_bytes=4000).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_words(skewed(), 13)
    got = dedup_bytes.dedup_bytes(docs, pack_bytes=pack, bucket_bytes=4000).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_bytes(skewed(), 50)


def test_fragments_of_one_repeated_byte_are_merged():
    """A long text of equal bytes has an anchor at each place; what is copied stays small."""
    n = 400_000
    texts = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a" * n, "a" * n], "pack": pa.array([0, 0], pa.int32())})
    anchors = dedup_bytes.Anchors(texts.to_batches()[0], np.full(2 * n, 97, np.uint8), np.array([0, n, 2 * n]), 50, 20)
    alive = pa.table({"hashes": [dedup_bytes.narrow(np.unique(anchors.hash))]})
    found = dedup_bytes._fragments(50, 20, 4, texts, alive).to_pylist()
    assert sum(len(r["bytes"]) for r in found) < 10_000

def plain_bytes(rows, span):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for k in range(len(t) - span + 1) if i is not None else ():
            first[t[k : k + span]] = min(first.get(t[k : k + span], i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1) if i is not None else ():
            if first[t[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        kept = bytes(x for k, x in enumerate(t) if not gone[k])
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("span", "gram", "pack"), [(50, 20, 1 << 20), (50, 20, 300), (20, 4, 700), (12, 3, 500)])
def test_dedup_bytes(spark, span, gram, pack):
    rows = documents(2)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, pack int").repartition(3)
    got = dedup_bytes.dedup_bytes(docs, span, gram, pack_bytes=pack, bucket_bytes=2000).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_bytes(rows, span)


def test_dedup_bytes_without_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert dedup_bytes.dedup_bytes(docs).count() == 2
    assert dedup_bytes.dedup_bytes(docs.where("false")).count() == 0


@given(st.lists(st.sampled_from([0, 97, 98, 255]), max_size=80))
@settings(max_examples=300, deadline=None)
def test_suffix_array(values):
    t = np.array(values, np.uint8)
    raw = t.tobytes()
    sa = dedup_bytes.suffix_array(t, 200)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    prefix = [0] + [next((k for k in range(9) if raw[a : a + k + 1] != raw[b : b + k + 1] or k >= min(len(raw) - a, len(raw) - b)), 9) for a, b in zip(sa[:-1], sa[1:], strict=True)] if len(raw) else []
    got = np.minimum(dedup_bytes.common_prefixes(t, sa, 9), np.minimum(len(raw) - sa, np.concatenate([[0], len(raw) - sa[:-1]]))[: len(sa)])
    assert got.tolist() == prefix
