"""Nulls, clashing names, copies and partitions; and the network's score against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomap.llm import decontaminate, jaccard, mix, pack, quality_cnn
from loomap.llm._vocab import encoding


def test_the_network_against_loops():
    """One text of several chunks: embedded bytes, filters over them, greatest and mean of each chunk's greatest, one logistic layer."""
    rng = np.random.default_rng(4)
    net = quality_cnn.Network(7)
    net.p["out"], net.p["bias"] = rng.normal(size=2 * quality_cnn.FILTERS).astype(np.float32), rng.normal(size=quality_cnn.FILTERS).astype(np.float32)
    data = rng.integers(1, 255, 1000, dtype=np.uint8)
    chunks, pooled = [], []
    start = 0
    while not chunks or start + quality_cnn.CHUNK - quality_cnn.STEP < len(data):
        part = data[start : start + quality_cnn.CHUNK].tolist()
        chunks.append(part + [quality_cnn.PAD] * (quality_cnn.CHUNK - len(part)))
        start += quality_cnn.STEP
    for chunk in chunks:
        best = [-math.inf] * quality_cnn.FILTERS
        for at in range(0, quality_cnn.CHUNK - 2 * quality_cnn.TAPS + 1, 2):
            x = np.concatenate([net.p["embed"][b] for b in chunk[at : at + 2 * quality_cnn.TAPS]])
            best = [max(b, float(x @ net.p["filters"][:, k])) for k, b in enumerate(best)]
        pooled.append([max(b + float(net.p["bias"][k]), 0.0) for k, b in enumerate(best)])
    v = [max(c) for c in zip(*pooled, strict=True)] + [sum(c) / len(c) for c in zip(*pooled, strict=True)]
    want = 1 / (1 + math.exp(-(sum(a * float(b) for a, b in zip(v, net.p["out"], strict=True)) + float(net.p["prior"][0]))))
    got = net.score(*quality_cnn.chunks_of(data, np.array([0, len(data)])))
    assert got[0] == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_items_without_an_id_are_hit(spark, block):
    items = spark.createDataFrame([(None, " ".join(f"a{i}" for i in range(20))), (7, " ".join(f"b{i}" for i in range(20))), (8, "c c"), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(20))), (2, " ".join(f"b{i}" for i in range(14))), (3, "d"), (None, "c c")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items, block_windows=block).collect()}
    assert got == {1: (20, 0, True), 2: (14, 1, True), 3: (0, 0, False), None: (2, 1, True)}
    assert [r.doc_id for r in decontaminate.clean(docs, items, block_windows=block).collect()] == [3]


def test_copies_and_null_ids_in_the_cut(spark, monkeypatch):
    """A third of all rows are one row, another third has no id: targets are met all the same, by counts of a few documents at a time."""
    monkeypatch.setattr(mix, "ZONE", 100)
    rng = random.Random(3)
    rows = [(1, "x " * 10, "a")] * 1500 + [(None, " ".join(rng.choices("pqrst", k=20)), "a") for _ in range(1500)] + [(i, "y " * 15, "b") for i in range(10, 1510)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix.mix(docs).groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.first("_target").alias("target"), F.max("_copies").alias("most")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 20 and r.most <= 2 for r in got)


def test_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mix, "MOST_PATTERNS", 3)
    docs = spark.createDataFrame([(i, "a b", str(i)) for i in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="patterns"):
        mix.mix(docs)


def test_packing_does_not_depend_on_partitions(spark, tmp_path):
    """Which rows hold a document does; its ids, put together again, don't.  Rows are written and read back."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["thing", "of", "é", "word"], k=rng.choice([0, 3, 90, 900])))) for i in range(120)], "doc_id long, text string")
    want = {r.doc_id: [*encoding().encode_ordinary(r.text), 50256] for r in docs.collect()}
    for n in (1, 5):
        folder = str(tmp_path / f"p{n}")
        pack.write(pack.pack(docs.repartition(n), row=256, buffer=3000), folder)
        parts = {}
        for r in spark.read.parquet(folder).collect():
            ids = np.frombuffer(r.ids, np.uint16)
            for k, (d, at) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
                parts.setdefault(d, {})[at] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
        assert {d: [x for _, p in sorted(p.items()) for x in p] for d, p in parts.items()} == want


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    """Columns named like what the stages use inside come out as they went in."""
    extra = ("_row", "_whole", "key", "row_key", "entity", "n_shingles", "pack", "part", "_copies", "_size", "kept", "items", "starts", "_pattern", "held_out", "a.b", "back`tick", "_whole.text")
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"word{i}" for i in range(400)], k=120)) for _ in range(30)]
    rows = [(i, t, "en", "s", *(f"{c}{i}" for c in extra), {"k": i, "l": None}, [{"m": i}]) for i, t in enumerate(texts)]
    kinds = [("doc_id", "long"), *((c, "string") for c in ("text", "lang", "source", *extra)), ("pairs", "map<string,long>"), ("deep", "array<map<string,long>>")]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` {kind}" for c, kind in kinds))
    spark.createDataFrame([(1, "nothing of the sort")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(tuple(r) == rows[r.doc_id] for r in got), name


def test_rows_of_equal_maps_are_one(spark):
    """Repeated rows with a map go, whatever the order of its entries; rows that differ in it are copies of each other too."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, {"a": 1, "b": 2}), (1, text, {"b": 2, "a": 1}), (1, text, {"a": 1}), (2, "x", None)], "doc_id long, text string, m map<string,long>")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 2]


def test_no_sources_at_all(spark):
    """A null array of sources is an empty one: nothing takes the document."""
    docs = spark.createDataFrame([(1, "a b c", ["s"]), (2, "d e", None), (3, "f", [])], "doc_id long, text string, source array<string>")
    got = {r.doc_id: r for r in mix.mix(docs).collect()}
    assert got[1]["_copies"] > 0 and all(got[k]["_copies"] == 0 and got[k]["_target"] == 0 for k in (2, 3))
