"""The pipeline: each stage against a plain version on the smallest tables, and odd documents through all of it."""

import duckdb
import numpy as np
import pytest
from test_filters import plain_hits
from test_jaccard import plain
from test_mix import plain_targets

import corpus_pipeline
from loomap.llm import quality_rules
from loomap.llm._vocab import encoding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "token_ids"]
    for name, df in stages.items():
        assert name == "token_ids" or df.dtypes == stages["documents"].dtypes


def test_quality(stages):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({quality_rules.ORACLE}) where kept").fetchall()}
    assert rows(stages["quality_rules"]) == rows(stages["documents"].where(stages["documents"]["doc_id"].isin(list(kept))))


def test_near_duplicates(stages):
    docs = [(r.doc_id, r.text) for r in stages["quality_rules"].collect()]
    keep = {d for d, _, c in map(eval, plain(docs)) if d == c}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == keep


def test_decontamination(spark, stages):
    docs = [(r.doc_id, r.text) for r in stages["near_duplicates"].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {eval(x)[0] for x in plain_hits(docs, items) if not eval(x)[5]}
    assert {r.doc_id for r in stages["decontamination"].collect()} == clean


def test_mixture_and_tokens(stages):
    size, taken, largest = {}, {}, {}
    for r in stages["decontamination"].collect():
        largest[r.source] = max(largest.get(r.source, 0), len((r.text or "").split()))
    for df, n in ((stages["decontamination"], size), (stages["mixture"], taken)):
        for r in df.collect():
            n[r.source] = n.get(r.source, 0) + len((r.text or "").split())
    for s, want in plain_targets(size).items():
        assert abs(taken.get(s, 0) - want) <= largest[s]
    tokens = sum(len(encoding().encode_ordinary(r.text)) + 1 for r in stages["mixture"].collect())
    packed = stages["token_ids"].collect()
    assert sum(r.n_tokens for r in packed) == tokens and all(len(np.frombuffer(r.ids, np.uint16)) == 2048 for r in packed)


def test_run_with_odd_documents(spark, tmp_path):
    odd = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "word " * 80, "en", "a", 0), (3, "é" * 50000, "en", "b", 0), (4, " ".join(f"w{i}" for i in range(300)), None, None, 0), (4, " ".join(f"w{i}" for i in range(300)), None, None, 0)]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
