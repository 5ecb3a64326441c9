"""op2, op9 and op10: SQL's rows, plain versions, and cases that are odd."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomap.llm import decontaminate, quality_cnn, quality_rules


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            iw = words_of(t)
            n = min(13, len(iw))
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows(iw, n):
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [10**6, 40])
def test_contamination(spark, block):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(9)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(30)] + [(30, None), (31, "é-É ß"), (32, "aAa...Bb 9")]
    docs = []
    for i in range(60):
        part = rng.choice(items)[1] or ""
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice([" ", "--"]) + part.upper() + " " + " ".join(f"z{rng.random()}" for _ in range(rng.choice([0, 300])))))
    docs += [(60, None), (61, ""), (None, items[5][1]), (1, docs[1][1])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_hit int")
    got = decontaminate.contamination(frame, bench, block_windows=block).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_hits(docs, items)
    kept = decontaminate.clean(frame, bench, block_windows=block)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.contaminated)
    assert decontaminate.contamination(frame, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(frame.where("false"), bench).count() == 0


def quality_docs():
    rng = random.Random(6)
    vocabulary = ["the", "of", "Words", "ça", "longerword", "#hash", "a|b", "x"]
    docs = []
    for i in range(500):
        w = rng.choices(vocabulary if i % 9 else ["###", "&&&", "loooooooooooooooooong"], k=rng.choice([0, 3, 49, 50, 80, 200]))
        text = rng.choice([" ", "\n", "\t\x0b ", " \n\n"]).join(w)
        docs.append((i, text + rng.choice(["", "\n" + text, " "]), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None])))
    return docs + [(500, None, "en", "s1"), (501, "", None, None), (None, "a b c " * 30, "en", "s1"), (3, docs[3][1], "en", "s1"), (4, "a b\x1cc " * 60, "en", "s1"), (5, "é" * 20000, "en", "s1")]


def test_quality_rules(spark):
    docs = quality_docs()
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, source string, n_words int, _lang int")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(str(tuple(r)) for r in quality_rules.judge(frame).select(names).collect())
    distinct = [(k if d[0] is None else d[0], *d[1:]) for k, d in enumerate(docs)]
    documents = pa.table({n: [d[i] for d in docs] for i, n in enumerate(["doc_id", "text", "lang", "source"])})
    documents = documents.set_column(0, "doc_id", pa.array(range(len(docs)), pa.int64()))
    con = duckdb.connect()
    con.register("documents", documents)
    sql = con.execute(quality_rules.ORACLE)
    at = [d[0] for d in sql.description]
    want = sorted(str(tuple(docs[r[at.index("doc_id")]][0] if n == "doc_id" else r[at.index(n)] for n in names)) for r in sql.fetchall())
    assert got == want and len(distinct) == len(got)
    kept = quality_rules.keep(frame)
    assert kept.columns == frame.columns and kept.count() == sum(g.endswith("True)") for g in got)
    assert quality_rules.judge(frame.where("false")).count() == 0


def test_chunks_cover_all():
    texts = [b"", b"a" * 10, bytes(range(256)) * 9, b"q" * 512, b"r" * 513]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    chunks, n = quality_cnn.chunks_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    at = np.cumsum(n) - n
    for t, a, k in zip(texts, at, n, strict=True):
        whole = b"".join(bytes(chunks[a + i][: quality_cnn.STEP if i < k - 1 else quality_cnn.CHUNK]) for i in range(k))
        assert whole.rstrip(b"\0") == t.rstrip(b"\0")


def test_gradients():
    net = quality_cnn.Network(1)
    net.p = {k: v.astype(np.float64) + (0.3 if k == "out" else 0) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    chunks, n, y = rng.integers(97, 123, (5, quality_cnn.CHUNK), dtype=np.uint8), np.array([1, 3, 1]), np.array([0.0, 1.0, 1.0])

    def loss():
        p = net.score(chunks, n)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


    for name, g in net.gradients(chunks, n, y).items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(len(flat), 3):
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g.reshape(-1)[i]) < 2e-3


def test_quality_cnn_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_cnn.score(docs, quality_cnn.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    ranked = sorted(rows, key=lambda r: r.score)
    good = [k for k, r in enumerate(ranked) if r.quality == 1]
    bad = len(rows) - len(good)
    assert (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * bad) > 0.8


def test_quality_cnn_odd(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "text", 9), (3, "x" * 100000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_cnn.score(docs, quality_cnn.fit(docs, labels)).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)


def test_quality_cnn_long_texts(spark, monkeypatch):
    """A long text neither ends the sample nor drops out of it, and the bound on chunks holds."""
    seen, train = [], quality_cnn.train
    monkeypatch.setattr(quality_cnn, "train", lambda chunks, n, y: (seen.append((len(chunks), n.tolist(), y)), train(chunks, n, y, epochs=1))[1])
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % quality_cnn.FOLDS != quality_cnn.HELD_OUT][:41]
    docs = spark.createDataFrame([(ids[0], "long " * 20000), *[(i, f"short text {i}") for i in ids[1:]], (ids[5], f"short text {ids[5]}")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    quality_cnn.fit(docs, labels, chunks=64)
    assert sorted(seen[0][1]) == [1] * 40 + [4] and seen[0][0] == 44 and sum(seen[0][2]) == 20
    quality_cnn.fit(docs, labels, chunks=16)
    assert seen[1][0] == sum(seen[1][1]) == 16
    assert quality_cnn.fitting([3, 9, 2, 4], 6) == [0, 2]
