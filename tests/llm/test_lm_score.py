"""op1: base scores against a plain version; the model's windows, gradients and normalisation."""

import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from loomap.llm import lm_score


def documents():
    rng = random.Random(8)
    words = ["The", "of", "thansion", "ça", "x", "re-ader", "ING", "ble"]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(120)]
    return [*rows, (200, None), (201, ""), (None, "the the"), (5, rows[5][1]), (5, rows[5][1]), (203, "w" * 3000), (204, "only here " * 3)]


def test_scores(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = lm_score.scores(docs, steps=60, bucket_bytes=3000).collect()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter(x for h, ws in zip(held, tokens, strict=True) if not h for x in ws)
    n = sum(count.values())
    want = []
    for (i, _), h, ws in zip(rows, held, tokens, strict=True):
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (len(count) + 1))) for x in ws)
        want.append((i, h, len(ws), sum(count[x] > 0 for x in ws), n, round(base, 6)))
    assert sorted(map(str, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got))) == sorted(map(str, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.scores(none).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")  # nothing to learn from
    assert math.isfinite(lm_score.scores(one).first().score)


def model(seen=(5, 6, 7, 300, lm_score.END)):
    counts = np.zeros(lm_score.IDS)
    counts[list(seen)] = [9, 4, 2, 7, 5]
    classes = lm_score.Classes(counts)
    rng = np.random.default_rng(7)
    before, ids = rng.choice(seen, 300), rng.choice(seen, 300)
    one, two = (np.bincount(x, minlength=classes.n * lm_score.CLASSES) for x in classes.places(before, ids))
    return lm_score.Model(classes, one.reshape(-1, lm_score.CLASSES), two.reshape(lm_score.CLASSES, -1))


def texts_of_ids():
    first = np.concatenate([[0], np.cumsum([1, 2, 23, 24, 25, 42, 43, 100])])
    ids = np.random.default_rng(1).choice([5, 6, 7, 300, 9999], first[-1])
    ids[first[1:] - 1] = lm_score.END
    return ids, first


def test_every_id_is_scored_once():
    m, (ids, first) = model(), texts_of_ids()
    windows = lm_score.windows_of(first)
    before, target, scored = lm_score.rows_of(ids, first, windows)
    assert np.bincount(windows[0], scored.sum(1)).tolist() == np.diff(first).tolist()
    p = m.log10(m.classes.known[before], m.classes.group[before], target, scored)
    assert (p[~scored] == 0).all() and np.allclose(lm_score.score_ids(m, ids, first), np.bincount(windows[0], p.sum(1)))


def test_scores_against_a_plain_forward_pass():
    """Place by place, with loops over the places before."""
    m, (ids, first) = model(), texts_of_ids()
    c, p = m.classes, {k: v.astype(float) for k, v in m.p.items()}
    p["near"] = m.p["near"] = np.linspace(0.5, -0.5, lm_score.WINDOW).astype(np.float32)
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        text, total = [lm_score.END, *ids[a:b].tolist()], 0.0
        for t in range(b - a):
            window = 0 if t < lm_score.WINDOW else (t - lm_score.WINDOW) // lm_score.STEP + 1
            x = m.vector[c.known[text[window * lm_score.STEP : t + 1]]].astype(float)
            q, k, v = np.split(x @ p["qkv"], 3, axis=1)
            e = np.exp([q[-1] @ k[i] / math.sqrt(lm_score.WIDTH) + p["near"][len(x) - 1 - i] for i in range(len(x))])
            h = np.maximum((e / e.sum()) @ v @ p["mixed"] + x[-1] @ p["direct"] + p["bias"], 0)
            g, k = c.group[text[t]], c.group[text[t + 1]]
            top, low = divmod(int(k), lm_score.EACH)
            z = np.exp(h @ p["group"] + m.start[c.known[text[t]]] + p["prior"])
            y = np.exp(h @ p["class"][top] + m.inside[c.known[text[t]] * lm_score.GROUPS + top] + p["shift"][top])
            share = (m.after_classes[g, c.known[text[t + 1]]] + 6 * c.share[text[t + 1]]) / (m.both[g, k] + 6)
            total += math.log10(z[top] / z.sum() * y[low] / y.sum() * share)
        want.append(total)
    assert np.allclose(lm_score.score_ids(m, ids, first), want, rtol=1e-4)


def test_later_windows_ask_for_scored_places_only(monkeypatch):
    """Exponentials of pairs of places are made for the places that are scored, in blocks of windows alike."""
    m, (ids, first) = model(), texts_of_ids()
    places, hidden = [], lm_score.Model.hidden
    monkeypatch.setattr(lm_score.Model, "hidden", lambda self, *args: (out := hidden(self, *args), places.append(out[1].shape))[0])
    monkeypatch.setattr(lm_score, "BLOCK", 8)
    lm_score.score_ids(m, ids, first)
    assert sum(w for w, *_ in places) == len(lm_score.windows_of(first)[0])
    assert any(n == lm_score.STEP for _, n, _ in places) and all(n in (lm_score.STEP, lm_score.WINDOW) for _, n, _ in places)


def test_probabilities_sum_to_one():
    m = model()
    every = np.repeat(np.arange(lm_score.IDS)[:, None], lm_score.WINDOW, 1)
    before = np.full(every.shape, 6)
    total = sum((10 ** m.log10(m.classes.known[before[i : i + 4096]], m.classes.group[before[i : i + 4096]], every[i : i + 4096], every[i : i + 4096] >= 0)[:, 3]).sum() for i in range(0, lm_score.IDS, 4096))
    assert abs(total - 1) < 1e-3


def test_later_ids_change_nothing():
    m = model()
    a = np.ones((1, lm_score.WINDOW), np.int64)
    b = a.copy()
    b[0, 10:] = 3
    x, y = (m.log10(i, np.zeros_like(i), np.full((1, lm_score.WINDOW), 6), np.ones((1, lm_score.WINDOW), bool)) for i in (a, b))
    assert np.allclose(x[0, :10], y[0, :10]) and not np.allclose(x[0, 10:], y[0, 10:])


def test_gradients():
    m = model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.mask, m.vector, m.start, m.inside = (x.astype(np.float64) for x in (m.mask, m.vector, m.start, m.inside))
    rng = np.random.default_rng(2)
    inputs, target = rng.integers(0, 6, (3, lm_score.WINDOW)), rng.integers(0, lm_score.CLASSES, (3, lm_score.WINDOW))
    scored = rng.random((3, lm_score.WINDOW)) < 0.7
    for name, g in m.gradients(inputs, target, scored)[1].items():
        flat = m.p[name].reshape(-1)
        for i in rng.choice(len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-4
            up = m.gradients(inputs, target, scored)[0]
            flat[i] = old - 1e-4
            down = m.gradients(inputs, target, scored)[0]
            flat[i] = old
            assert abs((up - down) / 2e-4 - g.reshape(-1)[i]) < 1e-5


def table(spark, docs, n_shards, rounds):
    texts = docs.selectExpr("doc_id", "text", "false as held_out", "doc_id as row_key")
    return texts.mapInArrow(functools.partial(lm_score._ids, n_shards, rounds, "byte_bpe_50k.tiktoken", lm_score.TOKENIZERS), lm_score.IDS_TABLE).cache()


def ids_of(texts):
    encoder, data = lm_score.Encoder("byte_bpe_50k.tiktoken", lm_score.TOKENIZERS), [t.encode() for t in texts]
    return lm_score.with_ends(encoder, lm_score.LOWER[np.frombuffer(b"".join(data), np.uint8)], np.concatenate([[0], np.cumsum([len(d) for d in data])]))


def test_all_training_rows_are_learnt_from(spark, monkeypatch):
    """All training rows are counted, dealt to some round and shard, and each window of a shard is used."""
    docs = spark.createDataFrame([(i, f"w{i} " + "some words of a text " * 9) for i in range(1000)] + [(2000, "zyzzyva")], "doc_id long, text string")
    rows = table(spark, docs, 3, 2)
    ids, first = ids_of(r.text for r in docs.collect())
    assert rows.count() == 1001 and {(r["round"], r["shard"]) for r in rows.collect()} == {(i, j) for i in range(2) for j in range(3)}
    got = lm_score.trained(rows, steps=4, rounds=2)
    want = lm_score.Classes(np.bincount(ids, minlength=lm_score.IDS).astype(float))
    assert got.classes.share.tolist() == want.share.tolist() and got.both.sum() == len(ids)
    used, take = [], lm_score.Adam.take
    monkeypatch.setattr(lm_score.Adam, "take", lambda self, rate, inputs, target, scored: (used.append(inputs), take(self, rate, inputs, target, scored)))
    _, n = lm_score.learn(got, ids, first, 0, 2, 4)
    before = lm_score.rows_of(ids, first, lm_score.windows_of(first))[0]
    assert n == len(before) and {x.tobytes() for x in np.concatenate(used)} == {x.tobytes() for x in got.classes.known[before]}
    rows.unpersist()


def test_the_model_beats_a_bigram(spark):
    """On the held-out fold of a thousand documents, against an interpolated bigram (0.7) of the same training fold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    total = sum(r.score for r in lm_score.scores(docs).where("held_out").collect())
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    learnt, _ = ids_of(r.text or "" for r in rows if not held[r.doc_id])
    ids, first = ids_of(r.text or "" for r in rows if held[r.doc_id])
    single, before = np.bincount(learnt, minlength=lm_score.IDS), np.concatenate([[lm_score.END], learnt[:-1]])
    pairs, seen = Counter(zip(before.tolist(), learnt.tolist(), strict=True)), np.bincount(before, minlength=lm_score.IDS)
    share = (single + 0.1) / (single.sum() + 0.1 * lm_score.IDS)
    before = np.concatenate([[lm_score.END], ids[:-1]])
    bigram = [0.7 * pairs[a, b] / seen[a] + 0.3 * share[b] if seen[a] else share[b] for a, b in zip(before.tolist(), ids.tolist(), strict=True)]
    assert -total / len(ids) < -np.log10(bigram).mean() - 0.02


def test_what_the_packs_send_follows_their_words(spark):
    """A pack's rows for the buckets hold each distinct word once, however many buckets there are."""
    rng = random.Random(2)
    group = pa.table({"doc_id": pa.array(range(200), pa.int64()), "text": [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(200)], "held_out": [False] * 200, "row_key": pa.array(range(200), pa.int64()), "pack": pa.array([0] * 200, pa.int32())})
    sizes = [sum(len(r["words"]) + len(r["counts"]) for r in lm_score._words(n, group).to_pylist()) for n in (16, 30_000)]
    assert sizes[0] == sizes[1]
