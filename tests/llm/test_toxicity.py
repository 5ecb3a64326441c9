"""op13: folding, the automaton against a plain scan, learnt lexicons on held-out and disguised texts, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomap.llm import toxicity as tx

LEXICON = tx.Lexicon.of({"idiot": 3.0, "loser": 2.0, "kill": 4.0, "kil": 1.0}, ["kill the process", "never kill", "idiotproof"])


@pytest.mark.parametrize("text", ["Loser", "L0SER", "1oser", "lоsеr", "Ｌｏｓｅｒ", "lo​ser", "lóser", "\U0001d425\U0001d428\U0001d42c\U0001d41e\U0001d42b", "lο$er"])
def test_disguises_are_folded(text):
    assert tx.fold(text) == tx.fold("loser") == " ioser"


def test_letters_of_other_words_stay():
    assert tx.fold("Été, ñandú—straße\tЖ中\x00") == " été  ñandú straße ж中 "
    assert tx.fold(None) == tx.fold("") == " "


def plain_hits(folded, weights):
    out, at = [], 0
    while at < len(folded):
        found = max((p for p in weights if folded.startswith(p, at)), key=len, default=None)
        if found:
            out.append((at + len(found) - 1, found, weights[found]))
        at += len(found) if found else 1
    return out


def test_longest_patterns_and_exceptions():
    rng = random.Random(2)
    match = tx.Matcher(LEXICON)
    words = ["idiot", "idiots", "idiotproof", "kill", "killing", "the", "process", "never", "kil", "ki", "overkill", "l0ser", "x"]
    for _ in range(400):
        folded = tx.fold(" ".join(rng.choices(words, k=rng.randint(0, 12))))
        got = [(at, p, w) for at, p, w in match.hits(folded) if w]
        assert got == [h for h in plain_hits(folded, LEXICON.weights) if h[2]]
    assert match.features("Never kill an idiot; kill the process, kill -9.")[:3] == (2, 7.0, 2)
    assert tx.Matcher(tx.Lexicon()).features("kill") == (0, 0.0, 0, 1)


def test_terms_take_their_rows_from_shorter_ones():
    terms = {" pat": (95, 30), " path": (90, 2), " pathe": (90, 0), " pathet": (90, 0), " veq": (80, 0), " vequ": (80, 0), " vequa": (40, 0), " veque": (39, 0)}
    assert set(tx.explained(terms, 100, 1000)) == {" pathet", " vequ"}


def test_the_layer_is_fitted():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((4000, 1)), rng.normal(size=(4000, 2))], axis=1)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [-1.0, 2.0, 0.0])))).astype(float)
    assert np.allclose(tx.fitted_layer(x, y), [-1.0, 2.0, 0.0], atol=0.2)


def corpus(seed, n):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("abcdefghijkmnoprstuvwyz", k=rng.randint(3, 8))) for _ in range(400)]
    bad = ["blarg", "snorf", "quibz"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = rng.choices(clean, k=rng.randint(20, 120))
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "er", "ing"]))
        if not toxic and i % 12 == 0:
            words.insert(rng.randrange(len(words)), "snorfax")
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_learnt_lexicon_on_rows_it_has_not_seen(spark):
    docs, labels = corpus(3, 1500)
    table, marks = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = tx.fit(table, marks)
    assert {" biarg", " snorf", " quibz"} <= {p for p, w in lexicon.weights.items() if w} and all(p[:6] in (" biarg", " snorf", " quibz") for p, w in lexicon.weights.items() if w >= 2)
    assert lexicon.weights.get(" snorfax", 1.0) == 0.0
    got = {r.doc_id: r for r in tx.score(table, lexicon).collect()}
    for i, _, toxic in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == toxic == int(got[i].score >= 0.5)
    disguised = spark.createDataFrame([(0, docs[0][1] + " b1arg ѕnorf quіbz"), (1, docs[1][1] + " snorfax snorfax"), (2, "snorfax")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in tx.score(disguised, lexicon).collect()} == {0: 1, 1: labels[1][2], 2: 0}
    # what is held out teaches nothing
    others = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = tx.fit(table, others)
    assert again.weights == lexicon.weights and np.allclose(again.layer, lexicon.layer)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "kill", 1), (1, None, 2), (2, "", 3), (3, "l0ser " * 50_000, 4), (3, "l0ser " * 50_000, 4), (4, "...", 5)], "doc_id long, text string, score int").repartition(2)
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((repr(r.doc_id), r.held_out, r.hits, round(r.weight, 3)) for r in tx.score(docs, LEXICON).collect())
    want = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    loud = round(2 * float(np.log2(50_001)), 3)
    assert got == sorted([("None", False, 1, 4.0), ("1", want(1), 0, 0.0), ("2", want(2), 0, 0.0), ("3", want(3), 50_000, loud), ("3", want(3), 50_000, loud), ("4", want(4), 0, 0.0)])
    assert tx.score(docs.where("false"), LEXICON).count() == 0
    for marks in (labels, labels.where("false"), labels.withColumn("toxic", F.lit(1))):
        lexicon = tx.fit(docs, marks)
        assert lexicon.weights == {} and len({r.score for r in tx.score(docs, lexicon).collect()}) == 1


def test_copies_count_once(spark):
    docs, labels = corpus(5, 400)
    copies = [(1000 + i, "the same vile text of many copies blarg") for i in range(200)]
    table = spark.createDataFrame(docs + copies, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(i, 0, 1) for i, _ in copies], "doc_id long, quality int, toxic int")
    lexicon = tx.fit(table, marks)
    assert not {" viie", " same", " copies", " copi"} & set(lexicon.weights)
