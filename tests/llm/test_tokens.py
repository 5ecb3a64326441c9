"""op3 and op5: exact round trip, and greedy matching against a plain version."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomap.llm import pack, token_counts
from loomap.llm._tokens import Encoder
from loomap.llm._vocab import encoding, ranks

ROWS = [
    (1, "Hello world, it's a test\n\n  with   spaces"),
    (2, None),
    (3, ""),
    (4, "x" * 9000),
    (5, "naïve café — 東京　 word   \n end"),
    (5, "naïve café — 東京　 word   \n end"),
    (None, "no id"),
    (7, " ".join(f"word{i}" for i in range(3000))),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, 1, "clash") for r in ROWS], "doc_id long, text string, n_tokens int, ids string")


def test_pack_round_trip(docs):
    encode = encoding().encode_ordinary
    want = sorted(str((i, [*encode(t or ""), 50256])) for i, t in ROWS)
    got = {}
    copies = []
    for row in pack.pack(docs.coalesce(1), row=256).collect():
        ids, ends = np.frombuffer(row.ids, np.uint16), row.cu_seqlens
        assert len(ids) == 256 and row.n_tokens == ends[-1] and row.position_resets == ends[:-1] and (ids[row.n_tokens :] == 50256).all()
        assert (np.flatnonzero(pack.positions(ends) == 0) == row.position_resets).all()
        for k, (d, at) in enumerate(zip(row.doc_ids, row.doc_starts, strict=True)):
            copies.append((d, at, ids[ends[k] : ends[k + 1]].tolist()))
    whole = {}
    for d, at, ids in sorted(copies, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        whole.setdefault((d, at), []).append(ids)
    for (d, at), parts in whole.items():
        for k, ids in enumerate(parts):
            got.setdefault((d, k), []).extend(ids)
    assert sorted(str((d, ids)) for (d, _), ids in got.items()) == want


def test_pack_empty(spark):
    assert pack.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_is_best_fit(lengths):
    row = 40
    got = pack.best_fit(np.array(lengths), row)
    room = {}
    for i in np.argsort(-np.array(lengths), kind="stable"):
        fits = [x for x in room.values() if x >= lengths[i]]
        before = room.get(got[i], row)
        assert before == (min(fits) if fits else row)
        room[got[i]] = before - lengths[i]


@given(st.lists(st.text(alphabet=" \t\n 　\x1c\x85ab1'sé!", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_whole_texts(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ids, first = Encoder().encode_texts(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == encoding().encode_ordinary(t)


def greedy(word: bytes, vocabulary) -> int:
    n = at = 0
    while at < len(word):
        size = next(k for k in range(min(130, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n, at = n + 1, at + size
    return n


def test_token_counts(docs):
    vocabulary = ranks()
    got = sorted(map(str, (tuple(r) for r in token_counts.token_counts(docs).collect())))
    want = []
    for i, t in ROWS:
        n = [greedy(b" " + w.encode(), vocabulary) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        want.append(str((i, len(n), sum(n), max(n, default=0))))
    assert got == sorted(want)


def test_small_automaton():
    vocabulary = [bytes([i]) for i in range(256)] + [b"abcde", b"ab", b"bcd", b" a", b" abcdx", b"cc"]
    words = [b"abcdefab", b"abcd", b"abcdx", b"abcdbcdccc", b"b", "é".encode(), b"abc" * 200]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = token_counts.Automaton(vocabulary).count(data, ends - [len(w) for w in words], ends)
    assert got.tolist() == [greedy(b" " + w, set(vocabulary)) for w in words]


def test_new_units_are_encoded_together():
    """Units that aren't known cost a few calls of the tokenizer in all, not one each."""
    encoder, calls = Encoder(), []
    encode = encoder.encode
    encoder.encode = lambda text: (calls.append(text), encode(text))[1]
    texts = [" ".join(f"w{i}x{k}" for i in range(500)) + " é x " for k in range(4)]
    data = [t.encode() for t in texts]
    ids, first = encoder.encode_texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert len(calls) < 20
    assert all(ids[first[k] : first[k + 1]].tolist() == encode(t) for k, t in enumerate(texts))
