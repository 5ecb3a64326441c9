"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie.  A node that can't go on with the next byte pops the pieces that greedy
matching would cut from its string (only their number is kept) and follows its failure link to
the node of what is left, so every byte is read once and no piece is built.  Failure links and popped counts are
computed once, level by level, and composed into one table of (next node, popped count).  A word
is matched with a space before it, as the vocabulary marks word starts; every single byte must be
in the vocabulary, so any word can be cut.  Each distinct word of a piece of text is matched once.

Defined results: null and empty texts have 0 words and tokens; a word of any length is matched
whole; repeated rows are counted one by one.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomap.llm._text import find_words, pieces, spread
from loomap.llm._vocab import TOKENIZERS, ranks

COUNTS = "doc_id long, n_words long, n_tokens long, most_tokens long"
#: Words longer than this are matched by the table too, but one by one.
STEPWISE = 256


class Automaton:
    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        is_token = [False]
        for token in vocabulary:
            at = 0
            for c in token:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    is_token.append(False)
                at = nxt
            is_token[at] = True
        if len(children[0]) != 256 or not all(is_token[v] for v in children[0].values()):
            raise ValueError("the vocabulary must hold every single byte")
        n = len(children)
        self.fail, self.pops = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.next, self.popped = np.zeros((n, 256), np.int32), np.zeros((n, 256), np.uint8)
        # the root goes on with every byte; a deeper node takes its own children, else what its failure link does
        queue = [0]
        for v in queue:
            if v:
                self.next[v] = self.next[self.fail[v]]
                self.popped[v] = self.popped[self.fail[v]] + self.pops[v]
            for c, child in children[v].items():
                if is_token[child]:
                    self.fail[child], self.pops[child] = 0, 1
                else:
                    # read c with the parent's failure, popping on the way
                    self.fail[child] = self.next[self.fail[v], c]
                    self.pops[child] = self.pops[v] + self.popped[self.fail[v], c]
            for c, child in children[v].items():
                self.next[v, c], self.popped[v, c] = child, 0
            queue.extend(children[v].values())
        # popped when the word ends: the pieces of the node's whole string
        self.end = np.zeros(n, np.int32)
        for v in queue[1:]:
            self.end[v] = self.pops[v] + self.end[self.fail[v]]
        self.start = int(self.next[0, 0x20])

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of pieces of each word ``data[start:end]``."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        begin, length = starts[order], length[order]
        state, total = np.full(len(order), self.start, np.int32), np.zeros(len(order), np.int64)
        open_ = len(order)
        for step in range(min(int(length[0]), STEPWISE) if len(order) else 0):
            open_ = int(np.searchsorted(-length, -step, "left"))  # those longer than step
            c = data[begin[:open_] + step]
            total[:open_] += self.popped[state[:open_], c]
            state[:open_] = self.next[state[:open_], c]
        for i in range(int(np.searchsorted(-length, -STEPWISE, "left"))):
            s, n = int(state[i]), 0
            nxt, popped = self.next, self.popped
            for c in data[begin[i] + STEPWISE : begin[i] + length[i]].tolist():
                n += int(popped[s, c])
                s = int(nxt[s, c])
            state[i], total[i] = s, total[i] + n
        out = np.empty(len(order), np.int64)
        out[order] = total + self.end[state]
        return out


_made: dict[tuple[str, str], Automaton] = {}


def automaton(name: str, folder: str) -> Automaton:
    """One automaton for each Python worker."""
    if (name, folder) not in _made:
        _made[name, folder] = Automaton(list(ranks(name, folder)))
    return _made[name, folder]


def _count(name: str, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = automaton(name, folder)
    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            starts, ends, first = find_words(data, offsets)
            words = np.diff(first)
            # the words' bytes in a row, as a binary array without gaps
            size = ends - starts
            edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            packed = data[spread(starts, size)]
            distinct = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(packed)]).dictionary_encode()
            which = distinct.indices.to_numpy()
            # every distinct word is looked at where it comes first
            _, at = np.unique(which, return_index=True)
            n = auto.count(data, starts[at], ends[at])[which] if len(starts) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(n)])
            most = np.zeros(piece.num_rows, np.int64)
            if len(n):
                most[words > 0] = np.maximum.reduceat(n, first[:-1][words > 0])
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("doc_id")), pa.array(words.astype(np.int64)), pa.array(upto[first[1:]] - upto[first[:-1]]), pa.array(most)], names=["doc_id", "n_words", "n_tokens", "most_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens, most_tokens (of one word)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: _count(vocabulary, folder, batches), COUNTS)
