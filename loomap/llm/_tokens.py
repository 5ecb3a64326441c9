"""Token ids of Arrow text columns, with a bounded memory of what was encoded before.

A text is cut into units, each a run of ASCII white space and the run of other bytes after it.  The
pattern of the tokenizer never matches across the start of such a unit, so a text's ids are those of
its units one after another.  (Only other Unicode white space could join units; a text that has
some is encoded whole.)  Units repeat a lot, so each distinct one is encoded once a batch at most.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa

from loomap.llm._text import WORD, spread
from loomap.llm._vocab import TOKENIZERS, encoding, ranks

_OTHER_SPACE = re.compile(r"[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: First bytes of the same characters.
_OTHER_LEAD = re.compile(rb"[\x1c-\x1f\xc2\xe1\xe2\xe3]")
#: Distinct units that a task remembers; beyond it starts anew, with the same results.
REMEMBER = 250_000


@functools.cache
def id_bytes(name: str, folder: str) -> np.ndarray:
    """How many bytes each id stands for."""
    of = ranks(name, folder)
    out = np.zeros(max(of.values()) + 1, np.int64)
    out[list(of.values())] = [len(token) for token in of]
    return out


class Encoder:
    def __init__(self, name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS):
        self.encode = encoding(name, folder).encode_ordinary
        self.n_bytes = id_bytes(name, folder)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Encodes units that aren't known, and gives their places.

        Those that begin with white space and don't end with it are encoded as one text: no id covers bytes of two of them, so the lengths of the ids tell whose they are.
        """
        # a unit is a piece of a text whose cut falls inside no character, so it decodes
        joins = [WORD[u[-1]] and not WORD[u[0]] and not _OTHER_LEAD.search(u) for u in units]
        together = [u for u, j in zip(units, joins, strict=True) if j]
        ids = np.array(self.encode(b"".join(together).decode()), np.int32)
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(u) for u in together], dtype=np.int64)) + 1 if together else np.zeros(0, np.int64)
        alone = [self.encode(u.decode()) for u, j in zip(units, joins, strict=True) if not j]
        order = np.argsort(~np.array(joins, bool), kind="stable")
        counts = np.concatenate([np.diff(ends, prepend=0), [len(x) for x in alone]]).astype(np.int64)
        ids = np.concatenate([ids, *[np.array(x, np.int32) for x in alone]])
        at, places = len(self.known), np.empty(len(units), np.int64)
        places[order] = at + np.arange(len(units))
        while at + len(units) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(units)], self.count[at : at + len(units)] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        self.known.update(zip(units, places.tolist(), strict=True))
        return places

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and for each text where its ids start (one more at the end)."""
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        word = WORD[data]
        begin = ~word
        begin[1:] &= word[:-1]
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(begin)
        edges = np.append(starts, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        distinct = units.dictionary_encode()
        if len(self.known) > REMEMBER:
            self._forget()
        listed = distinct.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, listed, itertools.repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn([listed[i] for i in new.tolist()])
        which = place[distinct.indices.to_numpy()]
        counts = self.count[which]
        ids = self.flat[spread(self.start[which], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        first = upto[np.searchsorted(starts, offsets)]
        return self._whole(data, offsets, ids, first)

    def _whole(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes whole the texts that have other white space."""
        lead = np.isin(data, [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
        if not lead.any():
            return ids, first
        docs = np.unique(np.searchsorted(offsets, np.flatnonzero(lead), "right") - 1)
        redo = {}
        for d in docs:
            text = data[offsets[d] : offsets[d + 1]].tobytes().decode()
            if _OTHER_SPACE.search(text):
                redo[d] = np.array(self.encode(text), np.int32)
        if not redo:
            return ids, first
        parts = [redo[d] if d in redo else ids[first[d] : first[d + 1]] for d in range(len(first) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
