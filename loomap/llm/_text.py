"""Byte-level views of Arrow text columns: words, hashes of words and of word windows.

Everything here works on the numpy views of one bounded piece of an Arrow batch inside a
Spark task.  ``pieces`` cuts a batch so that the arrays stay small whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomap.llm._spark import release

U64 = np.uint64
#: Text bytes that one piece may hold (a longer document is a piece of its own).
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of `[^\x20\x09-\x0D]+`.
WORD = ~_SPACE
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, to be used after LOWER.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Maps A-Z to a-z and leaves the other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits; works in place."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Poly:
    """Prefix sums of a polynomial modulo 2**64, from which the hash of any slice is one subtraction."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=U64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of_slices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte slices ``data[starts:ends]``."""
        c = self.prefix(self.table[data])
        return mix((c[ends] - c[starts]) * self.down[starts] + (ends - starts).astype(U64))

    def windows(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of k values; entry i covers ``h[i:i+k]``."""
        if len(h) < k:
            return np.zeros(0, U64)
        c = self.prefix(h)
        return mix((c[k:] - c[:-k]) * self.down[: len(h) - k + 1] + U64(k))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets (null: empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``size`` text bytes, each with its bytes and offsets."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    release()


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = is_word[data]
    begin, end = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first], end[last] = w[first], w[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def left_in_document(first_word: np.ndarray) -> np.ndarray:
    """For each word, how many words its document still has from it on."""
    n = np.diff(first_word)
    return np.repeat(first_word[1:], n) - np.arange(first_word[-1])


def run_min(x: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """Minimum (or another associative, idempotent choice) of every run of w values."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while have < w:
        step = min(have, w - have)
        m = least(m[: len(m) - step], m[step:])
        have += step
    return m


def winnow(x: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is least in some run of w values that lie in one document.

    ``valid`` tells for each position whether the run starting there stays in its document.
    All positions that share a least value are taken, so the choice depends on the run's content only.
    """
    if len(x) < w:
        return np.zeros(0, np.int64)
    m = run_min(x, w)
    m = np.where(valid[: len(m)], m, U64(0))
    padded = np.concatenate([np.zeros(w - 1, U64), m, np.zeros(w - 1, U64)])
    return np.flatnonzero((run_min(padded, w, np.maximum) == x) & (x != 0))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of the ranges ``[start, start + count)``, one range after another."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    if total == 0:
        return out
    starts, counts = starts[counts > 0], counts[counts > 0]
    at = np.cumsum(counts)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of n places, true where some range ``[start, start + width)`` lies."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0
