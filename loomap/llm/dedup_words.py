"""Substring dedup on words by level-wise doubling.

A word is removed if it is covered by a window of WINDOW words whose word sequence also starts in a
document with a smaller doc_id; windows are judged on the input.

Levels: windows of ``first`` words are looked at first, then twice that, and so on up to WINDOW.
At each level only those whose shorter window is repeated in several documents are extended; the
rest is dropped, and the loop ends when none survives.  A window of WINDOW words is represented at a
lower level by the shorter window around its anchor, the least hash of its ``first``-word grams, so
equal windows have equal representatives, and the first level holds about one in four places only.
Lower levels propose by 48-bit hashes; at the last level windows are equal if 96 bits of two
independent hashes are.

Each level sends distinct hashes to buckets (see _repeats) and the survivors back to the packs.  At
the last level a pack sends the surviving windows with the least document that has each, and a bucket tells it the least of
all; what is removed follows from these answers alone.  No pair of documents is ever formed, so groups of copies cost their size.

Defined results: null and empty texts have no words (kept_sha256 of nothing); rows with the same doc_id don't
remove from each other; a null doc_id neither removes nor is removed from; fewer than WINDOW words keep all.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomap.llm._repeats import ALIVE, BUCKET_BYTES, ENTRIES, ENTRY_SCHEMA, PACK_BYTES, Packs, alive_set, among, entries, gathered, run_argmin, survivors
from loomap.llm._spark import blob, joined, parts_for, release, split_by, written
from loomap.llm._text import U64, Poly, covered, find_words, left_in_document, pieces, spread

WINDOW = 13
FIRST = 4
CELLS = ("high", "low", "docs", "several")
LAST = "bucket int, pack int, high binary, low binary, docs binary, several binary"
FIRSTS = "pack int, high binary, low binary, firsts binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
LAST_SCHEMA = pa.schema([("bucket", pa.int32()), ("pack", pa.int32()), *[(k, pa.binary()) for k in CELLS]])
FIRST_SCHEMA = pa.schema([("pack", pa.int32()), *[(k, pa.binary()) for k in ("high", "low", "firsts")]])
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def lengths(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """first, twice that, ..., window."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Windows:
    """All windows of a piece of text, their anchors and their representatives at each level."""

    def __init__(self, piece: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, window: int, first: int):
        self.window = window
        self.data = data
        self.starts, self.ends, self.first_word = find_words(data, offsets)
        self.poly = Poly(11), Poly(12)
        self.hash = self.poly[0].of_slices(data, self.starts, self.ends)
        left = left_in_document(self.first_word)
        ids = piece.column(piece.schema.get_field_index("doc_id"))
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.doc_of_word = np.repeat(np.arange(piece.num_rows), np.diff(self.first_word))
        grams = self.poly[0].windows(self.hash, first)
        anchor = run_argmin(grams, window - first + 1)
        self.at = np.flatnonzero((left[: len(anchor)] >= window) & self.known[self.doc_of_word[: len(anchor)]])
        self.anchor = anchor[self.at]

    def keep(self, mask: np.ndarray) -> None:
        self.at, self.anchor = self.at[mask], self.anchor[mask]

    def level(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows' representatives of so many words."""
        place = np.minimum(self.anchor, self.at + self.window - length)
        return place, self.poly[0].windows(self.hash, length)[place]

    def second(self) -> np.ndarray:
        """Independent hashes of the whole windows."""
        return self.poly[1].windows(self.poly[1].of_slices(self.data, self.starts, self.ends), self.window)[self.at]


def _by_piece(group: pa.Table, window: int, first: int) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    for batch in group.to_batches():
        for piece, data, offsets in pieces(batch, "text"):
            yield piece, Windows(piece, data, offsets, window, first)


def _found(w: Windows, piece: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and packs of the windows' representatives."""
    place, h = w.level(length)
    place, one = np.unique(place, return_index=True)
    doc = w.doc_of_word[place]
    packs = piece.column(piece.schema.get_field_index("pack")).to_numpy(zero_copy_only=False)
    return h[one], w.ids[doc], packs[doc]


def _first_level(window: int, first: int, n_buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from gathered((_found(Windows(piece, data, offsets, window, first), piece, first) for batch in batches for piece, data, offsets in pieces(batch, "text")), n_buckets)


def _middle_level(window: int, first: int, before: int, length: int, n_buckets: int, texts: pa.Table, alive: pa.Table) -> pa.Table:
    found, parts = alive_set(alive), []
    for piece, w in _by_piece(texts, window, first) if len(found) else ():
        w.keep(among(w.level(before)[1], found))
        parts.append(_found(w, piece, length))
    rows = list(entries(n_buckets, *(np.concatenate(x) for x in zip(*parts, strict=True)))) if parts else []
    return pa.Table.from_pylist(rows, schema=ENTRY_SCHEMA)


def _last_level(window: int, first: int, before: int, n_buckets: int, texts: pa.Table, alive: pa.Table) -> pa.Table:
    """The distinct whole windows of a pack whose shorter window survived, with the least document that has each."""
    found, parts = alive_set(alive), []
    for _, w in _by_piece(texts, window, first) if len(found) else ():
        w.keep(among(w.level(before)[1], found))
        parts.append((w.level(window)[1], w.second().astype(np.uint32), w.ids[w.doc_of_word[w.at]]))
    if not parts:
        return pa.Table.from_pylist([], schema=LAST_SCHEMA)
    h, s, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((d, s, h))
    h, s, d = h[order], s[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])[: len(h)])
    several = (d[new] != d[np.append(new[1:], len(h))[: len(new)] - 1]).astype(np.uint8)
    h, s, d, pack = h[new], s[new], d[new], texts["pack"][0].as_py()
    rows = [{"bucket": b, "pack": pack, "high": blob(h[at]), "low": blob(s[at]), "docs": blob(d[at].astype(np.int64)), "several": blob(several[at])} for b, at in split_by((h % U64(n_buckets)).astype(np.int64))]
    return pa.Table.from_pylist(rows, schema=LAST_SCHEMA)


def _firsts(group: pa.Table) -> pa.Table:
    """For each pack the windows of which it holds one that isn't the first, and the document that has them first."""
    release()
    (h, n), s, d, several = joined(group["high"], U64), *(joined(group[k], t)[0] for k, t in (("low", np.uint32), ("docs", np.int64), ("several", np.uint8)))
    p = np.repeat(group["pack"].to_numpy(), n)
    order = np.lexsort((d, s, h))
    h, s, d, p, several = h[order], s[order], d[order], p[order], several[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])[: len(h)]
    first = d[new][np.cumsum(new) - 1]
    told = np.flatnonzero((d > first) | (several > 0))
    rows = [{"pack": k, "high": blob(h[told[at]]), "low": blob(s[told[at]]), "firsts": blob(first[told[at]])} for k, at in split_by(p[told])]
    return pa.Table.from_pylist(rows, schema=FIRST_SCHEMA)


def _remove(window: int, first: int, texts: pa.Table, firsts: pa.Table) -> pa.Table:
    """Digests the documents of a pack without the words of windows that an earlier document has."""
    high, low, earliest = (joined(firsts[k], t)[0] for k, t in (("high", U64), ("low", np.uint32), ("firsts", np.int64)))
    order = np.argsort(high, kind="stable")
    high, low, earliest = high[order], low[order], earliest[order]
    at = []
    for _, w in _by_piece(texts, window, first):
        h = w.level(window)[1]
        lo, hi = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
        row, by = spread(lo, hi - lo), np.repeat(np.arange(len(h)), hi - lo)
        bad = np.zeros(len(h), bool)
        if len(row):
            bad[by[(low[row] == w.second().astype(np.uint32)[by]) & (earliest[row] < w.ids[w.doc_of_word[w.at]][by])]] = True
        at.append(w.at[bad])
    out, k = [], 0
    for batch in texts.to_batches():
        for piece, data, offsets in pieces(batch, "text"):
            starts, ends, first_word = find_words(data, offsets)
            removed = covered(at[k], window, len(starts))
            k += 1
            size = ends - starts
            keep = ~removed
            text = np.full(int((size[keep] + 1).sum()), 0x20, np.uint8)
            upto = np.cumsum(size[keep] + 1)
            text[spread(upto - size[keep] - 1, size[keep])] = data[spread(starts[keep], size[keep])]
            gone = np.concatenate([[0], np.cumsum(removed)])[first_word]
            kept_upto = np.concatenate([[0], np.cumsum(keep)])[first_word]
            edge = np.concatenate([[0], upto])[kept_upto]
            raw = text.tobytes()
            digest = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            out.append(pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("doc_id")), pa.array(np.diff(first_word).astype(np.int64)), pa.array(np.diff(gone).astype(np.int64)), pa.array(digest)], schema=RESULT_SCHEMA))
    return pa.Table.from_batches(out, RESULT_SCHEMA)


def dedup_words(docs: DataFrame, window: int = WINDOW, first: int = FIRST, pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    if first >= window:
        raise ValueError("first must be less than window")
    packs = Packs(docs, pack_bytes)
    n_buckets = parts_for(packs.n_bytes, bucket_bytes)
    *lower, last = lengths(window, first)
    found = packs.texts.mapInArrow(functools.partial(_first_level, window, first, n_buckets), ENTRIES)
    for before, length in zip(lower, [*lower[1:], last], strict=True):
        alive = written(found.groupBy("bucket").applyInArrow(survivors, ALIVE))
        if alive.isEmpty():
            firsts = docs.sparkSession.createDataFrame([], FIRSTS)
            break
        if length < last:
            found = packs.told(alive).applyInArrow(functools.partial(_middle_level, window, first, before, length, n_buckets), ENTRIES)
        else:
            windows = packs.told(alive).applyInArrow(functools.partial(_last_level, window, first, before, n_buckets), LAST)
            firsts = written(windows.groupBy("bucket").applyInArrow(lambda group: _firsts(group), FIRSTS))
    return packs.told(firsts).applyInArrow(functools.partial(_remove, window, first), RESULT)
