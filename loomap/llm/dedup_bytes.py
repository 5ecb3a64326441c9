"""Substring dedup on bytes with suffix arrays.

A byte is removed if it is covered by a string of SPAN bytes that also starts in a document with a
smaller doc_id; strings are judged on the input and never cross documents.

1. Every string of SPAN bytes holds an anchor: the least hash of its GRAM-byte grams.  Anchors that
   only one document has can't lie in a repeated string; a first exchange (see _repeats) drops them.
2. Around each other anchor lies a fragment: all strings of SPAN bytes that hold the anchor.  The packs send
   each bucket of anchors the distinct fragments with the least document that has each.
3. A bucket builds a suffix array over the fragments that several documents have or that may share a part with another, by two-stage sorting:
   only suffixes smaller than their successors are sorted directly, the rest is induced by scans over
   the buckets of first bytes.  Neighbours whose common prefix has SPAN bytes are the same string, and
   the least document of such a run is the first to have it.
4. The answers go back to the packs: for a fragment its first document, and for the document that has it
   first the strings in it that came even earlier.

Skew: equal fragments are merged (by 96 bits of two hashes) in each piece of text and each pack before they are sent, so a passage that a third of all documents
share costs one entry for each pack; no pairs are formed.  A text of one repeated byte has an anchor
at each place; its fragments are merged before their bytes are copied.

Defined results: null and empty texts have 0 bytes; rows with the same doc_id don't remove from
each other; a null doc_id neither removes nor is removed from; texts below SPAN bytes stay whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomap.llm._repeats import ALIVE, BUCKET_BYTES, ENTRIES, PACK_BYTES, Packs, alive_set, among, gathered, narrow, survivors, widen
from loomap.llm._spark import blob, joined, parts_for, release, split_by, written
from loomap.llm._text import U64, Poly, covered, mix, pieces, spread, winnow

SPAN = 50
GRAM = 20
#: Never a byte of UTF-8: stands between fragments.
STOP = 0xFF
FRAGMENTS = "bucket int, pack int, anchors binary, high binary, low binary, docs binary, several binary, sizes binary, places binary, bytes binary"
FRAGMENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("pack", pa.int32()), *[(k, pa.binary()) for k in ("anchors", "high", "low", "docs", "several", "sizes", "places", "bytes")]])
ANSWERS = "pack int, fragments binary, firsts binary, in_fragments binary, places binary, earlier binary"
ANSWER_SCHEMA = pa.schema([("pack", pa.int32()), *[(k, pa.binary()) for k in ("fragments", "firsts", "in_fragments", "places", "earlier")]])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of t by their first ``depth`` bytes (ties in any order), by two-stage sorting."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    # a suffix is smaller than its successor if the first byte after its run of equal bytes is greater; the end counts as least
    change = np.flatnonzero(t[1:] != t[:-1])
    run_end = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    after = np.append(t, 0)[run_end + 1].astype(np.int16)
    after[run_end == n - 1] = -1
    smaller = after > t
    direct = np.flatnonzero(smaller)
    direct = direct[_by_words(_words(t, depth), direct, depth)]
    b_part = dict(split_by(t[direct]))
    a_part: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not smaller[n - 1]:
        a_part[t[n - 1]].append(np.array([n - 1]))  # the last suffix is the least of its bucket
    out = []
    for c in range(256):
        whole = []
        newest = np.concatenate(a_part[c]) if a_part[c] else np.zeros(0, np.int64)
        while len(newest):
            whole.append(newest)
            before = newest[newest > 0] - 1
            newest = before[t[before] == c]
        if c in b_part:
            whole.append(direct[b_part[c]])
        if not whole:
            continue
        bucket = np.concatenate(whole)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        for b, at in split_by(t[before]):
            a_part[b].append(before[at])
    return np.concatenate(out)


def _words(t: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros after the end)."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t), U64)
    for k in range(8):
        out = (out << U64(8)) | padded[k : k + len(t)].astype(U64)
    return np.concatenate([out, np.zeros(depth + 8, U64)])


def _by_words(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Order of the places by their first bytes: a word at a time, looking again only at ties."""
    order = np.argsort(words[at], kind="stable")
    x = words[at[order]]
    tied = np.concatenate([[False], x[1:] == x[:-1]]) if len(x) else np.zeros(0, bool)
    for k in range(8, depth, 8):
        group = np.cumsum(~tied)
        some = tied.copy()
        some[:-1] |= tied[1:]
        where = np.flatnonzero(some)
        if not len(where):
            break
        x = words[at[order[where]] + k]
        again = np.lexsort((x, group[where]))
        order[where] = order[where][again]
        x, g = x[again], group[where][again]
        tied[where[1:]] = (x[1:] == x[:-1]) & (g[1:] == g[:-1]) & (where[1:] == where[:-1] + 1)
    return order


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, counted up to ``most`` bytes."""
    words = _words(t, most)
    out, open_ = np.zeros(len(sa), np.int64), np.arange(1, len(sa))
    for k in range(0, most, 8):
        x = words[sa[open_] + k] ^ words[sa[open_ - 1] + k]
        if k + 8 > most:
            x &= ~U64((1 << 8 * (k + 8 - most)) - 1)
        same = x == 0
        out[open_[same]] = min(k + 8, most)
        rest = open_[~same]
        lead = np.zeros(len(rest), np.int64)
        for b in range(1, 8):
            lead += x[~same] >> U64(64 - 8 * b) == 0
        out[rest] = k + lead
        open_ = open_[same]
    return out


class Anchors:
    """Anchors of a piece of text and the fragments around them."""

    def __init__(self, piece: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
        self.data, self.offsets, self.span, self.reach = data, offsets, span, span - gram + 1
        self.poly = Poly(21), Poly(22)
        ids = piece.column(piece.schema.get_field_index("doc_id"))
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.prefix = self.poly[0].prefix(self.poly[0].table[data])
        h = np.zeros(0, U64)
        if len(data) >= gram:
            h = (self.prefix[gram:] - self.prefix[:-gram]) * self.poly[0].down[: len(data) - gram + 1]
            h ^= h >> U64(32)
            h *= U64(0xD6E8FEB86659FD93)
        order = (h >> U64(32)).astype(np.uint32) | np.uint32(1)
        order[self._last(gram - 1, len(h))] = ~np.uint32(0)
        inside = np.ones(len(data), bool)
        inside[self._last(span - 1, len(data))] = False
        self.at = winnow(order, inside, self.reach)
        self.doc = np.searchsorted(offsets, self.at, "right") - 1
        ok = self.known[self.doc]
        self.at, self.doc = self.at[ok], self.doc[ok]
        self.hash, self.order = h[self.at], order[self.at]
        self.hash ^= self.hash >> U64(32)
        self.some = np.arange(len(self.at))

    def _last(self, n: int, most: int) -> np.ndarray:
        """The last n places of every text."""
        count = np.minimum(np.diff(self.offsets), n)
        at = spread(self.offsets[1:] - count, count)
        return at[at < most]

    def keep(self, mask: np.ndarray) -> None:
        """Looks at some of the anchors only."""
        self.some = self.some[mask]

    def cut(self) -> None:
        """start and end of the fragments: from the first string whose leftmost least gram is the anchor to the end of the last."""
        at, order, doc, i = self.at, self.order, self.doc, self.some
        lo = np.maximum(self.offsets[doc[i]], at[i] - self.reach + 1)
        hi = np.minimum(at[i], self.offsets[doc[i] + 1] - self.span)
        for step, limit in ((-1, lo), (1, hi)):
            open_, k = np.arange(len(i)), step
            while len(open_):
                other = i[open_] + k
                near = (other >= 0) & (other < len(at))
                open_, other = open_[near], other[near]
                near = (doc[other] == doc[i[open_]]) & (np.abs(at[other] - at[i[open_]]) < self.reach)
                open_, other = open_[near], other[near]
                less = order[other] <= order[i[open_]] if step < 0 else order[other] < order[i[open_]]
                stop = open_[less]
                limit[stop] = np.maximum(limit[stop], at[other[less]] + 1) if step < 0 else np.minimum(limit[stop], at[other[less]] - self.reach)
                open_, k = open_[~less], k + step
        full = hi >= lo
        self.some, self.start, self.end = i[full], lo[full], hi[full] + self.span

    def high(self) -> np.ndarray:
        x = (self.prefix[self.end] - self.prefix[self.start]) * self.poly[0].down[self.start] + (self.end - self.start).astype(U64)
        x ^= x >> U64(32)
        x *= U64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> U64(29))

    def low(self) -> np.ndarray:
        return self.poly[1].of_slices(self.data, self.start, self.end).astype(np.uint32)


#: Smaller pieces than elsewhere: there are eight bytes of hashes for each byte of text.
PIECE = 1 << 19


def _by_piece(group: pa.Table, span: int, gram: int) -> Iterator[tuple[pa.RecordBatch, Anchors]]:
    for batch in group.to_batches():
        for piece, data, offsets in pieces(batch, "text", PIECE):
            yield piece, Anchors(piece, data, offsets, span, gram)


def _propose(span: int, gram: int, n_buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for piece, data, offsets in pieces(batch, "text", PIECE):
                a = Anchors(piece, data, offsets, span, gram)
                packs = piece.column(piece.schema.get_field_index("pack")).to_numpy(zero_copy_only=False)
                yield a.hash, a.ids[a.doc], packs[a.doc]

    yield from gathered(found(), n_buckets)


def _merged(high: np.ndarray, low: np.ndarray, ids: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct fragment, that of its least document, and whether several documents have it."""
    order = np.lexsort((ids, low, high))
    h, s, d = high[order], low[order], ids[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])[: len(h)])
    last = np.append(new[1:], len(h))[: len(new)] - 1
    return order[new], ((d[new] != d[last]) | (np.maximum.reduceat(several[order], new) > 0 if len(new) else False)).astype(np.uint8)


def _fragments(span: int, gram: int, n_buckets: int, texts: pa.Table, alive: pa.Table) -> pa.Table:
    """The distinct fragments of a pack around anchors that several documents have."""
    found, parts = alive_set(alive), []
    for _, a in _by_piece(texts, span, gram) if len(found) else ():
        a.keep(among(a.hash, found))
        a.cut()
        high, low, ids = a.high(), a.low(), a.ids[a.doc[a.some]]
        one, several = _merged(high, low, ids, np.zeros(len(ids), np.uint8))
        some, start, size = a.some[one], a.start[one], (a.end - a.start)[one]
        parts.append((high[one], low[one], ids[one], several, a.hash[some], size, a.at[some] - start, a.data[spread(start, size)]))
    if not parts:
        return pa.Table.from_pylist([], schema=FRAGMENT_SCHEMA)
    high, low, ids, several, anchor, size, place, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    start = np.cumsum(size) - size
    one, several = _merged(high, low, ids, several)
    rows, kind = [], np.uint8 if span < 128 else np.uint16
    for b, at in split_by((anchor[one] % U64(n_buckets)).astype(np.int64)):
        i = one[at]
        rows.append({"bucket": b, "pack": texts["pack"][0].as_py(), "anchors": narrow(anchor[i]), "high": blob(high[i]), "low": blob(low[i]), "docs": blob(ids[i].astype(np.int64)), "several": blob(several[at]), "sizes": blob(size[i].astype(kind)), "places": blob(place[i].astype(kind)), "bytes": blob(data[spread(start[i], size[i])])})
    return pa.Table.from_pylist(rows, schema=FRAGMENT_SCHEMA)


def _answers(span: int, gram: int, group: pa.Table) -> pa.Table:
    """First documents of a bucket's fragments and of the strings in them."""
    release()
    high, count = joined(group["high"], U64)
    pack = np.repeat(group["pack"].to_numpy(), count)
    anchor, low = widen(joined(group["anchors"], np.uint8)[0]), joined(group["low"], np.uint32)[0]
    doc, several = joined(group["docs"], np.int64)[0], joined(group["several"], np.uint8)[0]
    size, data = joined(group["sizes"], np.uint8 if span < 128 else np.uint16)[0].astype(np.int64), joined(group["bytes"], np.uint8)[0]
    place = joined(group["places"], np.uint8 if span < 128 else np.uint16)[0].astype(np.int64)
    start = np.cumsum(size) - size
    order = np.lexsort((doc, low, high))
    new = np.flatnonzero(np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])[: len(order)])
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))  # the distinct fragment of each entry, in that order
    one = order[new]
    # one entry of each fragment stands for all of them; a string's first document is the least of all fragments that hold the string
    first = doc[one]
    look = (np.bincount(of, minlength=len(new)) > 1) | (np.bincount(of, several[order], len(new)) > 0)
    # A string is in two fragments only if one of its halves is: fragments none of whose halves is shared are out.
    look[_alike((span - gram) // 2, gram, anchor[one], start[one], size[one], place[one], data)] = True
    many = np.flatnonzero(look)
    rows: dict[int, dict] = {}

    def answer(packs, **values):
        for p, at in split_by(packs):
            rows.setdefault(p, {"pack": p}).update({k: blob(v[at]) for k, v in values.items()})

    if len(many):
        i = one[many]
        width = size[i] + 1
        t = np.full(int(width.sum()), STOP, np.uint8)
        base = np.cumsum(width) - width
        t[spread(base, size[i])] = data[spread(start[i], size[i])]
        owner = np.repeat(np.arange(len(i)), width)
        whole = base[owner] + size[i][owner] - np.arange(len(t)) >= span  # a string of the span starts here
        sa = suffix_array(t, span)
        sa = sa[whole[sa]]
        run = np.cumsum(common_prefixes(t, sa, span) < span)
        cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        least = np.repeat(np.minimum.reduceat(first[many][owner[sa]], cut), np.diff(np.append(cut, len(sa))))
        # all strings of a fragment are in documents up to the latest of these: what comes after loses the whole fragment
        latest = np.full(len(new), np.iinfo(np.int64).min)
        np.maximum.at(latest, many[owner[sa]], least)
        told = look[of] & ((doc[order] > latest[of]) | (several[order] > 0))
        answer(pack[order][told], fragments=high[order][told], firsts=latest[of][told])
        early = least < latest[many[owner[sa]]]
        sa, least = sa[early], least[early]
        j = one[many[owner[sa]]]
        answer(pack[j], in_fragments=high[j], places=(sa - base[owner[sa]]).astype(np.int32), earlier=least)
    return pa.Table.from_pylist(list(rows.values()), schema=ANSWER_SCHEMA)


def _alike(half: int, gram: int, anchor: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The fragments that can share a string with another one of the same anchor.

    A string holds at least ``half`` bytes before its anchor or as many after it, so one of these must
    be found in another fragment too.
    """
    poly = Poly(23)
    prefix = poly.prefix(poly.table[data])
    out = np.zeros(len(anchor), bool)
    for begin, fits in ((start + place - half, place >= half), (start + place + gram, size - place - gram >= half)):
        some = np.flatnonzero(fits)
        x = mix((prefix[begin[some] + half] - prefix[begin[some]]) * poly.down[begin[some]] + anchor[some])
        _, which, n = np.unique(x, return_inverse=True, return_counts=True)
        out[some[n[which] > 1]] = True
    return np.flatnonzero(out)


def _remove(span: int, gram: int, texts: pa.Table, answers: pa.Table) -> pa.Table:
    fragments, firsts = joined(answers["fragments"], U64)[0], joined(answers["firsts"], np.int64)[0]
    order = np.lexsort((firsts, fragments))
    fragments, firsts = fragments[order], firsts[order]
    inside, places, earlier = joined(answers["in_fragments"], U64)[0], joined(answers["places"], np.int32)[0].astype(np.int64), joined(answers["earlier"], np.int64)[0]
    order = np.argsort(inside, kind="stable")
    inside, places, earlier = inside[order], places[order], earlier[order]
    out = []
    for piece, a in _by_piece(texts, span, gram):
        a.cut()
        h, ids = a.high(), a.ids[a.doc[a.some]]
        gone = np.zeros(len(h), bool)
        if len(fragments):
            at = np.minimum(np.searchsorted(fragments, h), len(fragments) - 1)
            gone = (fragments[at] == h) & (firsts[at] < ids)
        lo, hi = np.searchsorted(inside, h, "left"), np.searchsorted(inside, h, "right")
        row = spread(lo, hi - lo)
        by = np.repeat(np.arange(len(h)), hi - lo)
        hit = earlier[row] < ids[by]
        starts = np.concatenate([a.start[gone], (a.start[by] + places[row])[hit]])
        width = np.concatenate([(a.end - a.start)[gone], np.full(int(hit.sum()), span)])
        removed = covered(starts, width, len(a.data))
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        edge = a.offsets[:-1][np.diff(a.offsets) > 0]
        begins[edge] = removed[edge]
        n_removed, n_spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[a.offsets]) for x in (removed, begins))
        kept = a.data[~removed].tobytes() if removed.any() else a.data.tobytes()
        ends = a.offsets - np.concatenate([[0], np.cumsum(removed)])[a.offsets]
        digest = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        out.append(pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("doc_id")), pa.array(np.diff(a.offsets)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(digest)], schema=RESULT_SCHEMA))
    return pa.Table.from_batches(out, RESULT_SCHEMA)


def dedup_bytes(docs: DataFrame, span: int = SPAN, gram: int = GRAM, pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES // 2) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    packs = Packs(docs, pack_bytes)
    n_buckets = parts_for(packs.n_bytes, bucket_bytes)
    alive = written(packs.texts.mapInArrow(functools.partial(_propose, span, gram, n_buckets), ENTRIES).groupBy("bucket").applyInArrow(survivors, ALIVE))
    fragments = packs.told(alive).applyInArrow(functools.partial(_fragments, span, gram, n_buckets), FRAGMENTS)
    answers = written(fragments.groupBy("bucket").applyInArrow(lambda group: _answers(span, gram, group), ANSWERS))
    return packs.told(answers).applyInArrow(functools.partial(_remove, span, gram), RESULT)
