"""N-gram Jaccard self-join by universe partition.

A document's set holds the hashes of its distinct SHINGLE-word shingles.  Two sets of at least PERCENT %
similarity, the larger of n tokens, differ in at most 2 * n * (100 - PERCENT) / (100 + PERCENT) tokens.  Sizes
are cut into bands whose ends grow by 100 / PERCENT, so such a pair lies in one band or in two
neighbours; an instance joins a band with itself and with the band below.

In an instance the universe of tokens is cut into segments by hash.  With more segments than
differences some segment is equal in both sets, so sets that share a segment's hash are candidates.
A segment may also be allowed one difference (weight 2 instead of 1); then all its one-deletion
neighbours are indexed too.  The allocation of segments and deletions is the one of least expected cost
(signatures a set of the band makes) whose expected weight of non-empty segments exceeds the differences
with a wide margin; empty segments count nothing.

Every set is indexed with all segments of its two instances; it probes in its own band's.  The larger of two
similar sets must probe with as much weight as its own bound asks, so it may do without the rest, its slack.
Once the groups of equal signatures are known, each set drops the largest groups its slack allows
(what a common passage makes); groups that nobody probes are gone.  A set with too little weight for its bound
(by bad luck of the hash) sends the instance into another round with twice the segments, until there
is none: the join is exact.

Sets that are equal are one entity; entities are compared once.  In a group all are compared with the member
that meets most others in all groups, so a group of near copies costs its size, not its square; then those pairs that are still in
different components.  Most of these are ruled out by parities, inside the buckets: each set keeps some bits a token,
and sets differ in at least as many tokens as in bits.  Candidates are verified on their whole sets.

Exchanges: an entry is 11 bytes whatever the number of buckets (five of the signature, five of the entity's name, one of
weight, slack and whether it probes).  Signatures and names propose only; what they name wrongly is verified and not linked.
Tokens are 64-bit hashes of shingles and entities 64-bit hashes of sets; verification uses 48 bits of a token, so a
count could be off by one with odds of about size**2 / 2**48.

Defined results: null or empty text has an empty set and stays alone; a null doc_id takes part, but
is nobody's component_id unless its component has no other id (then null).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomap.llm._repeats import narrow, widen
from loomap.llm._spark import blob, col, discard, joined, parts_for, release, split_by, text_bytes, written
from loomap.llm._text import LOWER, U64, Poly, find_words, left_in_document, mix, pieces, spread
from loomap.operators.graph import components

SHINGLE = 5
PERCENT = 75
BUCKET_BYTES = 12 << 20
MARGIN = 6.0
#: Bytes of a signature and of an entity's name in an entry.
SHORT = 5
#: Entries that a task gathers before it sends the buckets theirs.
HELD = 1_000_000
#: What entities are dealt to besides buckets: parts, at least so many.
LEAST_PARTS = 64
#: Parities that a set keeps for each token, at least.
BITS = 2
#: Ids that are broadcast at most to find the texts of the entities in groups; beyond it, a shuffled join.
BROADCAST_IDS = 500_000
SETS = "doc_id long, row_key long, n_shingles long, entity long"
SETS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("entity", pa.int64())])
TOKENS = "e long, n int, sketch binary, tokens binary"
CELLS = ("names", "signatures", "flags")
ENTRIES = "bucket int, names binary, signatures binary, flags binary, hard array<int>"
ENTRY_SCHEMA = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in CELLS], ("hard", pa.list_(pa.int32()))])
GROUPS = "bucket int, names binary, flags binary, counts binary, hard array<int>"
GROUP_SCHEMA = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("names", "flags", "counts")], ("hard", pa.list_(pa.int32()))])
APPEALS = "part int, bucket int, names binary, flags binary, counts binary, places binary"
APPEAL_SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in ("names", "flags", "counts", "places")]])
REPLIES = "bucket int, places binary, dropped binary, scores binary"
REPLY_SCHEMA = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("places", "dropped", "scores")]])
PROBED = "bucket int, names binary, probing binary, counts binary"
PROBED_SCHEMA = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("names", "probing", "counts")]])
#: A flag: the place of the slack in this ladder (rounded down), WEIGHT_2 and PROBES.
LADDER = [*range(8)]
while len(LADDER) < 64:
    LADDER.append(max(LADDER[-1] + 1, LADDER[-1] * 5 // 4))
WEIGHT_2, PROBES = 64, 128


class Sets:
    """The distinct shingles of each text of a piece: ``tokens`` sorted within a text, ``doc`` of each, ``size`` of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int):
        data = LOWER[data]
        starts, ends, first = find_words(data, offsets)
        poly = Poly(31)
        h = poly.of_slices(data, starts, ends)
        left, n = left_in_document(first), len(offsets) - 1
        grams = poly.windows(h, shingle)
        at = np.flatnonzero(left[: len(grams)] >= shingle)
        doc_of_word = np.repeat(np.arange(n), np.diff(first))
        tokens, doc = grams[at], doc_of_word[at]
        words = np.diff(first)
        for k in range(1, shingle):  # texts of fewer words: all of them as one
            few = np.flatnonzero(words == k)
            if len(few):
                tokens = np.concatenate([tokens, poly.windows(h, k)[first[:-1][few]]])
                doc = np.concatenate([doc, few])
        order = np.lexsort((tokens, doc))
        tokens, doc = tokens[order], doc[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])])[: len(doc)]
        self.tokens, self.doc = tokens[new], doc[new]
        self.size = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.zeros(n, U64)
        np.add.at(total, self.doc, mix(self.tokens ^ U64(0x5851F42D4C957F2D)))
        self.entity = mix(total + self.size.astype(U64)).view(np.int64)

    def take(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of some texts and which of these each belongs to."""
        n = self.size[docs]
        return self.tokens[spread(self.first[docs], n)], np.repeat(np.arange(len(docs)), n)


@functools.cache
def band_ends(most: int = 1 << 40, percent: int = PERCENT) -> tuple[int, ...]:
    """Greatest sizes of the bands: with size n, sizes up to n * 100 / percent lie in its band or the next."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, (out[-1] + 1) * 100 // percent))
    return tuple(out)


def bound(size, percent: int = PERCENT):
    """Most differences of a set with a similar one that isn't larger."""
    return 2 * size * (100 - percent) // (100 + percent)


@functools.cache
def allocation(size: int, percent: int = PERCENT, margin: float = MARGIN) -> tuple[int, int]:
    """(segments, how many of them allow a difference) of an instance whose largest sets have ``size`` tokens."""
    need = int(bound(size, percent)) + 1
    best = None
    for m in range(1, 3 * need + 8):
        full, two = 1 - (1 - 1 / m) ** size, 1 - (1 - 1 / m) ** size - size / m * (1 - 1 / m) ** (size - 1)
        for j in {0, m, *([need - m] if 0 < need - m < m else [])}:
            weight = m * full + j * two
            spare = margin * math.sqrt(m * full * (1 - full) + j * two * (1 - two)) if size > 3 else 0
            cost = m + j * size / m
            if weight - spare >= need and (best is None or cost < best[0]):
                best = (cost, m, j)
    return best[1:] if best else (4 * need, 4 * need)


def signatures_of(sets: Sets, docs: np.ndarray, only: dict[int, int] | None, percent: int, margin: float = MARGIN):
    """Entries of some texts: signature, index into docs, flag; and the instances in which some set has too little weight.

    ``only``: the instances to do, each with how many times its segments are doubled (None: all, 0 times).
    """
    size, ends = sets.size[docs], np.array(band_ends(percent=percent))
    band = np.searchsorted(ends, size)
    out, hard = [], set()
    for up in (0, 1):
        instance = band + up
        some = np.flatnonzero(np.isin(instance, list(only)) if only is not None else np.ones(len(docs), bool))
        if not len(some):
            continue
        k, n = instance[some], size[some]
        kinds, kind = np.unique(k, return_inverse=True)
        plans = np.array([allocation(int(ends[x]), percent, margin) for x in kinds]) * np.array([1 << only[x] if only else 1 for x in kinds.tolist()])[:, None]
        m, j = plans[kind, 0], plans[kind, 1]
        token, of = sets.take(docs[some])
        base = np.cumsum(m) - m
        mixed = mix(token + k[of].astype(U64) * U64(0x9E3779B97F4A7C15))
        seg = base[of] + (mixed % m[of].astype(U64)).astype(np.int64)
        content = np.zeros(int(m.sum()), U64)
        value = mix(token ^ U64(0xA0761D6478BD642F))
        np.add.at(content, seg, value)
        count = np.bincount(seg, minlength=len(content))
        owner = np.repeat(np.arange(len(some)), m)
        index = np.arange(len(content)) - base[owner]
        soft = index < j[owner]
        weight = (count >= 1).astype(np.int64) + (soft & (count >= 2))
        flag = np.where(weight == 2, WEIGHT_2, 0)
        if up == 0:
            slack = np.bincount(owner, weight, len(some)).astype(np.int64) - bound(n, percent) - 1
            hard |= set(k[slack < 0].tolist())
            flag = (flag + PROBES + np.searchsorted(LADDER, np.maximum(slack, 0), "right")[owner] - 1).astype(np.uint8)
        tag = (k[owner].astype(U64) << U64(32)) + index.astype(U64)
        full = count > 0
        out.append((mix(content + tag * U64(0x2545F4914F6CDD1D))[full], some[owner[full]], flag[full].astype(np.uint8)))
        lone = np.flatnonzero(soft[seg] & (count[seg] >= 2))
        if len(lone):
            s = seg[lone]
            out.append((mix(content[s] - value[lone] + tag[s] * U64(0x2545F4914F6CDD1D)), some[owner[s]], flag[s].astype(np.uint8)))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint8), hard
    return *(np.concatenate(x) for x in zip(*out, strict=True)), hard


# --- the groups of equal signatures


def _sets(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            s = Sets(data, offsets, shingle)
            keep = [piece.column(piece.schema.get_field_index(k)) for k in ("doc_id", "row_key")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(s.size), pa.array(s.entity)], schema=SETS_SCHEMA)


def name_of(entity: np.ndarray) -> np.ndarray:
    """The part of an entity's hash that entries carry, as a number."""
    return entity.view(U64) >> U64(64 - 8 * SHORT)


def _entries(shingle: int, percent: int, margin: float, n_buckets: int, turn: int, only: dict | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, hard = [], 0, set()

    def flush() -> pa.RecordBatch:
        h, entity, flag = (np.concatenate(x) for x in zip(*held, strict=True))
        name, signature = entity >> U64(64 - 8 * SHORT), h >> U64(64 - 8 * SHORT)
        order = np.argsort(h)
        name, signature, flag, h = name[order], signature[order], flag[order], h[order]
        rows = [
            {"bucket": turn * n_buckets + b, "names": narrow(name[at], SHORT, 0), "signatures": narrow(signature[at], SHORT, 0), "flags": blob(flag[at]), "hard": sorted(hard)}
            for b, at in split_by((h % U64(n_buckets)).astype(np.int64))
        ]
        return pa.RecordBatch.from_pylist(rows, schema=ENTRY_SCHEMA)

    for batch in batches:
        for _, data, offsets in pieces(batch, "text"):
            s = Sets(data, offsets, shingle)
            _, docs = np.unique(s.entity, return_index=True)
            docs = docs[s.size[docs] > 0]
            h, which, flag, more = signatures_of(s, docs, only, percent, margin)
            held.append((h, s.entity[docs[which]].view(U64), flag))
            size, hard = size + len(h), hard | more
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _group(group: pa.Table) -> pa.Table:
    """The groups of a bucket's equal signatures that have several entities, one of them probing."""
    release()
    sig, name = (widen(joined(group[k], np.uint8)[0], SHORT) for k in ("signatures", "names"))
    flag = joined(group["flags"], np.uint8)[0]
    order = np.lexsort((255 - flag, name, sig))
    sig, name, flag = sig[order], name[order], flag[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])])[: len(sig)]  # an entity's probing entry comes first
    sig, name, flag = sig[new], name[new], flag[new]
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
    count = np.diff(np.append(head, len(sig)))
    good = (count > 1) & (np.maximum.reduceat(flag, head) >= PROBES) if len(head) else count > 1
    keep = np.repeat(good, count)
    hard = sorted({x for row in group["hard"].to_pylist() for x in row})
    return pa.Table.from_pylist([{"bucket": group["bucket"][0].as_py(), "names": narrow(name[keep], SHORT, 0), "flags": blob(flag[keep]), "counts": blob(count[good].astype(np.uint32)), "hard": hard}], schema=GROUP_SCHEMA)


def _appeals(n_parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the entities are told of the groups they are in: how large each is."""
    for batch in batches:
        for row in batch.to_pylist():
            name, flag = widen(np.frombuffer(row["names"], np.uint8), SHORT), np.frombuffer(row["flags"], np.uint8)
            count = np.frombuffer(row["counts"], np.uint32)
            count = np.repeat(count, count)
            rows = [
                {"part": p, "bucket": row["bucket"], "names": narrow(name[at], SHORT, 0), "flags": blob(flag[at]), "counts": blob(count[at]), "places": blob(at.astype(np.uint32))}
                for p, at in split_by((name % U64(n_parts)).astype(np.int64))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=APPEAL_SCHEMA)


def _replies(group: pa.Table) -> pa.Table:
    """Which groups each entity doesn't probe, as far as its slack goes, the largest first; and how many others it meets in the rest."""
    release()
    name, flag = widen(joined(group["names"], np.uint8)[0], SHORT), joined(group["flags"], np.uint8)[0]
    (count, per_row), place = joined(group["counts"], np.uint32), joined(group["places"], np.uint32)[0]
    bucket = np.repeat(group["bucket"].to_numpy(), per_row)
    probing, code = flag >= PROBES, flag & np.uint8(63)
    order = np.lexsort((place, bucket, -count.astype(np.int64), code, name, ~probing))
    n = int(probing.sum())  # probing entries come first; those of one round and entity stand together
    some = order[:n]
    new = np.concatenate([[True], (name[some][1:] != name[some][:-1]) | (code[some][1:] != code[some][:-1])])[:n]
    upto = np.cumsum(1 + ((flag[some] & WEIGHT_2) > 0))
    before = np.concatenate([[0], upto])[np.flatnonzero(new)][np.cumsum(new) - 1] if n else upto
    dropped = np.zeros(len(name), bool)
    dropped[some] = upto - before <= np.array(LADDER)[code[some]]
    _, who = np.unique(name, return_inverse=True)
    score = np.bincount(who, np.where(dropped, 0, count))[who].astype(np.float32) if len(who) else np.zeros(0, np.float32)
    return pa.Table.from_pylist([{"bucket": b, "places": blob(place[at]), "dropped": blob(dropped[at]), "scores": blob(score[at])} for b, at in split_by(bucket)], schema=REPLY_SCHEMA)


def _probed(groups: pa.Table, replies: pa.Table) -> pa.Table:
    """The groups that are still probed, each with the member that meets most others first."""
    release()
    out = []
    for row in groups.to_pylist():
        name, flag = widen(np.frombuffer(row["names"], np.uint8), SHORT), np.frombuffer(row["flags"], np.uint8)
        count = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        place = joined(replies["places"], np.uint32)[0]
        probing, score = flag >= PROBES, np.zeros(len(name), np.float32)
        probing[place] &= ~joined(replies["dropped"], bool)[0]
        score[place] = joined(replies["scores"], np.float32)[0]
        group = np.repeat(np.arange(len(count)), count)
        good = np.bincount(group, probing, len(count)) > 0
        order = np.lexsort((name, -score, group))
        order = order[good[group[order]]]
        out.append({"bucket": row["bucket"], "names": narrow(name[order], SHORT, 0), "probing": blob(probing[order]), "counts": blob(count[good].astype(np.uint32))})
    return pa.Table.from_pylist(out, schema=PROBED_SCHEMA)


# --- the pairs


def _unpack(row: dict):
    """names of the members, which of them probe, and the groups' counts."""
    return widen(np.frombuffer(row["names"], np.uint8), SHORT).view(np.int64), np.frombuffer(row["probing"], bool), np.frombuffer(row["counts"], np.uint32).astype(np.int64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's first member with the others."""
    for batch in batches:
        for row in batch.to_pylist():
            name, _, count = _unpack(row)
            centre = np.repeat(name[np.cumsum(count) - count], count)
            yield _edges(centre[centre != name], name[centre != name])


MEMBERS = "part int, bucket int, names binary"
MEMBER_SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary())])


def _members(n_parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each bucket's groups, in one row for each part of the entities."""
    for batch in batches:
        for row in batch.to_pylist():
            used = np.unique(_unpack(row)[0])
            rows = [{"part": p, "bucket": row["bucket"], "names": blob(used[at])} for p, at in split_by(used % n_parts)]
            yield pa.RecordBatch.from_pylist(rows, schema=MEMBER_SCHEMA)


def _distinct(group: pa.Table) -> pa.Table:
    return pa.table({"name": np.unique(joined(group["names"], np.int64)[0])})


INFO = "bucket int, names binary, entities binary, roots binary, sizes binary, lengths binary, sketches binary"
INFO_SCHEMA = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("names", "entities", "roots", "sizes", "lengths", "sketches")]])


def _info(members: pa.Table, labels: pa.Table) -> pa.Table:
    """What each bucket is told of a part of the entities: component so far, size and parities; in one row."""
    release()
    name = labels["name"].to_numpy()
    order = np.argsort(name, kind="stable")
    name, (entity, root, size) = name[order], (labels[k].to_numpy()[order] for k in ("e", "root", "n"))
    sketch = labels["sketch"].to_pylist()
    rows = []
    for bucket, cell in zip(members["bucket"].to_pylist(), members["names"].to_pylist(), strict=True):
        asked = np.frombuffer(cell, np.int64)
        lo, hi = np.searchsorted(name, asked, "left"), np.searchsorted(name, asked, "right")
        at = spread(lo, hi - lo)  # of two entities with one name, both
        cells = [sketch[k] for k in order[at].tolist()]
        rows.append({"bucket": bucket, "names": blob(name[at]), "entities": blob(entity[at]), "roots": blob(root[at]), "sizes": blob(size[at].astype(np.int64)), "lengths": blob(np.array(list(map(len, cells)), np.int64)), "sketches": b"".join(cells)})
    return pa.Table.from_pylist(rows, schema=INFO_SCHEMA)


PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rest(percent: int, groups: pa.Table, info: pa.Table) -> pa.Table:
    """The pairs of a bucket's groups still to be compared: in different components so far, and not ruled out by their parities."""
    release()
    name, entity, root, size, length = (joined(info[k], np.int64)[0] for k in ("names", "entities", "roots", "sizes", "lengths"))
    ends = np.cumsum(length)
    raw = joined(info["sketches"], np.uint8)[0]
    order = np.argsort(name, kind="stable")
    sketch = [raw[ends[k] - length[k] : ends[k]].tobytes() for k in order.tolist()]
    name, entity, root, size = name[order], entity[order], root[order], size[order]
    out = []
    for row in groups.to_pylist():
        who, probing, count = _unpack(row)
        lo, hi = np.searchsorted(name, who, "left"), np.searchsorted(name, who, "right")
        at, probing, group = spread(lo, hi - lo), np.repeat(probing, hi - lo), np.repeat(np.repeat(np.arange(len(count)), count), hi - lo)
        first = np.searchsorted(group, np.arange(len(count) + 1))
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            mine = at[x:y]
            if x == y or (root[mine] == root[mine[0]]).all():
                continue
            found = _apart(percent, root[mine], probing[x:y], size[mine], [sketch[k] for k in mine.tolist()])
            if len(found):
                out.append(_edges(entity[mine[found[:, 0]]], entity[mine[found[:, 1]]]))
    table = pa.Table.from_batches(out, PAIR_SCHEMA)
    return table.group_by(["a", "b"]).aggregate([]) if len(table) else table


def _apart(percent: int, root: np.ndarray, probing: np.ndarray, size: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Pairs of a group's members with different roots that may be similar; in blocks, so memory doesn't follow the group's square."""
    short = min(map(len, sketches))
    bits = np.stack([_folded(x, short) for x in sketches])
    n, found = len(root), []
    step = max(1, (1 << 18) // n)
    for i in range(0, n, step):
        j = np.arange(i, n)
        some = (root[i : i + step, None] != root[None, j]) & (probing[i : i + step, None] | probing[None, j]) & _close(size[i : i + step, None], size[None, j], percent)
        x, y = np.nonzero(some)
        x, y = x + i, j[y]
        x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 1 << 16):
            u, v = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            apart = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64)
            may = apart * (100 + percent) <= (size[u] + size[v]) * (100 - percent)
            found.append(np.stack([u[may], v[may]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _folded(sketch: bytes, n: int) -> np.ndarray:
    """A sketch of n bytes: parities of parities."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > n:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _tokens(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            s = Sets(data, offsets, shingle)
            short = np.sort(((s.doc.astype(U64) << U64(48)) | (s.tokens >> U64(16))))
            six = np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            # parities: bit (token mod bits) is set if an odd number of tokens falls on it
            bits = np.maximum(64, BITS << np.ceil(np.log2(np.maximum(s.size, 1))).astype(np.int64))
            base = np.cumsum(bits) - bits
            odd = np.bincount(base[s.doc] + (s.tokens >> U64(8)).astype(np.int64) % bits[s.doc], minlength=int(bits.sum())).astype(np.uint8) & 1
            packed = np.packbits(odd, bitorder="little")
            sketches = [packed[a : a + n].tobytes() for a, n in zip((base // 8).tolist(), (bits // 8).tolist(), strict=True)]
            cells = [six[a:b].tobytes() for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.entity), pa.array(s.size.astype(np.int32)), pa.array(sketches, pa.binary()), pa.array(cells, pa.binary())], names=["e", "n", "sketch", "tokens"])


def _verify(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets are similar enough."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sides = []
            for k in ("tokens_a", "tokens_b"):
                raw, n = joined(pa.chunked_array([part.column(part.schema.get_field_index(k))]), np.uint8)
                sides.append((widen(raw) | (np.repeat(np.arange(part.num_rows), n // 6).astype(U64) << U64(48)), n // 6))
            (x, nx), (y, ny) = sides
            hit = x[np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))] == y if len(x) and len(y) else np.zeros(len(y), bool)
            both = np.bincount((y[hit] >> U64(48)).astype(np.int64), minlength=part.num_rows)
            ok = 100 * both >= percent * (nx + ny - both)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _possible(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose parities don't differ in more places than similar sets may in tokens."""
    for batch in batches:
        ok = []
        for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            if not _close(na, nb, percent):
                ok.append(False)
                continue
            short, long = sorted((x, y), key=len)
            at, size = int.from_bytes(long, "little"), len(long) * 8
            while size > len(short) * 8:
                size //= 2
                at = (at >> size) ^ (at & ((1 << size) - 1))
            ok.append((at ^ int.from_bytes(short, "little")).bit_count() * (100 + percent) <= (na + nb) * (100 - percent))
        a, b = (batch.column(batch.schema.get_field_index(k)) for k in ("e_a", "e_b"))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(edges: DataFrame, tokens: DataFrame, percent: int = PERCENT, ruled_out: bool = False) -> DataFrame:
    """The edges (a, b) that hold on the whole sets, as entities.

    The edges are of entities' names, and most that don't hold are ruled out by the sets' parities; with ``ruled_out`` they are of
    entities, and those are gone already.  A centre with many edges is a skewed join key, which AQE splits.
    """

    def with_both(pairs: DataFrame, key: str, *columns: str) -> DataFrame:
        for side in "ba":
            pairs = pairs.join(tokens.select(F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in "ab"])

    near = edges
    if not ruled_out:
        near = written(with_both(edges, "name", "n", "sketch", "e").mapInArrow(lambda batches: _possible(percent, batches), "a long, b long"))
    return with_both(near, "e", "tokens").mapInArrow(lambda batches: _verify(percent, batches), "a long, b long")


def links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES, margin: float = MARGIN, row_key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sets, links): each document's (doc_id, row_key, n_shingles, entity), and linked entities (a, b) that connect all that are connected.

    Every pair of similar entities is linked or joined by a path of links.
    """
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    texts = docs.select(doc_id, text)
    n_buckets = parts_for(text_bytes(texts), bucket_bytes)
    n_parts = max(LEAST_PARTS, n_buckets)
    keyed = docs.select(doc_id, (F.lit(None) if row_key is None else row_key).cast("long").alias("row_key"), text)
    sets = written(keyed.mapInArrow(lambda batches: _sets(shingle, batches), SETS))
    only, rounds = None, []
    while True:
        found = texts.mapInArrow(functools.partial(_entries, shingle, percent, margin, n_buckets, len(rounds), only), ENTRIES)
        rounds.append(written(found.groupBy("bucket").applyInArrow(_group, GROUPS)))
        hard = [r["k"] for r in rounds[-1].select(F.explode("hard").alias("k")).distinct().collect()]
        if not hard:
            break
        only = {k: len(rounds) for k in hard}
    groups = functools.reduce(DataFrame.unionByName, rounds).drop("hard")
    replies = groups.mapInArrow(functools.partial(_appeals, n_parts), APPEALS).groupBy("part").applyInArrow(_replies, REPLIES)
    probed = written(groups.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(lambda a, b: _probed(a, b), PROBED))
    members = written(probed.mapInArrow(functools.partial(_members, n_parts), MEMBERS))
    # the whole sets of the entities that are in some group, from one document of each
    name = F.shiftrightunsigned("entity", 64 - 8 * SHORT).alias("name")
    in_groups = members.groupBy("part").applyInArrow(lambda group: _distinct(group), "name long")
    chosen = written(sets.where("n_shingles > 0").groupBy("entity").agg(F.min("doc_id").alias("doc_id")).withColumn("name", name).join(in_groups, "name", "left_semi"))
    ids = chosen.select("doc_id").distinct()
    if chosen.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # rows with the same id may have different texts: the entity is checked again
    some = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sized = some.mapInArrow(lambda batches: _tokens(shingle, batches), TOKENS)
    tokens = written(sized.join(chosen.select(F.col("entity").alias("e"), "name"), "e").dropDuplicates(["e"]))
    stars = probed.mapInArrow(_stars, "a long, b long").distinct()
    first = written(verified(stars, tokens, percent))
    # what isn't in one component yet is compared by parities in the buckets; what may be similar is verified
    roots = components(first)
    labels = tokens.join(roots, F.col("e") == F.col("node"), "left").select("e", "name", "n", "sketch", F.coalesce("root", "e").alias("root"), F.pmod("name", F.lit(n_parts)).cast("int").alias("part"))
    info = members.groupBy("part").cogroup(labels.groupBy("part")).applyInArrow(lambda a, b: _info(a, b), INFO)
    rest = probed.groupBy("bucket").cogroup(info.groupBy("bucket")).applyInArrow(functools.partial(_rest, percent), "a long, b long")
    second = written(verified(rest.distinct(), tokens, percent, ruled_out=True))
    found = written(first.unionByName(second))
    discard(*rounds, probed, members, chosen, tokens, first, second)
    return sets, found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES, margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    sets, found = links(docs, shingle, percent, bucket_bytes, margin)
    roots = components(found)
    labelled = sets.join(roots, F.col("entity") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "entity"))
    least = labelled.where("n_shingles > 0").groupBy("_root").agg(F.min("doc_id").alias("component_id"))
    full = labelled.where("n_shingles > 0").join(least, "_root").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _hashable(field: T.StructField) -> Column:
    """A column as what can be hashed: maps can't, so one is its sorted entries, and what holds maps its JSON."""
    if "map<" not in field.dataType.simpleString():
        return col(field.name)
    if isinstance(field.dataType, T.MapType) and "map<" not in field.dataType.valueType.simpleString():
        return F.array_sort(F.map_entries(col(field.name)))
    return F.to_json(F.struct(col(field.name).alias("x")))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with the columns of docs: of the least doc_id (nulls last), then entity, then row key.

    Rows are told apart by a hash of all their columns and not by doc_id, so an id may stand for several texts; of rows that are
    equal in all columns one is kept.  Documents with empty sets are in no component and stay, each.
    """
    key = F.xxhash64(*[x for f in docs.schema.fields for x in (_hashable(f), col(f.name).isNull())])  # nulls alone leave a hash as it is
    sets, found = links(docs, shingle, percent, row_key=key)
    root = F.coalesce("root", "entity").alias("_root")
    rows = sets.where("n_shingles > 0").groupBy("doc_id", "entity", "row_key").count().join(components(found), F.col("entity") == F.col("node"), "left").select("doc_id", "entity", "row_key", "count", root)
    rows = written(rows)
    least = rows.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "entity", "row_key")).alias("least")).select(F.col("least.row_key").alias("row_key"), F.lit(True).alias("_kept"))
    rows = written(rows.join(least, "row_key", "left").select(F.col("row_key").alias("_row"), "_kept", "count").where("_kept is null or count > 1"))
    # the rows go along whole in one struct, so no column of docs clashes with a name used here
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_whole"), key.alias("_row"))
    once = keyed.join(rows.select("_row"), "_row", "left_anti")
    repeated = keyed.join(rows.where("_kept").select("_row"), "_row", "left_semi").dropDuplicates(["_row"])
    return once.unionByName(repeated).select("_whole.*")
