"""Language-model scores of documents: a causal self-attention model in numpy over subword ids.

Texts are lower-cased (A-Z) and cut into ids of a public vocabulary, with one end id.  The distribution of the next id has three levels:
a softmax over GROUPS of classes, one over the EACH classes of the group, and an id's share in its class by the class of the id
before.  The OWN most frequent ids are classes of their own, the others share classes by frequency.  Both softmaxes start from the counts of classes after the id before;
one attention layer over the last ids adds to them.  Its inputs, the vectors of the ids, are the principal components of
these counts.  A text is read in windows of WINDOW ids, STEP apart; every id is scored in one window, with
at least WINDOW - STEP ids before it unless the text begins later.  Windows of many texts are scored together, with the
causal mask.

Counts (of ids, of classes after ids, of ids after classes) come from all documents outside the held-out fold, and the layer
is trained on all of their windows: documents are dealt to ROUNDS rounds of shards of SHARD_BYTES of text.  In a round
each shard takes steps from the layer of the round before, over each of its windows once at least; the shards' changes are averaged by their windows.
STEPS is the least number of steps, for which the windows of small inputs are repeated; there is no greatest number.

The base score needs every word's count in all training documents: each pack of texts (see _repeats) sends the buckets of words its distinct words
with their counts, and is told the counts in all packs.  What is sent follows the distinct words of the packs, never the
number of buckets or of documents.

Defined results: null and empty texts are an end alone; repeated rows are scored each (and counted each
in training); a null doc_id is held out.  With no training documents the model is untrained.
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.llm._repeats import Packs
from loomap.llm._spark import blob, joined, parts_for, release, split_by, written
from loomap.llm._text import LOWER, U64, WORD, Poly, find_words, pieces, spread
from loomap.llm._tokens import Encoder
from loomap.llm._vocab import TOKENIZERS

FOLDS, HELD_OUT = 10, 0
WINDOW, STEP = 24, 18
WIDTH, HIDDEN = 12, 24
GROUPS, EACH = 16, 16
CLASSES, OWN = GROUPS * EACH, 224
END = 50256
IDS = END + 1
BATCH, STEPS, ROUNDS = 128, 400, 3
#: Windows that are scored together.
BLOCK = 256
SHARD_BYTES = 32 << 20
#: How many counts weigh as much as the less particular distribution.
TRUST_CLASS, TRUST_PREVIOUS, TRUST_SHARE = 20.0, 4.0, 6.0
SLICES = 64
PACK_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20
SMOOTH = 0.1
IDS_TABLE = "doc_id long, held_out boolean, row_key long, round int, shard int, n_tokens long, ids binary"
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row_key", pa.int64()), ("round", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
SCORES = "doc_id long, held_out boolean, row_key long, n_tokens long, score double"
SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row_key", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
COUNTS = "part int, places binary, counts binary"
COUNT_SCHEMA = pa.schema([("part", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
CHANGES = "part int, weight double, change binary"
CHANGE_SCHEMA = pa.schema([("part", pa.int32()), ("weight", pa.float64()), ("change", pa.binary())])
WORDS = "bucket int, pack int, words binary, counts binary"
WORD_SCHEMA = pa.schema([("bucket", pa.int32()), ("pack", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
TOLD = "pack int, words binary, counts binary, tokens long, distinct long"
TOLD_SCHEMA = pa.schema([("pack", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
BASE = "row_key long, known long, logs double"
BASE_SCHEMA = pa.schema([("row_key", pa.int64()), ("known", pa.int64()), ("logs", pa.float64())])


# --- the model


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``diff(first)`` ids: text, start (in the text), number of ids and first scored place of each window."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STEP))
    text = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return text, start, np.minimum(n[text] - start, WINDOW), np.where(start == 0, 0, WINDOW - STEP)


class Classes:
    """The classes of the ids, by their counts in the training documents."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.group = np.zeros(IDS, np.int32)
        self.group[order] = np.minimum(np.arange(IDS), OWN)
        rest, more = order[OWN:], CLASSES - OWN
        self.group[rest] = OWN + np.minimum(more - 1, np.log2(1 + np.arange(len(rest)) / 24) * more / 8).astype(np.int32)
        self.mass = np.bincount(self.group, counts + SMOOTH, CLASSES)
        self.share = ((counts + SMOOTH) / self.mass[self.group]).astype(np.float32)
        self.known = np.zeros(IDS, np.int32)
        seen = np.flatnonzero(counts)
        self.known[seen] = 1 + np.arange(len(seen))
        self.n = 1 + len(seen)

    def places(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair of ids is counted: among classes after ids, and among ids after classes."""
        return self.known[before].astype(np.int64) * CLASSES + self.group[ids], self.group[before].astype(np.int64) * self.n + self.known[ids]


class Model:
    """Tables made of counts, and an attention layer whose parameters ``p`` are trained."""

    def __init__(self, classes: Classes, after_ids: np.ndarray | None = None, after_classes: np.ndarray | None = None, seed: int = 3):
        """after_ids: counts (known ids, CLASSES) of classes after ids; after_classes: counts (CLASSES, known ids) of ids after classes."""
        c = self.classes = classes
        after_ids = np.zeros((c.n, CLASSES)) if after_ids is None else after_ids
        after_classes = np.zeros((CLASSES, c.n)) if after_classes is None else after_classes
        self.after_classes = after_classes.astype(np.float32)
        group = np.full(c.n, CLASSES - 1)  # of the known ids; one that isn't known counts as rare
        seen = np.flatnonzero(c.known)
        group[c.known[seen]] = c.group[seen]
        both = np.zeros((CLASSES, CLASSES))
        np.add.at(both, group, after_ids)
        self.both = both.astype(np.float32)
        mass = c.mass / c.mass.sum()
        by_class = (both + TRUST_CLASS * mass) / (both.sum(1, keepdims=True) + TRUST_CLASS)
        total = after_ids.sum(1, keepdims=True)
        after = (after_ids + TRUST_PREVIOUS * by_class[group]) / (total + TRUST_PREVIOUS)
        grouped = after.reshape(c.n, GROUPS, EACH)
        self.start = np.log(grouped.sum(2)).astype(np.float32)
        self.inside = np.log(grouped).astype(np.float32).reshape(-1, EACH)
        apart = (after - mass) / np.sqrt(mass)
        weight = np.sqrt(total + 1)
        axes = np.linalg.eigh((apart * weight).T @ (apart * weight))[1][:, ::-1][:, :WIDTH]
        vector = apart @ (axes * np.sign(axes.sum(0) + 1e-12))
        scale = np.sqrt((vector**2 * total).sum(0) / max(total.sum(), 1)) + 1e-6
        self.vector = np.clip(vector / scale, -4, 4).astype(np.float32)
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"near": np.zeros(WINDOW, np.float32), "qkv": draw(WIDTH, 3 * WIDTH), "mixed": draw(WIDTH, HIDDEN), "direct": draw(WIDTH, HIDDEN), "bias": np.zeros(HIDDEN, np.float32), "group": draw(HIDDEN, GROUPS) * np.float32(0.1), "prior": np.zeros(GROUPS, np.float32), "class": draw(HIDDEN, CLASSES).reshape(HIDDEN, GROUPS, EACH).transpose(1, 0, 2).copy() * np.float32(0.1), "shift": np.zeros((GROUPS, EACH), np.float32)}
        self.back = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
        self.mask = np.where(self.back < 0, -1e9, 0).astype(np.float32)

    def weights(self) -> tuple[np.ndarray, ...]:
        """Parameters as the products take them: of two vectors (queries by keys, scaled); what is added to a pair of places; [vector, 1, mixture of vectors] to [hidden, 1]; [hidden, 1] to groups, and to the classes of each.

        Queries, keys and values are vectors times weights, so the weights are multiplied first and the mixtures are of vectors.
        """
        p, (q, k, v) = self.p, np.split(self.p["qkv"], 3, axis=1)
        mixing = np.zeros((2 * WIDTH + 1, HIDDEN + 1), q.dtype)
        mixing[:, :HIDDEN] = np.concatenate([p["direct"], p["bias"][None], v @ p["mixed"]])
        mixing[WIDTH, -1] = 1
        return q @ k.T * WIDTH**-0.5, self.mask + p["near"][np.maximum(self.back, 0)], mixing, np.concatenate([p["group"], p["prior"][None]]), np.concatenate([p["class"], p["shift"][:, None]], axis=1)

    def hidden(self, inputs: np.ndarray, at: np.ndarray, weights: tuple[np.ndarray, ...], since: int = 0):
        """For windows of ids (known ids, one row a window): [vector, 1] of all places and exponentials of the places from ``since`` on; for the places ``at`` (counted from there): [vector, 1, mixture], the sums of the exponentials and [hidden, 1]."""
        w, (pairs, added, mixing, _, _) = len(inputs), weights
        x = np.empty((w, WINDOW, WIDTH + 1), self.vector.dtype)
        x[:, :, :-1] = np.take(self.vector, inputs, axis=0)
        x[:, :, -1] = 1
        asked = np.ascontiguousarray(x[:, since:]).reshape(-1, WIDTH + 1)
        a = (asked[:, :-1] @ pairs).reshape(w, -1, WIDTH) @ x[:, :, :-1].transpose(0, 2, 1)
        a += added[since:]
        limited_exp(a, 30)
        m = np.take((a @ x).reshape(-1, WIDTH + 1), at, axis=0)
        u = np.empty((len(at), 2 * WIDTH + 1), x.dtype)
        u[:, : WIDTH + 1] = np.take(asked, at, axis=0)
        np.divide(m[:, :-1], m[:, -1:], out=u[:, WIDTH + 1 :])
        h = u @ mixing
        return x, a, u, m[:, -1:], np.maximum(h, 0, out=h)

    def outputs(self, h: np.ndarray, known: np.ndarray, target: np.ndarray, weights: tuple[np.ndarray, ...]):
        """For places sorted by their target's group: exponentials over the groups and over the classes of that group, the sums of both, and the groups' bounds.

        ``h``: [hidden, 1]; ``known``: the ids before; ``target``: classes.
        """
        group, (*_, to_group, to_class) = target // EACH, weights
        z = h @ to_group
        z += np.take(self.start, known, axis=0)
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        y = np.empty((len(h), EACH), h.dtype)
        for g, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            np.matmul(h[i:j], to_class[g], out=y[i:j])
        y += np.take(self.inside, known * GROUPS + group, axis=0)
        limited_exp(z, 60)
        limited_exp(y, 60)
        return z, y, z @ np.ones(GROUPS, z.dtype), y @ np.ones(EACH, y.dtype), ends

    def log10(self, inputs: np.ndarray, before: np.ndarray, ids: np.ndarray, scored: np.ndarray, weights: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """log10 probabilities of the scored ids (one row a window; 0 elsewhere) after the inputs (known ids) and the classes of the ids before."""
        c, at, weights = self.classes, np.flatnonzero(scored), weights or self.weights()
        since = int(scored.any(0).argmax())  # no place before is scored
        target = ids.reshape(-1)[at]
        group = c.group[target]
        order = by_group(group)
        at, target, group = at[order], target[order], group[order]
        h = self.hidden(inputs, at - since * (at // WINDOW + 1), weights, since)[-1]
        z, y, z_sum, y_sum, _ = self.outputs(h, inputs.reshape(-1)[at], group, weights)
        g, rows = before.reshape(-1)[at], np.arange(len(at)) * EACH
        share = (np.take(self.after_classes, g.astype(np.int64) * c.n + c.known[target]) + np.float32(TRUST_SHARE) * c.share[target]) / (np.take(self.both, g * CLASSES + group) + np.float32(TRUST_SHARE))
        out = np.zeros(ids.size)
        out[at] = np.log(z.reshape(-1)[rows + group // EACH] / z_sum * (y.reshape(-1)[rows + group % EACH] / y_sum) * share) / np.log(10)
        return out.reshape(ids.shape)

    def gradients(self, inputs: np.ndarray, target: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean class loss over the scored places (target: classes), and its gradients."""
        p, at, weights = self.p, np.flatnonzero(scored), self.weights()
        mixing, to_group, to_class = weights[2:]
        target = target.reshape(-1)[at]
        order = by_group(target)
        at, target = at[order], target[order]
        x, a, u, a_sum, h = self.hidden(inputs, at, weights)
        z, y, z_sum, y_sum, ends = self.outputs(h, inputs.reshape(-1)[at], target, weights)
        rows, n, loss = np.arange(len(at)) * EACH, len(at), 0.0
        for e, e_sum, t in ((z, z_sum, target // EACH), (y, y_sum, target % EACH)):
            t = rows + t
            flat = e.reshape(-1)
            loss -= float(np.log(flat[t] / e_sum).sum()) / n
            e *= (1 / (n * e_sum))[:, None]
            flat[t] -= e.dtype.type(1 / n)
        grouped, classes, more = h.T @ z, np.zeros_like(to_class), np.empty((n, HIDDEN), h.dtype)
        for g, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            classes[g] = h[i:j].T @ y[i:j]
            np.matmul(y[i:j], to_class[g, :-1].T, out=more[i:j])
        back = z @ to_group[:-1].T
        back += more
        back *= h[:, :-1] > 0
        mixed = u.T @ back
        # of a mixture m of vectors x by exponentials a: a pair's change is a * (dm @ x - dm @ m) / the sum of a
        dm = np.empty((n, WIDTH + 1), h.dtype)
        np.matmul(back, mixing[WIDTH + 1 :, :-1].T, out=dm[:, :-1])
        dm[:, -1] = -np.einsum("ij,ij->i", dm[:, :-1], u[:, WIDTH + 1 :])
        dm /= a_sum
        every = np.zeros(x.shape, h.dtype)
        every.reshape(-1, WIDTH + 1)[at] = dm
        da = every @ x.transpose(0, 2, 1)
        da *= a
        pairs = x.reshape(-1, WIDTH + 1)[:, :-1].T @ (da @ x).reshape(-1, WIDTH + 1)[:, :-1] * WIDTH**-0.5
        (q, k, v), values = np.split(p["qkv"], 3, axis=1), mixed[WIDTH + 1 :]
        near = np.bincount(np.maximum(self.back, 0).ravel(), da.sum(0).ravel(), WINDOW).astype(h.dtype)
        g = {"near": near, "qkv": np.concatenate([pairs @ k, pairs.T @ q, values @ p["mixed"].T], axis=1), "mixed": v.T @ values, "direct": mixed[:WIDTH], "bias": mixed[WIDTH]}
        return loss, g | {"group": grouped[:-1], "prior": grouped[-1], "class": classes[:, :-1], "shift": classes[:, -1]}


def limited_exp(x: np.ndarray, most: float) -> None:
    """exp(min(x, most)) in place."""
    if x.size and x.max() > most:
        np.minimum(x, most, out=x)
    np.exp(x, out=x)


def by_group(target: np.ndarray) -> np.ndarray:
    """The order of places by their target's group; bytes are sorted by counting."""
    return np.argsort((target // EACH).astype(np.uint8), kind="stable")


def rows_of(ids: np.ndarray, first: np.ndarray, windows: tuple[np.ndarray, ...]):
    """Windows of texts' ids (each text ends with END): the ids before, the ids, and which places are scored."""
    text, start, n, since = windows
    place = np.arange(WINDOW)
    at = (first[text] + start)[:, None] + np.minimum(place, n[:, None] - 1)
    # before a text's first id is the END of the text before, before the first text's the last one
    return ids[at - 1], ids[at], (place >= since[:, None]) & (place < n[:, None])


class Adam:
    """Steps over all parameters as one array."""

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        self.m, self.s = np.zeros((2, sum(v.size for v in model.p.values())), np.float32)

    def take(self, rate: float, inputs: np.ndarray, target: np.ndarray, scored: np.ndarray) -> None:
        self.step += 1
        g = self.model.gradients(inputs, target, scored)[1]
        d = np.concatenate([g[k].ravel() for k in self.model.p])
        self.m += np.float32(0.1) * (d - self.m)
        self.s += np.float32(0.01) * (d * d - self.s)
        change = np.float32(rate / (1 - 0.9**self.step)) * self.m / (np.sqrt(self.s / np.float32(1 - 0.99**self.step)) + np.float32(1e-8))
        at = 0
        for v in self.model.p.values():
            v -= change[at : at + v.size].reshape(v.shape)
            at += v.size


def score_ids(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each text; long texts go through in blocks of windows."""
    windows, weights = windows_of(first), model.weights()
    order, sums = np.argsort(windows[-1], kind="stable"), np.zeros(len(windows[0]))  # those whose every place is scored aren't in blocks with others
    for i in range(0, len(order), BLOCK):
        part = order[i : i + BLOCK]
        before, target, scored = rows_of(ids, first, tuple(x[part] for x in windows))
        sums[part] = model.log10(model.classes.known[before], model.classes.group[before], target, scored, weights).sum(1)
    return np.bincount(windows[0], sums, len(first) - 1)


# --- training


def with_ends(encoder: Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, first = encoder.encode_texts(data, offsets)
    return np.insert(ids, first[1:], END), first + np.arange(len(first))


def _ids(n_shards: int, rounds: int, vocabulary: str, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's ids; rows are dealt to rounds and shards at random."""
    encoder = Encoder(vocabulary, folder)
    rng = np.random.default_rng(TaskContext.get().partitionId())  # a task that is run again deals as before
    for batch in batches:
        for piece, raw, offsets in pieces(batch, "text", 4 << 20):
            data = LOWER[raw]
            words = np.diff(find_words(data, offsets)[2])
            ids, first = with_ends(encoder, data, offsets)
            ids = ids.astype(np.uint16)
            n = piece.num_rows
            keep = [piece.column(piece.schema.get_field_index(k)) for k in ("doc_id", "held_out", "row_key")]
            cells = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([*keep, pa.array(rng.integers(rounds, size=n), pa.int32()), pa.array(rng.integers(n_shards, size=n), pa.int32()), pa.array(words.astype(np.int64) + 1), cells], schema=IDS_SCHEMA)


def cells_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the cells, and where each cell's start (one more at the end)."""
    ids, n = joined(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]), np.uint16)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(n)])


def _sliced(counts: np.ndarray, part: int) -> list[dict]:
    """The counts that aren't zero, in one row for each slice of their places."""
    seen = np.flatnonzero(counts)
    return [{"part": part * SLICES + k, "places": blob(seen[at]), "counts": blob(counts[seen[at]].astype(np.int64))} for k, at in split_by(seen % SLICES)]


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(IDS, np.int64)
    for batch in batches:
        counts += np.bincount(cells_of(batch.column(0))[0], minlength=IDS)
    yield pa.RecordBatch.from_pylist(_sliced(counts, 0), schema=COUNT_SCHEMA)


def _pair_counts(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes after ids (part 0), and ids after classes (part 1)."""
    classes = shared.value
    counts = np.zeros((2, classes.n * CLASSES), np.int32)
    for batch in batches:
        ids, first = cells_of(batch.column(0))
        before = np.concatenate([[END], ids[:-1]])[: len(ids)]
        before[first[:-1]] = END
        for part, places in zip(counts, classes.places(before, ids), strict=True):
            if len(part) <= 4 * len(places):
                part += np.bincount(places, minlength=len(part)).astype(np.int32)
            else:
                np.add.at(part, places, 1)
    yield pa.RecordBatch.from_pylist(_sliced(counts[0], 0) + _sliced(counts[1], 1), schema=COUNT_SCHEMA)


def _summed(group: pa.Table) -> pa.Table:
    release()
    places, which = np.unique(joined(group["places"], np.int64)[0], return_inverse=True)
    counts = np.zeros(len(places), np.int64)
    np.add.at(counts, which, joined(group["counts"], np.int64)[0])
    return pa.Table.from_pylist([{"part": group["part"][0].as_py(), "places": blob(places), "counts": blob(counts)}], schema=COUNT_SCHEMA)


def gathered(rows: DataFrame, parts: int, size: int) -> np.ndarray:
    """The sums of a bounded number of counts: at most ``size`` for each part, whatever the input."""
    out = np.zeros((parts, size), np.float32)
    for row in rows.groupBy("part").applyInArrow(lambda group: _summed(group), COUNTS).collect():
        out[row["part"] // SLICES, np.frombuffer(row["places"], np.int64)] = np.frombuffer(row["counts"], np.int64)
    return out


def learn(model: Model, ids: np.ndarray, first: np.ndarray, turn: int, rounds: int, steps: int) -> tuple[Model, int]:
    """The model after a round's steps over the windows of a shard, each of which is used at least once; and how many these are."""
    windows = windows_of(first)
    order = np.random.default_rng(turn).permutation(len(windows[0]))
    after = copy.copy(model)
    after.p = {k: v.copy() for k, v in model.p.items()}
    adam, each, classes = Adam(after), min(BATCH, len(order)), model.classes
    total = max(-(-len(order) // each), -(-steps // rounds))
    for step in range(total):
        at = order[(step * each + np.arange(each)) % len(order)]
        before, target, scored = rows_of(ids, first, tuple(x[at] for x in windows))
        rate = 0.01 * min(1, (turn * total + step + 1) / 20) * (1 - 0.9 * (turn + (step + 1) / total) / rounds)
        adam.take(rate, classes.known[before], classes.group[target], scored)
    return after, len(order)


def _learn(shared, turn: int, rounds: int, steps: int, group: pa.Table) -> pa.Table:
    """A shard's change times its windows."""
    release()
    shard, before = group["shard"][0].as_py(), shared.value
    after, n = learn(before, *cells_of(group["ids"]), turn, rounds, steps)
    change = np.concatenate([(after.p[k] - before.p[k]).ravel() for k in before.p]).astype(np.float64) * n
    return pa.Table.from_pylist([{"part": shard % SLICES, "weight": float(n), "change": blob(change)}], schema=CHANGE_SCHEMA)


def _learner(*args):
    return lambda group: _learn(*args, group)


def _added(group: pa.Table) -> pa.Table:
    rows = sorted(zip(group["weight"].to_pylist(), group["change"].to_pylist(), strict=True))  # in an order of their own
    change = np.sum([np.frombuffer(c, np.float64) for _, c in rows], axis=0)
    return pa.Table.from_pylist([{"part": group["part"][0].as_py(), "weight": sum(w for w, _ in rows), "change": blob(change)}], schema=CHANGE_SCHEMA)


def trained(table: DataFrame, steps: int = STEPS, rounds: int = ROUNDS) -> Model:
    """A model of all training rows of a table of ids."""
    context = table.sparkSession.sparkContext
    known = table.where("not held_out")
    classes = Classes(gathered(known.select("ids").mapInArrow(_id_counts, COUNTS), 1, IDS)[0])
    shared = context.broadcast(classes)
    counts = gathered(known.select("ids").mapInArrow(functools.partial(_pair_counts, shared), COUNTS), 2, classes.n * CLASSES)
    shared.destroy()
    model = Model(classes, counts[0].reshape(-1, CLASSES), counts[1].reshape(CLASSES, -1))
    for turn in range(rounds):
        shared = context.broadcast(model)
        changes = known.where(F.col("round") == turn).groupBy("shard").applyInArrow(_learner(shared, turn, rounds, steps), CHANGES)
        sums = sorted(tuple(r) for r in changes.groupBy("part").applyInArrow(lambda group: _added(group), CHANGES).collect())
        if sums:
            change = np.sum([np.frombuffer(c, np.float64) for _, _, c in sums], axis=0) / sum(w for _, w, _ in sums)
            for k, v in model.p.items():
                model.p[k] = v + change[: v.size].reshape(v.shape).astype(np.float32)
                change = change[v.size :]
        shared.destroy()
    return model


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, first = cells_of(batch.column(batch.schema.get_field_index("ids")))
        keep = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "held_out", "row_key", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(score_ids(shared.value, ids, first))], schema=SCORE_SCHEMA)


# --- the base score


def _hashed(group: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Hashes of the words of a pack, and for each row of a piece where its words start."""
    poly = Poly(41)
    for batch in group.to_batches():
        for piece, raw, offsets in pieces(batch, "text"):
            data = LOWER[raw]
            starts, ends, first = find_words(data, offsets, WORD)
            yield piece, poly.of_slices(data, starts, ends), first


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, in any order, and which of them each one is."""
    found = pa.array(hashes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _words(n_buckets: int, group: pa.Table) -> pa.Table:
    """A pack's distinct words, each with how often training texts of the pack have it."""
    parts = []
    for piece, h, first in _hashed(group):
        trains = ~piece.column(piece.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
        distinct, which = _distinct(h)
        parts.append((distinct, np.bincount(which, np.repeat(trains, np.diff(first)), len(distinct)).astype(np.int64)))
    words, which = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    counts = np.bincount(which, np.concatenate([x for _, x in parts]), len(words)).astype(np.uint32)
    pack = group["pack"][0].as_py()
    rows = [{"bucket": b, "pack": pack, "words": blob(words[at]), "counts": blob(counts[at])} for b, at in split_by((words % U64(n_buckets)).astype(np.int64))]
    return pa.Table.from_pylist(rows, schema=WORD_SCHEMA)


def _tell(group: pa.Table) -> pa.Table:
    """For each pack the counts of its words in all packs; in one of the rows the bucket's totals."""
    release()
    words, per_row = joined(group["words"], U64)
    distinct, which = np.unique(words, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, which, joined(group["counts"], np.uint32)[0])
    totals = {"tokens": int(counts.sum()), "distinct": int((counts > 0).sum())}
    rows = []
    for pack, at in split_by(np.repeat(group["pack"].to_numpy(), per_row)):
        mine = np.unique(which[at])  # the parts of a large pack are told once
        rows.append({"pack": pack, "words": blob(distinct[mine]), "counts": blob(counts[mine]), **totals})
        totals = {"tokens": 0, "distinct": 0}
    return pa.Table.from_pylist(rows, schema=TOLD_SCHEMA)


def _base(texts: pa.Table, told: pa.Table) -> pa.Table:
    """Each row's known words, and the sum of log10(c + SMOOTH) over its words."""
    words, counts = joined(told["words"], U64)[0], joined(told["counts"], np.int64)[0]
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    out = []
    for piece, h, first in _hashed(texts):
        distinct, which = _distinct(h)
        count = counts[np.searchsorted(words, distinct)] if len(h) else np.zeros(0)
        sums = [np.diff(np.concatenate([[0.0], np.cumsum(x[which])])[first]) for x in (count > 0, np.log10(count + SMOOTH))]
        out.append(pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("row_key")), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1])], schema=BASE_SCHEMA))
    return pa.Table.from_batches(out, BASE_SCHEMA)


def base_scores(packs: Packs, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(row_key, known, logs) of every distinct row, and a table whose sums of ``tokens`` and ``distinct`` are the training words'."""
    n_buckets = parts_for(packs.n_bytes, bucket_bytes)
    told = written(packs.groups().applyInArrow(lambda group: _words(n_buckets, group), WORDS).groupBy("bucket").applyInArrow(lambda group: _tell(group), TOLD))
    found = packs.told(told.drop("tokens", "distinct")).applyInArrow(lambda texts, told: _base(texts, told), BASE)
    return written(found.groupBy("row_key").agg(F.first("known").alias("known"), F.first("logs").alias("logs"))), told


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def scores(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, steps: int = STEPS, bucket_bytes: int = BUCKET_BYTES, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    held, row_key = F.coalesce(fold() == HELD_OUT, F.lit(True)).alias("held_out"), F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("row_key")
    packs = Packs(docs, PACK_BYTES, held, row_key)
    base, told = base_scores(packs, bucket_bytes)
    ends = packs.texts.where("not held_out").count()
    sums = told.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = ends + (sums["n"] or 0), int(ends > 0) + (sums["v"] or 0)
    table = written(packs.texts.drop("pack").mapInArrow(functools.partial(_ids, parts_for(packs.n_bytes, shard_bytes), rounds, vocabulary, folder), IDS_TABLE))
    model = docs.sparkSession.sparkContext.broadcast(trained(table, steps, rounds))
    # rows that are equal have one score: a product's last bits depend on where a row stands in its block
    scored = table.mapInArrow(functools.partial(_score, model), SCORES).withColumn("score", F.min("score").over(Window.partitionBy("row_key")))
    known = F.col("known") + F.lit(int(ends > 0))
    base_score = F.col("logs") + F.lit(float(np.log10(ends + SMOOTH))) - F.col("n_tokens") * F.lit(float(np.log10(n + SMOOTH * (v + 1))))
    return scored.join(base, "row_key", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")
