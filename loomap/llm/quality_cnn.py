"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Learned filters run over each
chunk's embedded bytes; their outputs are max-pooled over the chunk.  A document's chunks are
combined by the greatest and the mean pooled value of each filter, from which a logistic layer
gives one probability.  Only the text is an input.

Training runs on the driver over at most ``TRAIN_ROWS`` labelled rows (those with the least hash of
the id), with at most ``TRAIN_CHUNKS`` chunks in all; both are parameters of ``fit``.  A row of more than ``TRAIN_CHUNKS / LARGEST``
chunks is learnt from that many of them, spread over its text; in the order of the hash, a row that no longer fits is skipped
and the ones after it are still tried.  Only what is chosen is sent to the driver.  Equal rows are learnt from once.  Scoring reads the whole of every text once, in
blocks of chunks, so memory doesn't grow with a text; nothing is shuffled.

Defined results: null and empty texts are one chunk of padding and get its score; with no label rows
to learn from, the untrained network's prior (one half) is given; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomap.llm._text import pieces, spread

CHUNK, STEP = 512, 448
EMBED, TAPS, FILTERS = 6, 5, 16
BLOCK = 128
TRAIN_ROWS = 4000
TRAIN_CHUNKS = 60_000
LARGEST = 16
EPOCHS = 6
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
CHOSEN = "doc_id long, label int, text_key long"
DRAWN = CHOSEN + ", chunks binary"
DRAWN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text_key", pa.int64()), ("chunks", pa.binary())])
SCORES = "doc_id long, held_out boolean, score double, predicted int"
PAD = 0


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of CHUNK bytes for each chunk, and the number of chunks of each text (one at least)."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(n)), n)
    start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    length = np.minimum(offsets[doc + 1] - start, CHUNK)
    out = np.full((len(doc), CHUNK), PAD, np.uint8)
    out.ravel()[spread(np.arange(len(doc)) * CHUNK, length)] = data[spread(start, length)]
    return out, n


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"embed": draw(256, EMBED), "filters": draw(2 * TAPS * EMBED, FILTERS) * np.float32(0.6), "bias": np.zeros(FILTERS, np.float32), "out": np.zeros(2 * FILTERS, np.float32), "prior": np.zeros(1, np.float32)}

    def _rows(self, chunks: np.ndarray) -> np.ndarray:
        """For each chunk and each second byte, the embedded bytes under the filters."""
        x = self.p["embed"][chunks].reshape(len(chunks), CHUNK // 2, 2 * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(x, TAPS, axis=1)  # chunk, place, 2 * EMBED, TAPS
        return view.transpose(0, 1, 3, 2).reshape(len(chunks), CHUNK // 2 - TAPS + 1, TAPS * 2 * EMBED)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), BLOCK):
            rows = self._rows(chunks[i : i + BLOCK])
            out[i : i + BLOCK] = (rows.reshape(-1, rows.shape[2]) @ self.p["filters"]).reshape(rows.shape[0], rows.shape[1], FILTERS).max(1)
        return np.maximum(out + self.p["bias"], 0)

    def combined(self, pooled: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.cumsum(n) - n
        return np.concatenate([np.maximum.reduceat(pooled, at), np.add.reduceat(pooled, at) / n[:, None].astype(np.float32)], axis=1)

    def score(self, chunks: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.combined(self.pooled(chunks), n) @ self.p["out"] + self.p["prior"][0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60).astype(np.float64)))

    def gradients(self, chunks: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of documents with labels y."""
        rows = self._rows(chunks)
        conv = (rows.reshape(-1, rows.shape[2]) @ self.p["filters"]).reshape(rows.shape[0], rows.shape[1], FILTERS)
        where = conv.argmax(1)
        pooled = np.maximum(np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + self.p["bias"], 0)
        at = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(n)), n)
        v = self.combined(pooled, n)
        dz = ((1 / (1 + np.exp(-np.clip(v @ self.p["out"] + self.p["prior"][0], -60, 60))) - y) / len(y)).astype(np.float32)
        g = {"out": v.T @ dz, "prior": dz.sum(keepdims=True)}
        dv = dz[:, None] * self.p["out"]
        top = np.maximum.reduceat(pooled, at)[doc] == pooled
        dp = dv[doc, FILTERS:] / n[doc, None].astype(np.float32) + np.where(top, dv[doc, :FILTERS], 0)
        dp = np.where(pooled > 0, dp, 0).astype(np.float32)
        g["bias"] = dp.sum(0)
        picked = np.take_along_axis(rows, where[:, :, None], 1)  # chunk, filter, inputs
        g["filters"] = np.einsum("cfi,cf->if", picked, dp)
        dx = dp[:, :, None] * self.p["filters"].T[None]  # chunk, filter, inputs
        under = np.take_along_axis(chunks[:, None, :], 2 * where[:, :, None] + np.arange(2 * TAPS)[None, None], 2)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], under.reshape(-1), dx.reshape(-1, EMBED))
        return g


def train(chunks: np.ndarray, n: np.ndarray, labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam over shuffled documents of n chunks each."""
    net = Network(seed)
    if not len(n):
        return net
    at, use = np.cumsum(n) - n, np.arange(len(n))
    y = np.asarray(labels, np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    net.p["prior"][0] = np.log(share / (1 - share))
    rng, m, s, step = np.random.default_rng(seed), {}, {}, 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(use), max(1, len(use) // 16)):
            step += 1
            g = net.gradients(chunks[spread(at[batch], n[batch])], n[batch], y[batch])
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for k, d in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                s[k] = 0.99 * s.get(k, 0) + 0.01 * d * d
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _score(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            p = net.score(*chunks_of(data, offsets))
            keep = [piece.column(piece.schema.get_field_index(k)) for k in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _drawn(each: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's chunks, or that many of them at even distances."""
    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            chunks, n = chunks_of(data, offsets)
            at = np.cumsum(n) - n
            cells = [chunks[a + (np.arange(min(k, each)) * k) // min(k, each)].tobytes() for a, k in zip(at, n, strict=True)]
            keep = [piece.column(piece.schema.get_field_index(k)) for k in DRAWN_SCHEMA.names[:3]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(cells, pa.binary())], schema=DRAWN_SCHEMA)


def fitting(sizes: list[int], room: int) -> list[int]:
    """The places of the sizes that fit into the room, taken in order; those that don't are skipped."""
    taken = []
    for i, size in enumerate(sizes):
        if size <= room:
            taken.append(i)
            room -= size
    return taken


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, chunks: int = TRAIN_CHUNKS) -> Network:
    """Trains on a bounded sample of the labelled rows outside the held-out fold: of at most ``rows`` rows and ``chunks`` chunks."""
    known = labels.where(F.col(label).isNotNull() & (fold() != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    count = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - (CHUNK - STEP)) / STEP)).cast("long")
    each = max(1, chunks // LARGEST)
    found = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text_key", F.least(count, F.lit(each)).alias("n")).distinct()
    sizes = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text_key").limit(2 * rows).collect()
    chosen = docs.sparkSession.createDataFrame([tuple(sizes[i])[:3] for i in fitting([r["n"] for r in sizes], chunks)], CHOSEN)
    cells = texts.join(F.broadcast(chosen), ["doc_id", "text_key"]).select(*DRAWN_SCHEMA.names[:3], "text").mapInArrow(lambda batches: _drawn(each, batches), DRAWN)
    drawn = sorted(cells.dropDuplicates(["doc_id", "label", "text_key"]).collect(), key=lambda r: (r["doc_id"], r["label"], r["text_key"]))
    n = np.array([len(r["chunks"]) // CHUNK for r in drawn], np.int64)
    return train(np.frombuffer(b"".join(r["chunks"] for r in drawn), np.uint8).reshape(-1, CHUNK), n, [r["label"] for r in drawn])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(lambda batches: _score(shared.value, batches), SCORES)
