"""Token ids of documents, packed into rows of one length by best-fit decreasing.

Every document becomes its token ids and an end id.  Longer ones than a row are cut into whole rows
and a rest, losing nothing.  Each task packs what it reads, a buffer of some million tokens at a time:
segments go by falling length into the open row with the least room that still holds them, found
in a segment tree over the amounts of room.  Text isn't shuffled and memory is bounded by the buffer.  Which segments share
a row depends on how the input is partitioned, and each task leaves one poorly filled row at most a buffer; what the rows hold together doesn't.

A result row is one row of the id matrix: ids (little-endian, ROW ids, padded with the end
id), n_tokens, cu_seqlens (0 and the end of each segment), position_resets (the places where positions
start at 0 again), and for each segment its doc_id and its place in the document's ids.

Defined results: null and empty texts are an end id alone; repeated rows are packed each; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomap.llm._spark import release
from loomap.llm._text import pieces, spread
from loomap.llm._tokens import Encoder
from loomap.llm._vocab import TOKENIZERS

ROW = 2048
BUFFER = 4_000_000
PACKED = "n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


class Room:
    """Segment tree over the amounts of room 0..row: which of them some open row has."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, which: int) -> None:
        rows = self.rows.setdefault(room, [])
        rows.append(which)
        if len(rows) == 1:
            i = room + self.size
            while i and not self.some[i]:
                self.some[i] = 1
                i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and gives a row with the least room that is at least ``least``: (room, row)."""
        some, i = self.some, least + self.size
        if not some[i]:
            while True:  # up to the first right sibling that has something, then down to its least leaf
                while i > 1 and i & 1:
                    i >>= 1
                if i <= 1:
                    return None
                if some[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        room = i - self.size
        rows = self.rows[room]
        which = rows.pop()
        if not rows:
            while i and not (i < self.size and (some[2 * i] or some[2 * i + 1])):
                some[i] = 0
                i >>= 1
        return room, which


def best_fit(lengths: np.ndarray, row: int = ROW) -> np.ndarray:
    """The row of each segment (lengths 1..row), best-fit decreasing; equal lengths in their order."""
    room, out, n = Room(row), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = room.take(length)
        if found is None:
            found, n = (row, n), n + 1
        left, out[i] = found
        if left > length:
            room.add(left - length, out[i])
    return out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind, mask=mask))


def _packed(ids: np.ndarray, first: np.ndarray, doc_ids: np.ndarray, unknown: np.ndarray, row: int, end: int, kind) -> pa.RecordBatch:
    n = np.diff(first)
    parts = -(-n // row)
    doc = np.repeat(np.arange(len(n)), parts)
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * row
    length = np.minimum(n[doc] - place, row)
    which = best_fit(length, row)
    order = np.argsort(which, kind="stable")
    which, doc, place, length = which[order], doc[order], place[order], length[order]
    rows = int(which[-1]) + 1
    upto = np.cumsum(length)
    new = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    before = np.repeat((upto - length)[new], np.diff(np.append(new, len(which))))
    start = upto - length - before  # of a segment in its row
    matrix = np.full(rows * row, end, kind)
    matrix[spread(which * row + start, length)] = ids[spread(first[:-1][doc] + place, length)]
    segments = np.bincount(which, minlength=rows)
    ends = np.insert(start + length, new, 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.bincount(which, length, rows).astype(np.int32)),
            pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * row * matrix.itemsize).astype(np.int32)), pa.py_buffer(matrix)]),
            _lists(ends.astype(np.int32), segments + 1, pa.int32()),
            _lists(start.astype(np.int32), segments, pa.int32()),
            _lists(doc_ids[doc], segments, pa.int64(), unknown[doc]),
            _lists(place, segments, pa.int64()),
        ],
        names=["n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
    )


def _pack(name: str, folder: str, row: int, end: int, buffer: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(name, folder)
    kind = np.uint16 if end < 1 << 16 else np.uint32
    held, size = [], 0

    def flush():
        ids, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        return _packed(ids, np.concatenate([[0], np.cumsum(counts)]), np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), row, end, kind)

    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            ids, first = encoder.encode_texts(data, offsets)
            ids = np.insert(ids.astype(kind), first[1:], end)
            keys = piece.column(piece.schema.get_field_index("doc_id"))
            held.append((ids, np.diff(first) + 1, keys.fill_null(0).to_numpy(zero_copy_only=False), ~keys.is_valid().to_numpy(zero_copy_only=False)))
            size += len(ids)
            if size >= buffer:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    # workers are kept between tasks
    del encoder, held
    release()


def pack(docs: DataFrame, row: int = ROW, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, end: int = 50256, buffer: int = BUFFER) -> DataFrame:
    """Packed rows of all documents; see the module's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: _pack(vocabulary, folder, row, end, buffer, batches), PACKED)


def write(packed: DataFrame, folder: str) -> None:
    """The rows as files of a matrix each: Parquet with ids (one row of the matrix), cu_seqlens and position_resets; and the documents they are from."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(folder)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids of a packed row: from 0 in every segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
