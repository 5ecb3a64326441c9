"""Benchmark decontamination by winnowing.

Of every 13-word window of a text the least hashes of its 7-word grams are kept as fingerprints,
so a span of 13 words shared by a document and a benchmark item always shares a fingerprint.
The fingerprints of the benchmark are joined with those of the documents, and each hit is
extended to the windows around it, which are compared by two independent 64-bit hashes.

The benchmark is a stated query set: it goes to the tasks as sorted arrays in blocks of at most
``BLOCK_WINDOWS`` windows (or of one item that has more), whatever its size; one block is the usual case.  Of several blocks only one
is with the tasks at a time: what one finds is written before the next is sent.  The documents are read once a block and not shuffled.

Defined results: null and empty texts have no words and no hits; an item without words never
occurs; repeated rows are judged one by one; items with equal texts are all reported; a null
item_id is not reported, but the words in its windows are hit.  Only the id and text columns are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomap.llm._spark import blob, col, discard, written
from loomap.llm._text import ALNUM, LOWER, U64, Poly, covered, find_words, left_in_document, pieces, spread, winnow

WINDOW = 13
GRAM = 7
#: Benchmark windows that go to the tasks at once: 24 bytes each, so at most 48 MB.
BLOCK_WINDOWS = 2_000_000
#: One part in this many of a document's words must be hit for it to count as contaminated.
SHARE = 20
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Index:
    """Windows and fingerprints of a block of benchmark items, as sorted arrays."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = ids
        a, b = Poly(101), Poly(202)
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        prints = [np.zeros(0, U64)]
        for i, text in enumerate(texts):
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, first = find_words(data, np.array([0, len(data)]), ALNUM)
            if len(starts) == 0:
                continue
            ha, hb = a.of_slices(data, starts, ends), b.of_slices(data, starts, ends)
            n = min(window, len(ha))
            wa, wb = a.windows(ha, n), b.windows(hb, n)
            found.setdefault(n, []).append((wa, wb, np.full(len(wa), i)))
            if n == window:
                prints.append(fingerprints(a.windows(ha, gram), left_in_document(first), window, gram)[1])
        self.prints = np.unique(np.concatenate(prints))
        self.tables = {}
        for n, rows in found.items():
            wa, wb, item = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((item, wb, wa))
            self.tables[n] = wa[order], wb[order], item[order]

    def rows_of(self, n: int, ha: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ha, item) of all windows of n words that occur in the block."""
        wa, wb, item = self.tables[n]
        lo, hi = np.searchsorted(wa, ha, "left"), np.searchsorted(wa, ha, "right")
        count = hi - lo
        at, row = np.repeat(np.arange(len(ha)), count), spread(lo, count)
        same = wb[row] == hb[at]
        return at[same], item[row[same]]


def fingerprints(grams: np.ndarray, left: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed positions and their hashes."""
    inside = np.where(left[: len(grams)] >= gram, grams, ~U64(0))
    at = winnow(inside, left >= window, window - gram + 1)
    return at, inside[at]


def find_spans(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends a block's spans and items to those that earlier blocks found in the same rows."""
    a, b = Poly(101), Poly(202)
    for batch in batches:
        for piece, raw, offsets in pieces(batch, "text"):
            starts, ends, first = find_words(data := LOWER[raw], offsets, ALNUM)
            doc_at, item_at, from_at, to_at = _hits(index, a, b, data, starts, ends, first)
            order = np.argsort(doc_at, kind="stable")
            cuts = np.searchsorted(doc_at[order], np.arange(piece.num_rows + 1))
            before = [piece.column(piece.schema.get_field_index(k)).to_pylist() for k in ("starts", "ends", "items")]
            out = {"starts": [], "ends": [], "items": []}
            for d in range(piece.num_rows):
                mine = order[cuts[d] : cuts[d + 1]]
                pair = np.unique(np.stack([from_at[mine], to_at[mine]]), axis=1) if len(mine) else np.zeros((2, 0), np.int64)
                out["starts"].append((before[0][d] or b"") + blob(pair[0].astype(np.int64)))
                out["ends"].append((before[1][d] or b"") + blob(pair[1].astype(np.int64)))
                out["items"].append((before[2][d] or []) + [index.ids[i] for i in np.unique(item_at[mine]) if index.ids[i] is not None])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(piece.schema.get_field_index("key")),
                    piece.column(piece.schema.get_field_index("text")),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(out["starts"], pa.binary()),
                    pa.array(out["ends"], pa.binary()),
                    pa.array(out["items"], pa.list_(pa.string())),
                ],
                names=["key", "text", "n_words", "starts", "ends", "items"],
            )


def _hits(index, a, b, data, starts, ends, first):
    """(document, item, first word, word after the last) of every occurring window; words count from the document's first."""
    none = np.zeros(0, np.int64)
    if len(starts) == 0 or not index.tables:
        return none, none, none, none
    ha, hb = a.of_slices(data, starts, ends), b.of_slices(data, starts, ends)
    left = left_in_document(first)
    found = []
    for n in index.tables:
        wa, wb = a.windows(ha, n), b.windows(hb, n)
        inside = left[: len(wa)] >= n
        if n == index.window:
            at, prints = fingerprints(a.windows(ha, index.gram), left, n, index.gram)
            at = at[np.isin(prints, index.prints)]
            # a hit is extended to all windows that hold its gram
            reach = covered(np.maximum(at - (n - index.gram), 0), np.minimum(at, n - index.gram) + 1, len(left))[: len(wa)]
            inside &= reach
        at = np.flatnonzero(inside)
        which, item = index.rows_of(n, wa[at], wb[at])
        found.append((at[which], item, np.full(len(which), n)))
    at, item, n = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(first, at, "right") - 1
    return doc, item, at - first[doc], at - first[doc] + n


def spans(docs: DataFrame, benchmark: DataFrame, key: Column, finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """What ``finish`` makes of (key, text) of docs with n_words, the word spans where benchmark windows occur (int64 blobs starts, ends), and the items.

    It runs in the same pass as the last block.
    """
    spark = docs.sparkSession
    out = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("starts"), F.lit(None).cast("binary").alias("ends"), F.lit(None).cast("array<string>").alias("items"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    before, index = None, None
    for ids, texts in _blocks(items, block_windows):
        if index is not None:
            out = written(out.mapInArrow(lambda batches, index=index: find_spans(index.value, batches), out.schema))
            index.destroy()
            if before is not None:
                discard(before)
            before = out
        index = spark.sparkContext.broadcast(Index(ids, texts))
    return out.mapInArrow(lambda batches: finish(find_spans(index.value, batches)), schema)


def _blocks(items: DataFrame, block_windows: int) -> Iterator[tuple[list[str | None], list[str]]]:
    """The benchmark's rows, fetched a partition at a time and cut where a block is full."""
    ids, texts, size, some = [], [], 0, False
    for row in items.orderBy("item_id").toLocalIterator():
        here = len(_WORDS.findall((row["text"] or "").encode())) + 1
        if ids and size + here > block_windows:
            yield ids, texts
            ids, texts, size, some = [], [], 0, True
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += here
    if ids or not some:
        yield ids, texts


def _hit(row: dict) -> int:
    starts, ends = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["ends"], np.int64)
    return int(covered(starts, ends - starts, row["n_words"]).sum()) if len(starts) else 0


def _digest(share: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {name: [] for name in ("n_hit", "n_items", "items_sha256", "contaminated")}
        for row in batch.select(["n_words", "starts", "ends", "items"]).to_pylist():
            hit, items = _hit(row), sorted(set(row["items"]))
            for name, x in zip(out, (hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and share * hit >= row["n_words"]), strict=True):
                out[name].append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("n_words")), *(pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True))], names=["doc_id", "n_words", *out])


def _clean(share: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["n_words", "starts", "ends"]).to_pylist()
        hits = [_hit(row) for row in rows]
        ok = pa.array([not hit or share * hit < row["n_words"] for hit, row in zip(hits, rows, strict=True)], pa.bool_())
        yield batch.select(["key", "text"]).filter(ok)


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.  Nothing is shuffled."""
    return spans(docs, benchmark, F.col("doc_id").cast("long"), lambda batches: _digest(share, batches), DIGEST, block_windows)


def clean(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs that aren't contaminated.  Nothing is shuffled."""
    # a text that is a string goes along once: by itself, and not in the row
    rest = [c for c in docs.columns if c != "text" or docs.schema["text"].dataType != T.StringType()]
    key = F.struct(*[col(c) for c in rest]) if rest else F.struct(F.lit(True).alias("only"))
    schema = T.StructType([docs.select(key.alias("key")).schema["key"], T.StructField("text", T.StringType())])
    kept = spans(docs, benchmark, key, lambda batches: _clean(share, batches), schema, block_windows)
    field = lambda c: F.col(f"key.`{c.replace('`', '``')}`").alias(c)
    return kept.select(*[field(c) if c in rest else F.col("text") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)
), hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, w)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
