"""What the two substring operators share: packs of documents, and finding hashes that several documents have.

A pack holds some megabytes of text: documents are dealt to packs by a hash of id and text, so neither null ids
nor ids that cluster make a large one.  Rows that are repeated so often that their pack is too large are dealt on, at random, and what is
told to such a pack is told to each part of it.  Hashes go to tasks by bucket (their value modulo
the number of buckets); each task sends a bucket the distinct hashes of what it has read, as one
binary cell, so a string that a third of all documents hold costs one entry for each piece of text and pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from loomap.llm._spark import blob, joined, parts_for, release, split_by, text_bytes
from loomap.llm._text import U64

PACK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
ENTRIES = "bucket int, hashes binary, packs binary, several binary"
ALIVE = "pack int, hashes binary"


def narrow(x: np.ndarray, size: int = 6, drop: int = 2) -> bytes:
    """``size`` bytes of each number above its lowest ``drop``: of a hash, enough to propose candidates."""
    return np.ascontiguousarray((x >> U64(8 * drop)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def widen(raw: np.ndarray, size: int = 6) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view("<u8").ravel().astype(U64)


class Packs:
    """(doc_id, text, pack and other columns) of docs, the number of packs, and the bytes of text."""

    def __init__(self, docs: DataFrame, pack_bytes: int = PACK_BYTES, *others: Column):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
        self.n_bytes = text_bytes(docs)
        n = parts_for(self.n_bytes, pack_bytes)
        self.texts = docs.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
        size = F.sum(F.octet_length("text")).alias("size")
        large = self.texts.groupBy("pack").agg(size).where(F.col("size") > 2 * pack_bytes).collect()  # less than half of the packs; as a rule none
        self.parts = {r["pack"]: int(-(-r["size"] // pack_bytes)) for r in large}

    def _parts(self) -> Column:
        if not self.parts:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in self.parts.items() for x in pair]), F.col("pack")), F.lit(1))

    def groups(self) -> GroupedData:
        """The rows by pack, and by part of it."""
        return self.texts.withColumn("part", F.floor(F.rand(5) * self._parts()).cast("int")).groupBy("pack", "part")

    def told(self, replies: DataFrame) -> PandasCogroupedOps:
        """The rows with what is told to their packs."""
        if self.parts:
            replies = replies.withColumn("part", F.explode(F.sequence(F.lit(0), self._parts() - 1)))
        else:
            replies = replies.withColumn("part", F.lit(0))
        return self.groups().cogroup(replies.groupBy("pack", "part"))


def entries(n_buckets: int, hashes: np.ndarray, docs: np.ndarray, packs: np.ndarray) -> Iterator[dict]:
    """One row for each bucket: the distinct (hash, pack) with whether several documents have it."""
    if len(hashes) == 0:
        return
    order = np.lexsort((docs, packs, hashes))
    h, d, p = hashes[order], docs[order], packs[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])]))
    last = np.append(new[1:], len(h)) - 1
    h, p, several = h[new], p[new], (d[new] != d[last]).astype(np.uint8)
    for b, at in split_by((h % U64(n_buckets)).astype(np.int64)):
        yield {"bucket": b, "hashes": narrow(h[at]), "packs": blob(p[at].astype(np.int32)), "several": blob(several[at])}


#: Entries that a task gathers before it sends the buckets theirs, so that rows stay fat however many buckets there are.
HELD = 500_000


def gathered(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets out of (hashes, documents, packs) of one piece of text after another."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one in found:
        held.append(one)
        if sum(len(h) for h, _, _ in held) >= HELD:
            yield batch_of(list(entries(n_buckets, *(np.concatenate(x) for x in zip(*held, strict=True)))), ENTRY_SCHEMA)
            held = []
    if held:
        yield batch_of(list(entries(n_buckets, *(np.concatenate(x) for x in zip(*held, strict=True)))), ENTRY_SCHEMA)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


ENTRY_SCHEMA = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("packs", pa.binary()), ("several", pa.binary())])
ALIVE_SCHEMA = pa.schema([("pack", pa.int32()), ("hashes", pa.binary())])


def survivors(group: pa.Table) -> pa.Table:
    """Of a bucket's entries, those whose hash several documents have: one row for each pack."""
    release()
    raw, _ = joined(group["hashes"], np.uint8)
    h, (p, _), (several, _) = widen(raw), joined(group["packs"], np.int32), joined(group["several"], np.uint8)
    _, which, count = np.unique(h, return_inverse=True, return_counts=True)
    alive = (count >= 2) | (np.bincount(which, several, len(count)) > 0)
    keep = alive[which]
    h, p = h[keep], p[keep]
    rows = [{"pack": k, "hashes": narrow(np.unique(h[at]) << U64(16))} for k, at in split_by(p)]
    return pa.Table.from_pylist(rows, schema=ALIVE_SCHEMA)


def alive_set(group: pa.Table) -> np.ndarray:
    """The sorted hashes (without their lower two bytes) that survive in a pack."""
    return np.unique(widen(joined(group["hashes"], np.uint8)[0]))


def among(hashes: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Whether the upper six bytes of each hash are in a sorted set."""
    if len(alive) == 0:
        return np.zeros(len(hashes), bool)
    x = hashes >> U64(16)
    at = np.minimum(np.searchsorted(alive, x), len(alive) - 1)
    return alive[at] == x


def run_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value of every run of w values."""
    if len(x) < w:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        have += step
    return at
