"""Small helpers that the operators share on the Spark side."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomap.runtime import checkpoint_dir, discard, written  # noqa: F401  used by the operators


def col(name: str) -> Column:
    """A column by its whole name, whatever is in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, from which the numbers of packs and buckets are derived."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // each))


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binary cells of a column in one array, and how many each cell has."""
    cells = [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in column]
    return (np.concatenate(cells) if cells else np.zeros(0, dtype)), np.array([len(x) for x in cells], np.int64)


def split_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each key that occurs, in order, the positions that hold it; the cost follows the keys that are there."""
    order = np.argsort(key, kind="stable")
    x = key[order]
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(x))[: len(cuts)].tolist(), strict=True):
        yield int(x[a]), order[a:b]


def release() -> None:
    """Gives back to the system what this Python worker has freed: workers are kept between tasks, and an executor's memory is theirs too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
