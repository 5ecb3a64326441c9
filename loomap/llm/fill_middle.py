"""Fill-in-the-middle transformation over run-length encoded character classes.

A text is kept as its maximal runs of one character class: where a run starts, the bytes one unit
of it takes, and how many units all runs up to it hold.  Lines have two classes (newlines, each of
which ends a unit, and all else, which is a unit only where no newline follows); words have white
space and all else; characters have one class for each UTF-8 width.  A cut after so many units is found by
binary search for the run that holds it, and its offset follows by arithmetic: no unit is ever cut out or listed.

The cuts and the form of a text follow from four numbers that a hash of its id gives, so reruns agree
and copies under other ids are cut elsewhere.  Texts are read once and nothing is shuffled.

Defined results: null and empty texts are empty, have no units and stay plain; so do texts that hold a sentinel, which
could not be put together again; a null id is hashed as an empty one; repeated rows come out
equal; a text of any length is cut whole (its arrays take some tens of bytes for each of its bytes at most).
Only the id and text columns are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomap.llm._text import WORD, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the texts that are transformed, and of those with the suffix first.
RATE, SPM = 100, 50
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
WIDTH = np.zeros(256, np.int64)
WIDTH[:0x80], WIDTH[0xC0:0xE0], WIDTH[0xE0:0xF0], WIDTH[0xF0:] = 1, 2, 3, 4


class Runs:
    """Maximal runs of one class in each text, with the units that they and all before them hold."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "line"):
        self.offsets = offsets
        if unit == "char":
            at = np.flatnonzero(WIDTH[data])
            kind = WIDTH[data[at]]
        else:
            at = np.arange(len(data))
            kind = data == 0x0A if unit == "line" else ~WORD[data]
        new = np.ones(len(at), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[np.searchsorted(at, offsets[:-1][offsets[1:] > offsets[:-1]])] = True
        first = np.flatnonzero(new)
        self.start, kind = at[first], kind[first]
        self.end = np.append(self.start[1:], len(data))[: len(first)]
        # a run's last text has it at its end: no other run follows there
        last = np.isin(self.end, offsets[1:])
        if unit == "line":
            self.step = np.where(kind, 1, 0)
            units = np.where(kind, self.end - self.start, last)
        elif unit == "word":
            self.step = np.zeros(len(first), np.int64)
            units = kind | last
        elif unit == "char":
            self.step = kind
            units = (self.end - self.start) // np.maximum(kind, 1)
        else:
            raise ValueError(f"no such unit: {unit}")
        self.upto = np.cumsum(units.astype(np.int64))
        self.before = np.concatenate([[0], self.upto])[np.searchsorted(self.start, offsets)]

    @property
    def units(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before)

    def offset(self, cut: np.ndarray) -> np.ndarray:
        """For each text, the byte offset after its first ``cut`` units."""
        if not len(self.upto):
            return self.offsets[:-1]
        sought = self.before[:-1] + cut
        run = np.minimum(np.searchsorted(self.upto, sought), len(self.upto) - 1)
        inside = sought - (self.upto[run] - np.diff(self.upto, prepend=0)[run])
        found = np.where(self.step[run] > 0, self.start[run] + inside * self.step[run], self.end[run])
        return np.where(cut > 0, found, self.offsets[:-1])


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def _cut(unit: str, rate: int, spm: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            h1, h2, h3, h4 = (piece.column(piece.schema.get_field_index(k)).to_numpy() for k in ("h1", "h2", "h3", "h4"))
            held = piece.column(piece.schema.get_field_index("held")).to_numpy(zero_copy_only=False).astype(bool)
            runs = Runs(data, offsets, unit)
            n = runs.units
            a, b = h1 % (n + 1), h2 % (n + 1)
            at, to = runs.offset(np.minimum(a, b)), runs.offset(np.maximum(a, b))
            chars = np.concatenate([[0], np.cumsum(WIDTH[data] > 0)])
            plain = held | (n == 0) | (h3 % 100 >= rate)
            form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
            view = memoryview(np.ascontiguousarray(data))
            out = [
                bytes(view[x:y]) if f == "plain" else joined(f, view[x:i], view[i:j], view[j:y])
                for f, x, i, j, y in zip(form.tolist(), offsets[:-1].tolist(), at.tolist(), to.tolist(), offsets[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(piece.schema.get_field_index("doc_id")),
                    pa.array(n),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(chars[at] - chars[offsets[:-1]], mask=plain),
                    pa.array(chars[to] - chars[at], mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output (the transformed text).

    ``unit`` is line (a newline or the end ends it), word (with the white space after it) or char.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held.alias("held"), *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(lambda batches: _cut(unit, rate, spm, batches), FORMS)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one came from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """What transform() gives, with hashes in place of the output and of the text put together again from it."""
    back = restored(F.col("output"), F.col("form"))
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), c AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d
), p AS (
  SELECT doc_id, t, n, array_to_string(u[1 : least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1 : n], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
