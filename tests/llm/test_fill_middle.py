"""op11: every unit's cuts against lists of units, round trips, odd rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomap.llm import fill_middle
from loomap.llm._text import buffers

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", UNITS)
def test_every_cut_by_its_run(unit):
    rng = random.Random(3)
    texts = ["", "\n", "a", "\n\na\n", "é\n\n\nß𝄞", " x", "x \n y", *("".join(rng.choices("ab \n\té𝄞€", k=rng.randint(0, 30))) for _ in range(200))]
    data, offsets = buffers(pa.array(texts))
    runs = fill_middle.Runs(data, offsets, unit)
    units = [re.findall(UNITS[unit], t) for t in texts]
    assert runs.units.tolist() == [len(u) for u in units]
    for cut in range(32):
        cuts = np.minimum(cut, runs.units)
        got = runs.offset(cuts) - offsets[:-1]
        assert got.tolist() == [len("".join(u[:c]).encode()) for u, c in zip(units, cuts, strict=True)]


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(UNITS["line"], text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return n, form, len(pre), len(mid), out


ROWS = [
    (0, None), (1, ""), (2, "\n"), (3, "one line"), (4, "a\nb\nc\n"), (5, "a\r\nb c\x85\n\n\nd"), (6, "has <S> in it\nb\n"), (7, "<P<S\n>\n<"), (8, "é𝄞\nß"),
    (None, "no id\nat all\n"), (4, "a\nb\nc\n"), (9, "x" * 3_000_000 + "\n" + "y\n" * 200_000), (10, "<\n<\n<\nS>\nM>\n"),
]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 0)])
def test_against_plain(spark, rate, spm):
    rng = random.Random(8)
    rows = ROWS + [(i, "".join(rng.choices(["a", "é ", "\n", "b\n"], k=rng.randint(0, 60)))) for i in range(20, 160)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, h1 int").repartition(3)
    got = fill_middle.transform(docs, rate=rate, spm=spm)
    back = got.select("*", fill_middle.restored(got.output, got.form).alias("back")).collect()
    want = [(d, *plain(d, t, rate, spm), t or "") for d, t in rows]
    assert sorted(map(repr, (tuple(r) for r in back))) == sorted(map(repr, want))
    assert fill_middle.digest(docs.where("false")).count() == 0


def test_digest_against_sql(spark):
    rows = [r for r in ROWS if r[0] != 9]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    documents = docs.toArrow()  # noqa: F841  the SQL's table
    got, want = fill_middle.digest(docs), duckdb.sql(fill_middle.ORACLE)
    assert got.columns == want.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
