"""The k nearest neighbours, exactly and at any distance, by a tree of cells as joins.

The right side's places are put into a tree: a cube around all of them, halved twice along each axis, again and again where a cell holds
more than ``leaf`` places.  A place's smallest cell with enough rows bounds its k-th distance, and so does each place of its own leaf: by the way
to it and that one's k-th distance within the leaf.  From the root on, the cells that reach into the bound are followed down to their leaves, whose places
are measured; as the bound is close to the k-th distance, few of them pass.  So a place far from all others asks as few cells as one in a
crowd, no radius is guessed, and nothing is lost.  Equal places are one place with the first few ids: neither a leaf nor a
join holds more rows than the tree's bound, however many rows share a place (short of places nearer to each other than a 2^20-th of the cube).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.runtime import discard, written

#: Places of a cell that isn't cut (and for each row that is asked for), the deepest level, and the halvings of one round.
LEAF, PER_ROW, DEEPEST, STEP = 32, 16, 20, 2
#: Places of a leaf that are held against its others at once.
AT_ONCE = 1024
#: How much a bound is widened against rounding.
SLACK = 1e-9
P = ("px", "py", "pz")
LOW = ("x0", "y0", "z0")


def _cell(level: Column | int) -> Column:
    """The number of a place's cell at a level: three times twenty bits."""
    side = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    q = [F.greatest(F.lit(0), F.least((side - 1).cast("long"), F.floor((F.col(p) - F.col(lo)) / F.col("size") * side))) for p, lo in zip(P, LOW, strict=True)]
    return F.shiftleft(q[0], 40).bitwiseOR(F.shiftleft(q[1], 20)).bitwiseOR(q[2])


def _edges(level: Column, cell: Column) -> list[tuple[Column, Column]]:
    """Lower and upper end of a cell along each axis."""
    width = F.col("size") / F.pow(F.lit(2.0), level)
    at = [F.shiftright(cell, s).bitwiseAND((1 << 20) - 1) for s in (40, 20, 0)]
    return [(F.col(lo) + a * width, F.col(lo) + (a + 1) * width) for lo, a in zip(LOW, at, strict=True)]


def _reach(level: Column, cell: Column, farthest: bool) -> Column:
    """The square of a place's greatest or least distance from the points of a cell."""
    total = F.lit(0.0)
    for p, (lo, hi) in zip(P, _edges(level, cell), strict=True):
        d = F.greatest(F.abs(F.col(p) - lo), F.abs(F.col(p) - hi)) if farthest else F.greatest(F.lit(0.0), lo - F.col(p), F.col(p) - hi)
        total = total + d * d
    return total


def _tree(places: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(grp, level, cell, n rows, is_leaf) of all cells, and the places with the level and cell of their leaf."""
    cells, leaves, rest = [], [], places
    for level in range(0, DEEPEST + 1, STEP):
        at = rest.withColumn("cell", _cell(level))
        counts = written(at.groupBy("grp", "cell").agg(F.count("*").alias("_places"), F.sum("n").alias("n")).select("grp", F.lit(level).alias("level"), "cell", "n", ((F.col("_places") <= leaf) | F.lit(level == DEEPEST)).alias("is_leaf")))
        cells.append(counts)
        placed = at.join(counts.select("grp", "cell", "level", "is_leaf"), ["grp", "cell"])
        leaves.append(placed.where("is_leaf").select("grp", "level", "cell", *P, "ids"))
        if counts.where("not is_leaf").isEmpty():
            break
        rest = written(placed.where("not is_leaf").select(*places.columns))
    return written(reduce(DataFrame.unionByName, cells)), written(reduce(DataFrame.unionByName, leaves))


def _usable(df: DataFrame, at: tuple[str, ...], by: str | None, id_: str) -> DataFrame:
    grp = F.lit("") if by is None else F.col(by).cast("string")
    rows = df.select(F.col(id_).alias("id"), grp.alias("grp"), *[(F.col(a).cast("double") + 0.0).alias(p) for a, p in zip(at, P, strict=True)])  # + 0.0: no negative zero
    return rows.where(reduce(lambda a, b: a & b, [~F.isnan(p) & (F.abs(p) < float("inf")) for p in P]) & F.col("grp").isNotNull())


def _kth(leaf: pd.DataFrame, need: int) -> pd.DataFrame:
    """A leaf's places with the distance within which the leaf has ``need`` rows (infinite, if it has fewer)."""
    p, n = leaf[list(P)].to_numpy(), leaf["n"].to_numpy()
    kth = np.full(len(p), np.inf)
    if n.sum() >= need:
        for at in range(0, len(p), AT_ONCE):
            d2 = sum((p[at : at + AT_ONCE, None, a] - p[None, :, a]) ** 2 for a in range(3))
            some = np.argpartition(d2, min(need, len(p)) - 1, axis=1)[:, :need]  # a place is a row at least
            near = np.take_along_axis(d2, some, 1)
            order = np.argsort(near, axis=1)
            rows = np.cumsum(n[np.take_along_axis(some, order, 1)], axis=1)
            first = (rows >= need).argmax(1)
            kth[at : at + AT_ONCE] = np.sqrt(np.take_along_axis(near, np.take_along_axis(order, first[:, None], 1), 1)[:, 0])
    return leaf[["grp", "level", "cell", *P]].assign(kth=kth)


def k_nearest(left: DataFrame, right: DataFrame, k: int, *, id_: str = "object_idx", at: tuple[str, ...] = ("x", "y", "z"), by: str | None = None, others: bool = True, leaf: int | None = None) -> DataFrame:
    """(id, other, d, rank): for each left row its k nearest right rows (all, if fewer), of equal distances the least ids first.

    Both sides have the columns ``id_`` and ``at``; with ``by``, a row's neighbours are those of its own group.  With ``others``, rows of its own id aren't
    counted.  Rows without a place, or with one that isn't finite, have no neighbours and are none.
    """
    l, r = _usable(left, at, by, id_), _usable(right, at, by, id_)  # noqa: E741
    need = k + 1 if others else k
    leaf = max(LEAF, PER_ROW * need) if leaf is None else leaf
    ends = [f(p).alias(f"{name}_{p}") for p in P for name, f in (("lo", F.min), ("hi", F.max))]
    box = l.select(*P).unionByName(r.select(*P)).agg(*ends)
    size = F.greatest(*[F.col(f"hi_{p}") - F.col(f"lo_{p}") for p in P])
    cube = written(box.select(*[F.col(f"lo_{p}").alias(lo) for p, lo in zip(P, LOW, strict=True)], F.when(size > 0, size).otherwise(1.0).alias("size")))
    one = F.broadcast(cube)  # one row

    # of a place's rows only the first few can be among anyone's first
    few = r.withColumn("_n", F.row_number().over(Window.partitionBy("grp", *P).orderBy("id"))).where(F.col("_n") <= need)
    places = written(few.groupBy("grp", *P).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).join(one))
    cells, leaves = _tree(places, leaf)
    deepest = cells.agg(F.max("level").alias("d")).first()["d"]
    asked = written(l.select("grp", *P).distinct().join(one))
    if deepest is None:
        return l.where("false").select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"), F.lit(1).alias("rank"))
    # the smallest cell around a place with enough rows bounds the k-th distance
    own = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest), F.lit(STEP)))).withColumn("cell", _cell(F.col("level")))
    full = own.join(cells.where(F.col("n") >= need).select("grp", "level", "cell"), ["grp", "level", "cell"])
    far = full.select("grp", *P, _reach(F.col("level"), F.col("cell"), True).alias("bound"))
    # and so does a place of its own leaf
    kind = f"grp string, level int, cell long, {', '.join(f'{p} double' for p in P)}, kth double"
    kth = leaves.select("grp", "level", "cell", *P, F.size("ids").cast("long").alias("n")).groupBy("grp", "level", "cell").applyInPandas(lambda rows: _kth(rows, need), kind)
    kth = kth.where(F.col("kth") < float("inf")).select("grp", "level", "cell", *[F.col(p).alias(f"_{p}") for p in P], "kth")
    d2 = reduce(lambda a, b: a + b, [(F.col(p) - F.col(f"_{p}")) * (F.col(p) - F.col(f"_{p}")) for p in P])
    by_leaf = own.join(kth, ["grp", "level", "cell"]).select("grp", *P, F.pow(F.sqrt(d2) + F.col("kth"), F.lit(2.0)).alias("bound"))
    bound = written(far.unionByName(by_leaf).groupBy("grp", *P).agg(F.min("bound").alias("bound")))
    about = [*asked.columns, "bound"]
    infinite = F.coalesce("bound", F.lit(float("inf")))
    front = asked.join(bound, ["grp", *P], "left").withColumn("bound", infinite * (1 + SLACK) + SLACK)
    front = front.join(cells.where("level = 0").select("grp", "level", "cell", "is_leaf"), "grp")
    ends_, tables = [], []
    for level in range(0, deepest + 1, STEP):
        ends_.append(front.where("is_leaf").select(*about, "level", "cell"))
        if level == deepest:
            break
        below = cells.where(F.col("level") == level + STEP)
        low = (1 << (20 - STEP)) - 1
        parent = F.shiftleft(F.shiftright("cell", 40 + STEP), 40).bitwiseOR(F.shiftleft(F.shiftright("cell", 20 + STEP).bitwiseAND(low), 20)).bitwiseOR(F.shiftright("cell", STEP).bitwiseAND(low))
        down = below.select("grp", parent.alias("_parent"), "level", "cell", "is_leaf")
        front = front.where("not is_leaf").select(*about, F.col("cell").alias("_parent")).join(down, ["grp", "_parent"]).drop("_parent").where(_reach(F.col("level"), F.col("cell"), False) <= F.col("bound"))
        front = written(front)
        tables.append(front)
    reached = reduce(DataFrame.unionByName, ends_)
    near = leaves.select("grp", "level", "cell", *[F.col(p).alias(f"_{p}") for p in P], "ids")
    pairs = reached.join(near, ["grp", "level", "cell"]).withColumn("d2", d2).where(F.col("d2") <= F.col("bound"))
    rows = pairs.select("grp", *P, F.sqrt("d2").alias("d"), F.explode("ids").alias("other"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("grp", *P).orderBy("d", "other"))).where(F.col("_n") <= need)
    answer = written(first.groupBy("grp", *P).agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("near")))
    discard(*tables)
    found = l.join(answer, ["grp", *P])
    kept = F.filter("near", lambda x: x["other"] != F.col("id")) if others else F.col("near")
    return found.select("id", F.posexplode(F.slice(kept, 1, k)).alias("_i", "_x")).select("id", F.col("_x.other").alias("other"), F.col("_x.d").alias("d"), (F.col("_i") + 1).alias("rank"))


#: Places in a cell, queries of a block, and rows of one query that a task sorts at once.
CHUNK, QUERIES, BAND_ROWS, SAMPLE = 8192, 16, 1 << 20, 1024
RANKED = "object_idx long, a_object_idx long, closest long, farthest long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as cells of ids and places; a place with a null is marked."""
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            none = np.any([part.column(k).is_null().to_numpy(zero_copy_only=False) for k in (1, 2, 3)], axis=0)
            at = np.stack([pa.compute.fill_null(part.column(k), 0.0).to_numpy(zero_copy_only=False) for k in (1, 2, 3)])
            cells = [part.column(0).to_numpy().tobytes(), at.tobytes(), none.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["ids", "at", "none"])


def _apart(at: np.ndarray, none: np.ndarray, place: tuple) -> np.ndarray:
    """Distances, summed as ``functions.math.distance`` does; below 0 where a place isn't known."""
    if None in place:
        return np.full(at.shape[1], -1.0)
    x, y, z = (v - p for v, p in zip(at, place, strict=True))
    return np.where(none, -1.0, np.sqrt(x * x + y * y + z * z))


def _ranked(sample: np.ndarray, bands: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both ranks of one band of a block of queries' distances: all rows are met and counted, those of the band are kept and sorted."""
    queries, edges, met = [], [], []
    with np.errstate(all="ignore"):
        for batch in batches:
            for row in batch.to_pylist():
                if not queries:
                    queries = [(q["a_object_idx"], (q["a_x"], q["a_y"], q["a_z"])) for q in row["queries"]]
                    some = [_apart(sample, np.zeros(sample.shape[1], bool), at) for _, at in queries]
                    some = [d[~np.isnan(d)] for d in some]
                    edges = [np.quantile(d, np.arange(1, bands) / bands) if len(d) else np.zeros(bands - 1) for d in some]
                    met = [[[], [], 0, 0] for _ in queries]
                ids, none = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], bool)
                at = np.frombuffer(row["at"]).reshape(3, -1)
                for (query, place), cuts, m in zip(queries, edges, met, strict=True):
                    d, other = _apart(at, none, place), ids != query
                    band = np.searchsorted(cuts, d, side="right")
                    mine = other & (band == row["band"])
                    m[0].append(ids[mine])
                    m[1].append(d[mine])
                    m[2] += int((other & (band < row["band"])).sum())
                    m[3] += int(other.sum())
        for (query, _), m in zip(queries, met, strict=True):
            ids, d, before, n = np.concatenate(m[0]), np.concatenate(m[1]), m[2], m[3]
            m[:2] = [], []
            order = np.lexsort((ids, d))
            ids, d = ids[order], d[order]
            new = np.flatnonzero(np.append(True, ~((d[1:] == d[:-1]) | (np.isnan(d[1:]) & np.isnan(d[:-1]))))[: len(d)])
            size = np.diff(np.append(new, len(d)))  # of equal distances
            place = np.arange(len(d))
            far = n - before - np.repeat(new + size, size) + place - np.repeat(new, size)
            for k in range(0, len(d), 4 * CHUNK):
                part = slice(k, k + 4 * CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(np.full(len(ids[part]), query)), pa.array(before + place[part]), pa.array(far[part])], names=["object_idx", "a_object_idx", "closest", "farthest"])


def distance_ranks(rows: DataFrame, queries: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """(object_idx, a_object_idx, closest, farthest): each row's ranks (from 0) by its distance from each query, not itself; both sides object_idx, x, y, z.

    Equal distances are ranked by the id both ways; one that isn't known is the least, NaN the greatest, as Spark orders them.  The pairs aren't shuffled: the rows go in cells
    to blocks of queries.  A task keeps and sorts one band of its queries' distances, about ``band_rows`` for each, and only counts the others; where the bands are cut follows a
    sample and decides their sizes alone.
    """
    spark = rows.sparkSession
    place = [F.col("object_idx").cast("long").alias("object_idx"), *[F.col(c).cast("double").alias(c) for c in "xyz"]]
    stored, asked = (df.select(*place).where("object_idx is not null") for df in (rows, queries))
    bands, blocks = (max(1, -(-df.count() // n)) for df, n in ((stored, band_rows), (asked, QUERIES)))
    some = stored.dropna().orderBy(F.xxhash64("object_idx"), "object_idx").limit(SAMPLE).collect() if bands > 1 else []
    sample = np.array([(r.x, r.y, r.z) for r in some]).reshape(-1, 3).T
    block = F.pmod(F.xxhash64("object_idx"), F.lit(blocks)).alias("block")
    by_block = asked.groupBy(block).agg(F.collect_list(F.struct(*[F.col(c).alias(f"a_{c}") for c in ("object_idx", *"xyz")])).alias("queries"))
    cells = stored.mapInArrow(_cells, "ids binary, at binary, none binary").join(F.broadcast(by_block))
    cells = cells.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).repartition(blocks * bands, "block", "band")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ranked(sample, bands, batches)

    return cells.groupBy("block", "band").applyInArrow(task, RANKED)
