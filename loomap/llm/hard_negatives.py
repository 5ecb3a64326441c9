"""Hard negatives by a pivot table.

Every vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the greatest length, and an anchor a zero there, so
|a - x|^2 = M^2 + |a|^2 - 2 a.x: what is nearest has the greatest inner product.  The table stores each row's distances to a
few pivots.  With an anchor's own distances the triangle inequality brackets its distance to every row, and so
its score: first for a cell of rows at once (the rows of a batch lie in order of their nearest pivot and their
distance from it), then for the rows of the cells that are left.  Rows whose bracket misses what is asked are ruled out, the
survivors' scores are computed exactly.

Two passes over the table, for one block of anchors at a time: the first finds each anchor's first positives, the second, for
each (anchor, positive), the first negatives in the band of scores.  A task keeps only the first few rows of each anchor (or
band) it has met so far, whose least score is the bound for the rows after them; those few meet the other tasks' in one window by anchor (or band).
The table itself is never shuffled or copied for an anchor, and no label, vector or cell is a group, so it doesn't matter how many rows share one.

Bounds: ``PIVOTS`` pivots are chosen, each farthest from those before it, among ``SAMPLE`` rows with the least hash of id and vector; they decide
speed alone.  A block of anchors with all that is broadcast and fetched for it takes ``BLOCK_BYTES`` of vectors at most; of several blocks, each one's result is
written before the next is read.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a row without an
id takes part but is no anchor, and comes last among equal scores.  Shorter vectors count as filled up with zeros, an empty one scores 0.
Rows that repeat an id are rows by themselves; an anchor's other rows are those of other ids, and a repeated anchor is
answered as often as it occurs.  Scores are exact for vectors of integers while below 2^53, rounded beyond; an empty table, or one without anchors, gives no rows.
Only the three named columns are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.llm._spark import blob, release, written

PIVOTS = 8
SAMPLE = 2048
#: Rows of one cell of the table, which is ruled in or out as one.
CELL = 64
#: Cells that are looked at together, and anchors that are.
SLAB, ANCHORS = 16, 512
#: Pairs whose scores are computed at once.
PAIRS = 1 << 16
BLOCK_BYTES = 16 << 20
CELLS = "ids binary, nameless binary, labels binary, kind string, vectors binary, distances binary"
FOUND = "query long, score double, vec_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Number types in which a cell's components may be stored, if they all fit; doubles else.
KINDS = ("int8", "int16", "int32", "float32")


class Pivots:
    """Augmented pivots and the greatest squared length, from which distances and brackets follow."""

    def __init__(self, rows: np.ndarray, most: float, count: int = PIVOTS):
        self.most, self.dim = most, rows.shape[1]
        points = self.augmented(rows)
        chosen = []
        far = np.full(len(points), np.inf)
        for _ in range(min(count, len(points))):
            chosen.append(points[int(np.argmax(far))])
            far = np.minimum(far, np.sqrt(((points - chosen[-1]) ** 2).sum(1)))
        self.points = np.array(chosen).reshape(len(chosen), self.dim + 1)

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.most - (rows**2).sum(1), 0))
        return np.concatenate([rows, more[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in self.points], axis=1)


class Anchors:
    """A block of anchors with their distances to the pivots; ``bands`` hold for each anchor (one or more) what is sought."""

    def __init__(self, pivots: Pivots, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors, self.dim = ids, labels, vectors, pivots.dim
        self.distances = pivots.distances(np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1))
        self.sum = pivots.most + (vectors**2).sum(1)
        #: Above all rounding in the distances.
        self.slack = 1e-9 * self.sum + 1e-6

    def bracket(self, some: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of some anchors with rows (or cells) whose distances to the pivots lie between low and high; what isn't a number excludes nothing."""
        near, far = np.zeros((len(some), len(low))), np.full((len(some), len(low)), np.inf)
        for k in range(low.shape[1]):
            d = self.distances[some, k][:, None]
            np.maximum(near, np.maximum(low[:, k] - d, d - high[:, k]), out=near)
            np.minimum(far, high[:, k] + d, out=far)
        total, slack = self.sum[some][:, None], self.slack[some][:, None]
        return (total - far**2) / 2 - slack, (total - near**2) / 2 + slack


class Best:
    """The first few rows of each query so far: higher scores first, then ids, those without an id last."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.score = np.full((queries, keep), -np.inf)
        self.ids, self.nameless, self.there = np.zeros((queries, keep), np.int64), np.zeros((queries, keep), bool), np.zeros((queries, keep), bool)

    @property
    def bound(self) -> np.ndarray:
        """The score that a row must reach to be among them."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, nameless: np.ndarray, ids: np.ndarray) -> None:
        met = np.unique(query)
        old = np.nonzero(self.there[met])
        q = np.concatenate([met[old[0]], query])
        s, n, i = (np.concatenate([x[met][old], new]) for x, new in ((self.score, score), (self.nameless, nameless), (self.ids, ids)))
        order = np.lexsort((i, n, -s, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, rank = order[rank < self.keep], rank[rank < self.keep]
        for x, new in ((self.score, s), (self.nameless, n), (self.ids, i), (self.there, np.ones(len(q), bool))):
            x[q[order], rank] = new[order]

    def batch(self) -> pa.RecordBatch:
        q, k = np.nonzero(self.there)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.score[q, k]), pa.array(self.ids[q, k], mask=self.nameless[q, k])], names=["query", "score", "vec_id"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    out = np.zeros((len(column), dim))
    size = np.diff(column.offsets.to_numpy())
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _cells(pivots: Pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivot table's rows, a cell each."""
    for batch in batches:
        ids = batch.column(0)
        nameless, ids, labels = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), batch.column(1).to_numpy()
        x = _matrix(batch.column(2), pivots.dim)
        d = pivots.distances(pivots.augmented(x))
        nearest = d.argmin(1)
        order = np.lexsort((d.min(1), nearest))
        out = {name.split()[0]: [] for name in CELLS.split(", ")}
        for at in range(0, len(order), CELL):
            rows = order[at : at + CELL]
            kind = next((k for k in KINDS if np.array_equal(x[rows].astype(k), x[rows])), "float64")
            for name, value in zip(out, (blob(ids[rows]), blob(nameless[rows]), blob(labels[rows]), kind, blob(x[rows].astype(kind)), blob(d[rows])), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "kind" else pa.binary()) for k, v in out.items()], names=list(out))


def _slabs(pivots: Pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Some cells at a time: where each begins, then ids, which have none, labels, vectors and distances of all rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            part = batch.slice(at, SLAB).to_pydict()
            ids = [np.frombuffer(b, np.int64) for b in part["ids"]]
            begin = np.cumsum([0, *(len(x) for x in ids)])[:-1]
            nameless, labels = (np.concatenate([np.frombuffer(b, kind) for b in part[name]]) for name, kind in (("nameless", bool), ("labels", np.int64)))
            vectors = np.concatenate([np.frombuffer(b, k).reshape(len(x), pivots.dim) for b, k, x in zip(part["vectors"], part["kind"], ids, strict=True)]).astype(np.float64)
            distances = np.concatenate([np.frombuffer(b) for b in part["distances"]]).reshape(len(vectors), len(pivots.points))
            yield begin, np.concatenate(ids), nameless, labels, vectors, distances
        release()


def _survivors(anchors: Anchors, some: np.ndarray, slab: tuple, wanted, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of the pairs that ``wanted`` admits and whose bracket meets the anchor's [low, high]."""
    begin, _, _, labels, vectors, distances = slab
    least, greatest = np.minimum.reduceat(distances, begin), np.maximum.reduceat(distances, begin)
    floor, top = anchors.bracket(some, least, greatest)
    open_ = ~(top < low[:, None]) & ~(floor > high[:, None])
    rows = np.flatnonzero(np.repeat(open_.any(0), np.diff(np.append(begin, len(labels)))))
    if not len(rows):
        return
    floor, top = anchors.bracket(some, distances[rows], distances[rows])
    q, r = np.nonzero(wanted(anchors.labels[some][:, None], labels[rows][None, :]) & ~(top < low[:, None]) & ~(floor > high[:, None]))
    for at in range(0, len(q), PAIRS):
        a, b = some[q[at : at + PAIRS]], rows[r[at : at + PAIRS]]
        yield a, b, np.einsum("ij,ij->i", anchors.vectors[a], vectors[b])


def _positives(pivots: Pivots, anchors: Anchors, keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = Best(len(anchors.ids), keep)
    for slab in _slabs(pivots, batches):
        _, ids, nameless, labels, *_ = slab
        for at in range(0, len(anchors.ids), ANCHORS):
            some = np.arange(at, min(at + ANCHORS, len(anchors.ids)))
            some = some[np.isin(anchors.labels[some], labels)]
            for a, b, score in _survivors(anchors, some, slab, np.equal, best.bound[some], np.full(len(some), np.inf)) if len(some) else ():
                ok = ((ids[b] != anchors.ids[a]) | nameless[b]) & ~(score < best.bound[a])
                best.add(a[ok], score[ok], nameless[b[ok]], ids[b[ok]])
    yield best.batch()


def _negatives(pivots: Pivots, anchors: Anchors, bands: tuple, keep: int, low: int, high: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bands: anchor and positive score of each, in order of the anchor, and each anchor's first band and number of bands."""
    owner, positive, first, count = bands
    best = Best(len(owner), keep)
    lower, upper = low * positive / 100, high * positive / 100
    has = np.flatnonzero(count)
    for slab in _slabs(pivots, batches):
        _, ids, nameless, *_ = slab
        for at in range(0, len(has), ANCHORS):
            some = has[at : at + ANCHORS]
            least = np.minimum.reduceat(np.maximum(lower, best.bound), first[some])
            most = np.maximum.reduceat(upper, first[some])
            # reduceat runs to the next start: between anchors with bands there is nothing, after the block's last there may be
            last = slice(first[some[-1]], first[some[-1]] + count[some[-1]])
            least[-1], most[-1] = np.maximum(lower, best.bound)[last].min(), upper[last].max()
            # rounding of the band's ends is far below the slack of the brackets, and the band is tested again below
            for a, b, score in _survivors(anchors, some, slab, np.not_equal, least, most):
                pair = np.repeat(np.arange(len(a)), count[a])
                band = first[a][pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(count[a]) - count[a], count[a]))
                s, b = score[pair], b[pair]
                ok = (low * positive[band] <= 100 * s) & (100 * s <= high * positive[band]) & ~(s < best.bound[band])
                best.add(band[ok], s[ok], nameless[b[ok]], ids[b[ok]])
    yield best.batch()


def _first(found: DataFrame, keep: int) -> DataFrame:
    """Of all tasks' rows the first few of each query, with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _blocks(rows: DataFrame, pivots: Pivots, block: int) -> Iterator[Anchors]:
    """Anchors, fetched a partition at a time and cut where a block is full."""
    ids, labels, vectors = [], [], []
    made = lambda: Anchors(pivots, np.array(ids, np.int64), np.array(labels, np.int64), np.array(vectors).reshape(len(ids), pivots.dim))
    for row in rows.toLocalIterator():
        x = np.zeros(pivots.dim)
        x[: len(row["vector"])] = row["vector"]
        ids.append(row["vec_id"])
        labels.append(row["label"])
        vectors.append(x)
        if len(ids) >= block:
            yield made()
            ids, labels, vectors = [], [], []
    if ids:
        yield made()


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """The rows' cells, written to the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    return written(rows.select("vec_id", "label", "vector").mapInArrow(lambda batches: _cells(shared.value, batches), CELLS))


def taking_part(rows: DataFrame) -> DataFrame:
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row (vec_id, label, vector) that ``anchor`` admits and each of its first positives (rows of its label): the first rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's, by rank."""
    spark = rows.sparkSession
    rows = taking_part(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    most = rows.agg(F.max(square).alias("most"), F.max(F.size("vector")).alias("dim")).first()
    empty = spark.createDataFrame([], MINED)
    if most["dim"] is None:
        return empty
    dim = max(1, most["dim"])
    taken = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector").collect()
    sample = np.array([[*r["vector"], *[0.0] * (dim - len(r["vector"]))] for r in taken])
    pivots = Pivots(sample, most["most"])
    table = pivot_table(rows, pivots)
    out = []
    before = None
    for anchors in _blocks(rows.where(F.col("vec_id").isNotNull() & anchor), pivots, max(1, block_bytes // (8 * (dim + 8)))):
        if before is not None:
            out.append(written(before))
        before = _mined(table, pivots, anchors, positives, negatives, low, high)
    if before is None:
        return empty
    return reduce(DataFrame.unionByName, [*out, before])


def _mined(table: DataFrame, pivots: Pivots, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """One block's answers."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((pivots, anchors))
    near = _first(table.mapInArrow(lambda batches: _positives(*shared.value, positives, batches), FOUND), positives).toArrow().sort_by([("query", "ascending"), ("rank", "ascending")])
    query, score = near["query"].to_numpy(), near["score"].to_numpy()
    # positives of one score ask for the same band
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1])
    owner, count = query[new], np.bincount(query[new], minlength=len(anchors.ids))
    sent = spark.sparkContext.broadcast((owner, score[new], np.cumsum(count) - count, count))
    found = _first(table.mapInArrow(lambda batches: _negatives(*shared.value, sent.value, negatives, low, high, batches), FOUND), negatives)
    asked = spark.createDataFrame(pa.table({"query": np.cumsum(new) - 1, "anchor_id": anchors.ids[query], "positive_id": near["vec_id"], "positive_score": score}))
    rows = found.join(F.broadcast(asked), "query")
    return rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The query's rows: labels of ids divisible by 7 moved on by one, components as floor(256 x)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    y = lambda x: x * 256
    # from 2^52 on doubles are integers, and what isn't finite has no floor
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(y(x)) < 2.0**52, F.floor(y(x)).cast("double")).otherwise(y(x)))
    return embeddings.select("vec_id", label.alias("label"), scaled.alias("vector"))


def mined(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(relabelled(embeddings), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
