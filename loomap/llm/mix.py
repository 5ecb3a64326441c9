"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern (the set
of their sources); a flow network then routes the patterns' words to the sources' quotas.  Each
further repetition of a pattern is an edge of its own with a higher cost, so the flow repeats
documents only where quotas need it.  The network has a node for each pattern and source, so its
size follows the number of patterns (meant for up to some thousands), not of documents.

A pattern that gets k times its words and a part of another round gives every document k times,
and the part to documents in the order of a seeded hash of the id.  The place where that order is
cut is found by histograms of the hash, refined until at most ``ZONE`` documents lie around the
cut; only these are looked at one by one, so no source is sorted as a whole.  Of the ``AROUND`` documents on either side of the
cut those are taken whose sizes fill what is left best, so a source of some dozens of documents meets its
quota to the word as a rule.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its own, the
last; null ids are told apart by their texts; rows that agree in id and text differ in the last bits of their hash, so a third of all rows
may be copies of one and the cut still finds its place among them;
with no words at all every target is 0; an empty table gives an empty result.  Reruns agree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomap.llm._spark import col, written
from loomap.llm._text import find_words, pieces

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MAX_REPEATS = 2
SEED = 17
BINS = 1024
ZONE = 20_000
LEAST_ZONE = 64
AROUND = 32
#: Last bits of the hash, by which equal rows differ.
COPY_BITS = 17
#: The network is solved on the driver; tables with more patterns are refused.
MOST_PATTERNS = 20_000
#: Documents around the cuts that are broadcast; beyond it, a shuffled join.
BROADCAST_ROWS = 500_000


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _size, the number of `[^\\x20\\x09-\\x0D]+` words of the text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_size", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in pieces(batch, text):
                n = np.diff(find_words(data, offsets)[2]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(n)], names=[*piece.schema.names, "_size"])

    return docs.mapInArrow(count, schema)


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MAX_REPEATS) -> dict[str | None, Fraction]:
    """Words each source should give: ``share`` of all words by weight, at most ``most`` times a source's size; the excess is reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, Fraction] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] > most * sizes[s] * total]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def route(capacity: dict[tuple, int], quota: dict, most: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words taken of each pattern: the cheapest largest flow from patterns to quotas.

    The t-th repetition of a pattern costs 2t-1 a word, so costs are convex in the repetitions.
    Shortest augmenting paths; whole numbers of words throughout.
    """
    edges: list[list] = []  # to, capacity left, cost; the reverse edge is at index ^ 1
    out: dict[object, list[int]] = {}

    def edge(a, b, cap, cost):
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(edges))
            edges.append([y, c, w])

    tiers = {}
    for p, words in capacity.items():
        for t in range(most):
            tiers.setdefault(p, []).append(len(edges))
            edge("from", ("pattern", p), words, 2 * t + 1)
        for s in p:
            edge(("pattern", p), ("source", s), sum(quota.values()) + 1, 0)
    for s, words in quota.items():
        edge(("source", s), "to", words, 0)
    while True:
        cost, came, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in out.get(x, []):
                y, cap, w = edges[e]
                if cap > 0 and cost[x] + w < cost.get(y, float("inf")):
                    cost[y], came[y] = cost[x] + w, e
                    if y not in queued:
                        queue.append(y)
                        queued.add(y)
        if "to" not in came:
            break
        path, y = [], "to"
        while y != "from":
            path.append(came[y])
            y = edges[came[y] ^ 1][0]
        flow = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= flow
            edges[e ^ 1][1] += flow
    return {p: sum(edges[e ^ 1][1] for e in own) for p, own in tiers.items()}


def choose(sized: DataFrame, need: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds _copies to documents with _pattern, _size and _hash; need: for each pattern its whole rounds and the further words."""
    spark = sized.sparkSession
    cut = {p: [0, 0, 63, words] for p, (_, words) in need.items() if words > 0}  # low end of the zone, its bits, words still needed
    lo, hi, left = {p: 0 for p in cut}, {p: 1 << 62 for p in cut}, {p: need[p][1] for p in cut}
    open_ = set(cut)
    while open_:
        rows = [(p, lo[p], max(1, (hi[p] - lo[p]) // BINS)) for p in open_]
        zone = spark.createDataFrame(rows, "_p string, _lo long, _width long")
        inside = sized.join(F.broadcast(zone), F.col("_pattern") == F.col("_p")).where("_hash >= _lo").withColumn("_bin", F.expr("(_hash - _lo) div _width")).where(F.col("_bin") <= BINS)
        found: dict[str, list] = {p: [] for p in open_}
        for r in inside.groupBy("_pattern", "_bin").agg(F.sum("_size").alias("w"), F.count("*").alias("n")).collect():
            found[r["_pattern"]].append((r["_bin"], r["w"], r["n"]))
        for p, base, width in rows:
            bins, i = sorted(x for x in found[p] if base + x[0] * width < hi[p]), 0
            while i < len(bins) and bins[i][1] <= left[p]:
                left[p] -= bins[i][1]
                i += 1
            if i == len(bins):
                lo[p] = hi[p]
                open_.discard(p)
                continue
            j, n = i + 1, bins[i][2]
            while j < len(bins) and n < LEAST_ZONE:
                n += bins[j][2]
                j += 1
            lo[p], hi[p] = base + bins[i][0] * width, min(hi[p], base + (bins[j - 1][0] + 1) * width)
            if n <= ZONE or width == 1:
                open_.discard(p)
    plan = spark.createDataFrame([(p, k, lo.get(p, 0), hi.get(p, 0) if lo.get(p, 0) < hi.get(p, 0) else lo.get(p, 0), left.get(p, 0)) for p, (k, _) in need.items()], "_p string, _rounds long, _lo long, _hi long, _left long")
    known = sized.join(F.broadcast(plan), F.col("_pattern") == F.col("_p"), "left")
    inside = F.coalesce((F.col("_hash") >= F.col("_lo")) & (F.col("_hash") < F.col("_hi")), F.lit(False))
    few = known.where(inside).groupBy("_p", "_left", "_hash", "_tie").agg(F.sum("_size").alias("_size"))  # rows that agree in everything go together
    extra = few.groupBy("_p").applyInPandas(_fit, "_zp string, _zh long, _zt long, _more long")
    if len(cut) * ZONE <= BROADCAST_ROWS:  # of each pattern, a zone of ZONE documents at most
        extra = F.broadcast(extra)
    copies = F.coalesce(F.col("_rounds"), F.lit(0)) + F.when(F.col("_hash") < F.col("_lo"), 1).otherwise(F.coalesce("_more", F.lit(0)))
    out = known.join(extra, (F.col("_p") == F.col("_zp")) & (F.col("_hash") == F.col("_zh")) & (F.col("_tie") == F.col("_zt")), "left")
    return out.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(0).cast("long")).drop("_p", "_rounds", "_lo", "_hi", "_left", "_zp", "_zh", "_zt", "_more")


def _fit(zone):
    """Of a zone of at most some ZONE documents in order of their hash, the first ones, and of those around the cut the set that fills what is left best."""
    zone = zone.sort_values(["_hash", "_tie"])
    left, size = int(zone["_left"].iloc[0]), zone["_size"].to_numpy()
    whole = int(np.searchsorted(np.cumsum(size), left, "right"))
    first, last = max(0, whole - AROUND), min(len(size), whole + AROUND)
    more = np.zeros(len(size), np.int64)
    more[:first] = 1
    more[[first + k for k in fullest(size[first:last].tolist(), left - int(size[:first].sum()))]] = 1
    out = zone[["_p", "_hash", "_tie"]].assign(_more=more)
    out.columns = ["_zp", "_zh", "_zt", "_more"]
    return out[out["_more"] > 0]


def fullest(sizes: list[int], room: int) -> list[int]:
    """Indices of the set with the greatest sum up to ``room``: reachable sums as bits of a number, one for each item."""
    unit = max(1, room // 4_000_000)
    steps = [-(-n // unit) for n in sizes]
    reach = [1]
    for n in steps:
        reach.append((reach[-1] | reach[-1] << n) & ((1 << room // unit + 1) - 1))
    at, out = reach[-1].bit_length() - 1, []
    for k in range(len(steps) - 1, -1, -1):
        if not reach[k] >> at & 1:
            out.append(k)
            at -= steps[k]
    return out


def mix(docs: DataFrame, sources: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MAX_REPEATS, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all of docs; none may be named as what is added) with _size, _source_size, _target and _copies.

    ``sources``: a column with one source, or an array of sources (each of which may take the document).
    _source_size and _target are those of the document's source, or the sums over its sources.
    """
    carry = docs.columns if carry is None else carry
    many = dict(docs.dtypes)[sources].startswith("array")
    members = F.coalesce(F.array_sort(F.array_distinct(F.col(sources))), F.array().cast(docs.schema[sources].dataType)) if many else F.array(F.col(sources).cast("string"))
    # the rows go along whole in one struct, so no column of docs clashes with a name used here
    row = F.struct(*[col(c) for c in carry]).alias("_row")
    keyed = docs.select(row, F.col("text").cast("string").alias("_text"), members.alias("_members"), F.expr(f"shiftleft(shiftrightunsigned(xxhash64(doc_id, text, {seed}L), {2 + COPY_BITS}), {COPY_BITS}) + pmod(xxhash64(monotonically_increasing_id()), {1 << COPY_BITS}L)").alias("_hash"), F.xxhash64("text", F.lit(seed)).alias("_tie"))
    keyed = keyed.withColumn("_pattern", F.to_json(F.struct(F.col("_members").alias("m")), {"ignoreNullFields": "false"}))
    sized = written(with_sizes(keyed, "_text").select("_row", "_size", "_members", "_pattern", "_hash", "_tie"))
    rows = sized.groupBy("_pattern").agg(F.first("_members").alias("members"), F.sum("_size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources: join sources into larger ones first")
    capacity = {tuple(r["members"]): r["words"] for r in rows}
    name = {tuple(r["members"]): r["_pattern"] for r in rows}
    sizes: dict[str | None, int] = {}
    for p, words in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets(sizes, weights, share, most)
    taken = route(capacity, {s: round(x) for s, x in goal.items()}, most)
    need = {name[p]: divmod(words, capacity[p]) if capacity[p] else (0, 0) for p, words in taken.items()}
    if not rows:
        return sized.select("_row.*", "_size", F.lit(0).cast("long").alias("_source_size"), F.lit(0.0).alias("_target"), F.lit(0).cast("long").alias("_copies"))
    about = sized.sparkSession.createDataFrame([(name[p], sum(sizes[s] for s in p), float(sum(goal[s] for s in p))) for p in capacity], "_about string, _source_size long, _target double")
    out = choose(sized, need).join(F.broadcast(about), F.col("_pattern") == F.col("_about"))
    return out.select("_row.*", "_size", "_source_size", "_target", "_copies")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    whole = docs.select("doc_id", "text", options.get("sources", "source"), F.struct(*[col(c) for c in docs.columns]).alias("_whole"))
    mixed = mix(whole, carry=["_whole"], **options).where("_copies > 0")
    return mixed.select("_whole", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_whole.*")
