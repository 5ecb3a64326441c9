"""Graphs: connected components by alternating large and small stars (only two sums a round go to the driver), hops, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomap.runtime import dealt, discard, written

#: Edges of a task that looks for the next hop, and words of 64 queries that are broadcast at once.
EDGES, WORDS = 1 << 20, 3 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node of its component.

    ``edges``: columns a and b (long).  Self-edges and repeated edges don't matter.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: the greater neighbours of a node go to its least neighbour (or itself)
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lesser neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, e = e, written(small.where("u <> v").distinct())
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def first_independent(conflicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (node) that a greedy choice in order keeps: each that no kept lesser node conflicts with.

    conflicts: a < b (long).  In a round those are kept whose lesser neighbours are all dropped, and those dropped that a
    kept one conflicts with; the rest, a table in the shared folder, goes into the next.
    """
    open_ = written(conflicts.select("a", "b").distinct())
    kept = [written(nodes.join(open_.select(F.col("b").alias("node")), "node", "left_anti"))]
    while not open_.isEmpty():
        heads = open_.select(F.col("a").alias("node")).distinct().join(open_.select(F.col("b").alias("node")), "node", "left_anti")
        gone = open_.join(heads.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        left = open_.join(gone.select(F.col("node").alias("b")), "b", "left_anti")
        # what only dropped nodes stood against is free
        free = left.join(gone.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        left = left.join(gone.select(F.col("node").alias("a")), "a", "left_anti")
        now = written(left)
        kept.append(written(free.distinct().join(now.select(F.col("b").alias("node")), "node", "left_anti")))
        discard(open_)
        open_ = now
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def reachable(edges: DataFrame, start: DataFrame, hops: int, broadcast: bool = True) -> DataFrame:
    """(source, node, hop): the nodes within ``hops`` undirected edges of each start node, with the least number of hops.

    ``edges``: a, b; ``start``: node.  Only the newest nodes are expanded in each round.  Edges may be repeated: what they lead to is made distinct, not they.
    Their tasks follow their number, so a task's memory doesn't.  ``broadcast`` false: edges are never broadcast, however few; where many nodes lead to a hub, all
    that it leads to them would be one task's.
    """
    both = dealt(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a", EDGES)
    if not broadcast:
        both = both.hint("merge")
    seen = start.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop"))
    newest = seen
    for hop in range(1, hops + 1):
        newest = newest.join(both, newest["node"] == both["a"]).select("source", F.col("b").alias("node"), F.lit(hop).alias("hop")).distinct()
        newest = newest.join(seen, ["source", "node"], "left_anti")
        seen = seen.unionByName(newest)
    return seen


def local_maps(seen: DataFrame, every: int, words: int = WORDS) -> DataFrame:
    """(q, landmarks): for each keyframe that is a multiple of ``every``, how many landmarks those keyframes see that share one with it.

    ``seen``: kf, lm (long); rows may be repeated.  Queries are bits of words, 64 keyframes each, and a set of queries is never rows.  Rows are dealt by landmark, and
    the keyframes' words go to them (``words`` at a time, for which the rows are read again, not shuffled), so nothing but the rows and the words is shuffled.
    """
    by_lm = dealt(seen.select("kf", "lm"), "lm", EDGES)
    at = f"(kf div {every})"
    of = by_lm.where(F.col("kf") % every == 0).select("lm", F.expr(f"shiftright({at}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("bits"))
    of = of.groupBy("lm", "word").agg(F.bit_or("bits").alias("bits"))
    one = by_lm.join(of, "lm").groupBy("kf", "word").agg(F.bit_or("bits").alias("bits"))
    one = written(one.groupBy("kf").agg(F.collect_list(F.struct("word", "bits")).alias("words")))
    parts = max(1, -(-(one.agg(F.sum(F.size("words"))).first()[0] or 0) // words))
    bit = [F.sum(F.shiftright("bits", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"n{b}") for b in range(64)]
    out = None
    for part in range(parts):
        sent = one.withColumn("words", F.filter("words", lambda w: F.pmod(w["word"], F.lit(parts)) == part)).where(F.size("words") > 0)  # noqa: B023
        met = by_lm.join(F.broadcast(sent), "kf").select("lm", F.inline("words")).groupBy("lm", "word").agg(F.bit_or("bits").alias("bits"))
        n = met.groupBy("word").agg(*bit)
        out = n if out is None else out.unionByName(n)
    each = out.select("word", F.posexplode(F.array(*[f"n{b}" for b in range(64)])).alias("bit", "landmarks")).where("landmarks > 0")
    return each.select(((F.col("word") * 64 + F.col("bit")) * every).alias("q"), "landmarks")


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(loser, winner, hops): the end of every chain of redirects; a cycle ends at its least member.

    Pointers are doubled each round, so a chain of n takes about log2(n) rounds.
    """
    now = written(redirects.select("loser", "winner", F.lit(1).cast("long").alias("hops")))
    for _ in range(64):
        onward = now.select(F.col("loser").alias("_l"), F.col("winner").alias("_w"), F.col("hops").alias("_h"))
        nxt = now.join(onward, now["winner"] == onward["_l"], "left")
        moved = nxt.where((F.col("_w").isNotNull()) & (F.col("_w") != F.col("winner")))
        if moved.isEmpty():
            break
        nxt = nxt.select("loser", F.coalesce("_w", "winner").alias("winner"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
        last, now = now, written(nxt)
        discard(last)
    return now
