"""Operators whose result depends on an order: greedy duplicates, one-to-one matches, temporal suppression, constrained merging.

Greedy choices are made in rounds of joins, so no image or scene is one task.  Suppression works on a query's answer and
merging on a component (its pairs, or its nodes alone), each in a pandas function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomap.operators.graph import first_independent
from loomap.runtime import discard, written


def unique_masks(detections: DataFrame, iou: float = 0.6) -> DataFrame:
    """Detections (image_id, det, score, x1 y1 x2 y2) without those that overlap a kept earlier one of the image too much."""
    other = detections.select("image_id", *[F.col(c).alias(f"o_{c}") for c in ("det", "x1", "y1", "x2", "y2")])
    pairs = detections.join(other, "image_id").where((F.col("det") < F.col("o_det")) & (_iou("", "o_") > iou))
    kept = first_independent(pairs.select(F.col("det").alias("a"), F.col("o_det").alias("b")), detections.select(F.col("det").alias("node")))
    return detections.join(kept.select(F.col("node").alias("det")), "det", "left_semi").select(*detections.columns)


def _iou(p: str, q: str) -> Column:
    v = lambda side, name: F.col(side + name)
    both = F.greatest(F.lit(0.0), F.least(v(p, "x2"), v(q, "x2")) - F.greatest(v(p, "x1"), v(q, "x1"))) * F.greatest(F.lit(0.0), F.least(v(p, "y2"), v(q, "y2")) - F.greatest(v(p, "y1"), v(q, "y1")))
    union = (v(p, "x2") - v(p, "x1")) * (v(p, "y2") - v(p, "y1")) + (v(q, "x2") - v(q, "x1")) * (v(q, "y2") - v(q, "y1")) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def matched_runs(pairs: DataFrame) -> DataFrame:
    """(scene, a, b, d): candidate pairs (within the distance) matched one to one; a in order, each takes its nearest free b.

    In a round an a takes its nearest free b if no lesser a that is still open could take that b; then it is as the greedy order has it.
    """
    open_, found = written(pairs.select("scene", "a", "b", "d")), []
    while not open_.isEmpty():
        wish = open_.groupBy("scene", "a").agg(F.min(F.struct("d", "b")).alias("w")).select("scene", "a", F.col("w.b").alias("b"), F.col("w.d").alias("d"))
        first = open_.groupBy("scene", "b").agg(F.min("a").alias("a"))
        now = written(wish.join(first, ["scene", "a", "b"]))
        found.append(now)
        left = open_.join(now.select("scene", "a"), ["scene", "a"], "left_anti").join(now.select("scene", "b"), ["scene", "b"], "left_anti")
        last, open_ = open_, written(left)
        discard(last)
    out = found[0] if found else open_
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("scene", "a", "b", "d")


def suppressed_loops(pairs: DataFrame, apart: int = 10) -> DataFrame:
    """(run, i, j, s): loop candidates, best first, without those whose both ends lie near a kept one's."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for r in pdf.sort_values(["s", "i", "j"], ascending=[False, True, True]).itertuples(index=False):
            if all(abs(r.i - k.i) > apart or abs(r.j - k.j) > apart for k in rows):
                rows.append(r)
        return pd.DataFrame(rows, columns=pdf.columns)

    return pairs.groupBy("run").applyInPandas(keep, pairs.schema)


def constrained_merge(edges: DataFrame) -> DataFrame:
    """(component, node, root): unions in order of the edges (component, a, b, forbidden), refusing those that would join a forbidden pair.

    ``edges`` holds a component's wished unions (forbidden false) and its cannot-links (forbidden true);
    components come from the unconstrained graph, so different ones never touch.  The root is the least member.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}
        members: dict[int, set[int]] = {}
        enemies: dict[int, set[int]] = {}
        for n in pd.unique(pdf[["a", "b"]].to_numpy().ravel()).tolist():
            root[n], members[n], enemies[n] = n, {n}, set()
        for a, b in pdf.loc[pdf["forbidden"], ["a", "b"]].itertuples(index=False):
            enemies[a].add(b)
            enemies[b].add(a)
        for a, b in pdf.loc[~pdf["forbidden"]].sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
            x, y = sorted((root[a], root[b]))
            if x == y or enemies[x] & members[y]:
                continue
            members[x] |= members.pop(y)
            enemies[x] |= enemies.pop(y)
            for n in members[x]:
                root[n] = x
        return pd.DataFrame([(pdf["component"].iloc[0], n, r) for n, r in root.items()], columns=["component", "node", "root"])

    return edges.groupBy("component").applyInPandas(merge, "component long, node long, root long")


def merged_within(nodes: DataFrame, radius: float) -> DataFrame:
    """(component, node, root) as ``constrained_merge`` gives for all pairs at most ``radius`` apart, which aren't formed.

    ``nodes``: component, node (long), x, y, z, and mark (long): pairs within the radius that have one mark must not be joined, null forbids nothing.
    As each union depends on all before it, a component is one task; it holds the component's nodes and forbidden pairs, and looks for a node's
    neighbours through a grid when its turn comes.  Nodes without a neighbour are left out.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = np.floor(pdf[["x", "y", "z"]].to_numpy(np.float64) / radius).astype(np.int64)
        pdf = pdf.iloc[np.lexsort(cell.T[::-1])]
        cell = np.floor(pdf[["x", "y", "z"]].to_numpy(np.float64) / radius).astype(np.int64)
        names, of = np.unique(pdf["node"].to_numpy(np.int64), return_inverse=True)
        places = np.ascontiguousarray(pdf[["x", "y", "z"]].to_numpy(np.float64).T)
        marks, marked = pdf["mark"].fillna(0).to_numpy(np.int64), pdf["mark"].notna().to_numpy()
        # a column of cells along z is one run of rows, so a place's surroundings are nine slices of three cells
        runs: dict[tuple[int, int], tuple[int, int]] = {}
        start = np.flatnonzero(np.r_[True, (np.diff(cell[:, :2], axis=0) != 0).any(1)])
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(cell)], strict=True):
            runs[tuple(cell[lo, :2].tolist())] = lo, hi
        rows_of = np.argsort(of, kind="stable")
        first = np.searchsorted(of[rows_of], np.arange(len(names) + 1))

        def around(i: int) -> tuple[np.ndarray, np.ndarray]:
            """The neighbours of a node by their numbers, and whether they are forbidden."""
            out, bad = [], []
            for row in rows_of[first[i] : first[i + 1]].tolist():
                x, y, z = cell[row].tolist()
                parts = []
                for u in (x - 1, x, x + 1):
                    for v in (y - 1, y, y + 1):
                        if (run := runs.get((u, v))) is not None:
                            lo, hi = run
                            a, b = np.searchsorted(cell[lo:hi, 2], (z - 1, z + 2))
                            parts.append(slice(lo + a, lo + b))
                for p in parts:
                    d = places[:, p] - places[:, row, None]
                    near = np.flatnonzero(np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= radius) + p.start
                    near = near[of[near] != i]
                    out.append(of[near])
                    bad.append((marks[near] == marks[row]) & marked[near] & marked[row])
            return np.concatenate(out), np.concatenate(bad)

        foes = []
        for i in range(len(names)):
            other, bad = around(i)
            foes.append(np.unique(other[bad]).astype(np.int32))
        label = np.arange(len(names))
        members: dict[int, list[int]] = {}
        against: dict[int, set[int]] = {}  # clusters that a cluster of several nodes can't be joined with

        def enemies(x: int) -> set[int]:
            return against[x] if x in against else set(label[foes[x]].tolist())

        for i in range(len(names)):
            other, bad = around(i)
            other = np.unique(other[~bad & (other > i)])
            found, at = np.unique(label[other], return_index=True)
            for y in found[np.argsort(at)].tolist():
                x = int(label[i])
                if x == y or (y in against[x] if x in against else x in enemies(y)):
                    continue
                if len(members.get(x, ())) < len(members.get(y, ())):
                    x, y = y, x
                theirs, moved = enemies(y), members.pop(y, [y])
                against[x] = enemies(x) | theirs
                against.pop(y, None)
                for w in theirs:
                    if w in against:
                        against[w].discard(y)
                        against[w].add(x)
                members.setdefault(x, [x]).extend(moved)
                label[moved] = x
        least = np.full(len(names), len(names))
        np.minimum.at(least, label, np.arange(len(names)))
        return pd.DataFrame({"component": pdf["component"].iloc[0], "node": names, "root": names[least[label]]})

    several = nodes.groupBy("component").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a < _b").select("component")
    return nodes.join(several, "component").groupBy("component").applyInPandas(merge, "component long, node long, root long")


def diverse_views(views: DataFrame, angle: float = 30.0, nearer: float = 0.75, most: int = 256) -> DataFrame:
    """(object, view): the views (object, view, dx dy dz: from the object to the camera) that stay, taken in order.

    A view is added if its direction is more than ``angle`` degrees from all kept ones; else it takes the place of the one most like it if it is
    much nearer.  Only the last ``most`` stay.  An object's views are one group.
    """
    least = math.cos(math.radians(angle))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, np.ndarray, float]] = []
        for r in pdf.sort_values("view").itertuples(index=False):
            v = np.array([r.dx, r.dy, r.dz])
            d = float(np.linalg.norm(v))
            if not np.isfinite(d) or d <= 1e-9:
                continue
            cos = [float(k[1] @ v) / d for k in kept]
            best = int(np.argmax(cos)) if cos else -1
            if best < 0 or cos[best] < least:
                kept = [*kept, (r.view, v / d, d)][-most:]
            elif d < nearer * kept[best][2]:
                kept[best] = (r.view, v / d, d)
        return pd.DataFrame({"object": pdf["object"].iloc[0], "view": [k[0] for k in kept]}, columns=["object", "view"])

    return views.groupBy("object").applyInPandas(fold, "object long, view long")
