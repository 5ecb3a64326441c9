"""Spatial and semantic predicates of the relational query, as score Columns of a subject and an anchor.

Null means undecidable.  Positions are tuples (x, y, z) of Columns or names; z is up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomap.functions.math import Col, Vec, c, distance, gaussian, height, horizontal, sigmoid


def near(s: Vec, a: Vec, most: float = 5.0, sigma: float = 0.5) -> Column:
    d = distance(s, a)
    return F.when(d > most, 0.0).otherwise(gaussian(d, sigma))


def near_linear(s: Vec, a: Vec, most: float = 5.0, scale: float = 2.0) -> Column:
    """The joint method's form."""
    d = distance(s, a)
    return F.when(d > most, 0.0).otherwise(F.exp(-d / scale))


def on(s: Vec, a: Vec) -> Column:
    h, dz = horizontal(s, a), height(s, a)
    fit = F.least(F.lit(1.0), sigmoid(dz, 0.0, 0.1) * sigmoid(F.lit(0.5) - dz, 0.0, 0.1))
    return F.when((h > 1.0) | (dz < -0.2) | (dz > 0.8), 0.0).otherwise(gaussian(h, 0.7) * fit)


def above(s: Vec, a: Vec) -> Column:
    return _over(horizontal(s, a), height(s, a))


def below(s: Vec, a: Vec) -> Column:
    return _over(horizontal(s, a), -height(s, a))


def _over(h: Column, dz: Column) -> Column:
    return F.when((dz < -0.1) | (h > 2.0), 0.0).otherwise(sigmoid(dz, 0.2, 0.15) * gaussian(h, 1.0))


def next_to(s: Vec, a: Vec) -> Column:
    h = horizontal(s, a)
    return F.when((h > 2.0) | (F.abs(height(s, a)) > 1.0), 0.0).otherwise(gaussian(h, 1.0))


def between(s: Vec, a: Vec, b: Vec, clamped: bool = False) -> Column:
    """Along the horizontal line from a to b; beyond its ends the plain form goes below 0, the joint method's is clamped."""
    dx, dy = c(b[0]) - c(a[0]), c(b[1]) - c(a[1])
    px, py = c(s[0]) - c(a[0]), c(s[1]) - c(a[1])
    length2 = dx * dx + dy * dy
    t = (px * dx + py * dy) / length2
    ex, ey = px - t * dx, py - t * dy
    score = (1 - 2 * F.abs(t - 0.5)) * gaussian(F.sqrt(ex * ex + ey * ey), 1.0)
    score = F.greatest(score, F.lit(0.0)) if clamped else score
    return F.when(F.sqrt(length2) < 0.01, 0.0).otherwise(F.when((t < -0.1) | (t > 1.1), 0.0).otherwise(score))


def inside(s: Vec, a: Vec, variance: Vec | None = None) -> Column:
    """By the distance to the anchor's box (2.5 deviations and 10 cm); without a covariance by the distance to its centre."""
    if variance is None:
        return gaussian(distance(s, a), 0.75)
    total = F.lit(0.0)
    for p, m, v in zip(s, a, variance, strict=True):
        out = F.greatest(F.lit(0.0), F.abs(c(p) - c(m)) - (2.5 * F.sqrt(F.greatest(c(v), F.lit(1e-6))) + 0.10))
        total = total + out * out
    d = F.sqrt(total)
    return F.when(d <= 1e-6, 1.0).otherwise(gaussian(d, 0.35))


def in_region(label: Col, wanted: Col, confidence: Col) -> Column:
    return F.when(F.lower(F.trim(c(label))) == F.lower(F.trim(c(wanted))), 1.0).when(c(confidence) > 0.7, 0.0)


def has_attribute(caption: Col, attributes: Col, wanted: Col) -> Column:
    low = F.lower(c(wanted))
    return F.when(F.lower(c(caption)).contains(low), 1.0).when(F.exists(c(attributes), lambda x: F.lower(x) == low), 1.0)


def is_category(category: Col, caption: Col, wanted: Col) -> Column:
    low = F.lower(c(wanted))
    return F.when(F.lower(c(category)) == low, 1.0).when(F.lower(c(caption)).contains(low), 0.9)


def rank_score(rank: Col, desired: int = 0) -> Column:
    """Closest and Farthest: by the (0-based) rank of the distance."""
    return 1 / (F.abs(c(rank) - desired) + 1).cast("double")


def beside(subject_u: Col, anchor_u: Col, width: float, left: bool, temperature: float = 0.03) -> Column:
    """Left or right of, in an image that shows both."""
    shift = (c(anchor_u) - c(subject_u)) / width
    return sigmoid(shift if left else -shift, 0.0, temperature)


def in_front(subject_z: Col, anchor_z: Col, front: bool = True, temperature: float = 0.30) -> Column:
    """Nearer to (or farther from) the camera; both must be before it."""
    gap = c(anchor_z) - c(subject_z)
    return F.when((c(subject_z) > 1e-6) & (c(anchor_z) > 1e-6), sigmoid(gap if front else -gap, 0.0, temperature)).otherwise(0.0)


def undecided(name: str, score: Col) -> Column:
    """Whether a costlier judge is asked, by the predicate's gate."""
    s = c(score)
    if name in ("Above", "Below"):
        return ~((s > 0.70) | (s <= 0.05))
    if name in ("Near", "NextTo"):
        return (s > 0.30) & (s < 0.70)
    if name == "InRegion":
        return ~((s == 1) | (s <= 0.05))
    return ~((s >= 0.95) | (s <= 0.05))


def geometric(scores: Col | list[Column], floor: float = 1e-6) -> Column:
    """Geometric mean of an array, each score at least ``floor``; an empty array gives 1.  A list of Columns gives the same as their array, and is compiled."""
    if isinstance(scores, list):
        total = sum((F.log(F.greatest(s, F.lit(floor))) for s in scores), F.lit(0.0))
        return F.exp(total / len(scores)) if scores else F.lit(1.0)
    a = c(scores)
    total = F.aggregate(a, F.lit(0.0), lambda t, s: t + F.log(F.greatest(s, F.lit(floor))))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.exp(total / F.size(a)))


def composed(similarity: Col, scores: Col | list[Column], weight: float) -> Column:
    return c(similarity) * ((1 - weight) + weight * geometric(scores))
