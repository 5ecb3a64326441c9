"""Scalar expressions over positions, covariances, boxes, scores and voxels; all are JVM-side Columns.

Arguments are Columns or column names; a "vec" is a tuple of three of them, a "box" of six (lows, then highs).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str
Vec = Sequence[Col]


def c(x: Col | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def gaussian(d: Col, sigma: float) -> Column:
    return F.exp(-c(d) * c(d) / F.lit(2.0 * sigma * sigma))


def sigmoid(v: Col, center: float = 0.0, temperature: float = 1.0) -> Column:
    t = (c(v) - F.lit(center)) / F.lit(temperature)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), t))))


def t_norm(scores: Col) -> Column:
    """Product of an array of scores."""
    return F.aggregate(c(scores), F.lit(1.0), lambda a, s: a * s)


def t_conorm(scores: Col) -> Column:
    return F.aggregate(c(scores), F.lit(0.0), lambda a, s: a + s - a * s)


def t_norm_weighted(scores: Col, weights: Col) -> Column:
    """Product of powers; 0 as soon as a score is not positive."""
    pairs = F.arrays_zip(c(scores).alias("s"), c(weights).alias("w"))
    return F.aggregate(pairs, F.lit(1.0), lambda a, p: F.when(p["s"] <= 0, F.lit(0.0)).otherwise(a * F.pow(p["s"], p["w"])))


def unit_score(raw: Col) -> Column:
    """A score of 0..100 as 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(raw) / 100))


def clamp_probability(p: Col, eps: float = 1e-6) -> Column:
    finite = ~(c(p).isNull() | F.isnan(c(p)) | (F.abs(c(p)) == F.lit(float("inf"))))
    return F.when(finite, F.greatest(F.lit(eps), F.least(F.lit(1 - eps), c(p)))).otherwise(F.lit(eps))


def logistic(x: Col, intercept: float, coef: float) -> Column:
    t = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(intercept) + F.lit(coef) * c(x)))
    return 1 / (1 + F.exp(-t))


def by_bins(x: Col, bins: Sequence[tuple[float, float, float]], otherwise: Col | None = None) -> Column:
    """Probability of the first bin (low, high, probability) that holds x, ends included."""
    out = c(otherwise) if otherwise is not None else c(x)
    for low, high, p in reversed(bins):
        out = F.when((c(x) >= low) & (c(x) <= high), F.lit(p)).otherwise(out)
    return out


def logprob(probabilities: Sequence[Column]) -> Column:
    total = sum((F.log(clamp_probability(p)) for p in probabilities[1:]), F.log(clamp_probability(probabilities[0])))
    return F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(0.0), total)))


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(sum(((c(p) - c(q)) * (c(p) - c(q)) for p, q in zip(a[1:], b[1:], strict=True)), (c(a[0]) - c(b[0])) * (c(a[0]) - c(b[0]))))


def horizontal(a: Vec, b: Vec, axis: int = 2) -> Column:
    i, j = (k for k in range(3) if k != axis)
    return F.sqrt((c(a[i]) - c(b[i])) * (c(a[i]) - c(b[i])) + (c(a[j]) - c(b[j])) * (c(a[j]) - c(b[j])))


def height(a: Vec, b: Vec, axis: int = 2) -> Column:
    return c(a[axis]) - c(b[axis])


def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Col) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Col, b: Col) -> Column:
    """Null if the lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(c(a)) == F.size(c(b))) & (n > 0), dot(a, b) / n)


def normalized(a: Col, eps: float = 1e-12) -> Column:
    return F.transform(c(a), lambda v: v / F.greatest(norm(a), F.lit(eps)))


def det3(s: Vec) -> Column:
    """Determinant of a packed symmetric matrix (xx, xy, xz, yy, yz, zz)."""
    xx, xy, xz, yy, yz, zz = map(c, s)
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def quadratic_inverse(s: Vec, d: Vec) -> Column:
    """d' S^-1 d by the adjugate."""
    xx, xy, xz, yy, yz, zz = map(c, s)
    a, b, e = map(c, d)
    adj = (yy * zz - yz * yz) * a * a + (xx * zz - xz * xz) * b * b + (xx * yy - xy * xy) * e * e + 2 * ((xz * yz - xy * zz) * a * b + (xy * yz - xz * yy) * a * e + (xy * xz - xx * yz) * b * e)
    return adj / det3(s)


def hellinger2(mean1: Vec, cov1: Vec, mean2: Vec, cov2: Vec, invalid: float = 1.0) -> Column:
    """Squared Hellinger distance of two Gaussians; ``invalid`` where a covariance isn't positive."""
    both = [(c(p) + c(q)) / 2 for p, q in zip(cov1, cov2, strict=True)]
    delta = [c(p) - c(q) for p, q in zip(mean1, mean2, strict=True)]
    d1, d2, d = det3(cov1), det3(cov2), det3(both)
    bc = F.exp(F.log(d1) / 4 + F.log(d2) / 4 - F.log(d) / 2 - quadratic_inverse(both, delta) / 8)
    return F.when((d1 > 0) & (d2 > 0) & (d > 0), 1 - bc).otherwise(F.lit(invalid))


def mahalanobis2(point: Vec, mean: Vec, cov: Vec, ridge: float = 1e-4) -> Column:
    s = [c(v) + (F.lit(ridge) if i in (0, 3, 5) else 0) for i, v in enumerate(cov)]
    return quadratic_inverse(s, [c(p) - c(m) for p, m in zip(point, mean, strict=True)])


def rotated(r: Sequence[Col], p: Vec, t: Vec = (0.0, 0.0, 0.0)) -> list[Column]:
    """R p + t; r row by row."""
    r, p, t = [c(v) for v in r], [c(v) for v in p], [c(v) for v in t]
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def rotated_cov(r: Sequence[Col], s: Vec) -> list[Column]:
    """R S R', packed."""
    r = [c(v) for v in r]
    xx, xy, xz, yy, yz, zz = map(c, s)
    full = [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]
    return [sum((r[3 * i + k] * full[k][m] * r[3 * j + m] for k in range(3) for m in range(3)), F.lit(0.0)) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def quaternion_rotation(qx: Col, qy: Col, qz: Col, qw: Col) -> list[Column]:
    x, y, z, w = c(qx), c(qy), c(qz), c(qw)
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def inverse_rigid(r: Sequence[Col], t: Vec) -> tuple[list[Column], list[Column]]:
    """(R', -R' t) of a rigid motion."""
    back = [c(r[3 * j + i]) for i in range(3) for j in range(3)]
    return back, [-v for v in rotated(back, t)]


def pinhole(p: Vec, fx: float, fy: float, cx: float, cy: float, near: float = 0.01) -> tuple[Column, Column]:
    """Pixel (u, v), rounded half to even; null at or before ``near``."""
    x, y, z = map(c, p)
    return F.when(z > near, F.rint(x / z * fx + cx)).cast("long"), F.when(z > near, F.rint(y / z * fy + cy)).cast("long")


def lon_lat(p: Vec) -> tuple[Column, Column]:
    """Longitude and latitude of a ray with y down and z ahead."""
    x, y, z = map(c, p)
    return F.atan2(x, z), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -y / F.sqrt(x * x + y * y + z * z))))


VOXEL_BITS, VOXEL_BIAS = 21, 1 << 20


def voxel(p: Col, size: float, level: int = 0) -> Column:
    return F.floor(c(p) / F.lit(size * (1 << level))).cast("long")


def voxel_key(q: Vec) -> Column:
    """Three biased 21-bit coordinates in one long."""
    x, y, z = (c(v).cast("long") + VOXEL_BIAS for v in q)
    return F.shiftleft(x, 2 * VOXEL_BITS).bitwiseOR(F.shiftleft(y, VOXEL_BITS)).bitwiseOR(z)


def voxel_of_key(key: Col) -> list[Column]:
    mask = (1 << VOXEL_BITS) - 1
    return [F.shiftright(c(key), s).bitwiseAND(F.lit(mask)) - VOXEL_BIAS for s in (2 * VOXEL_BITS, VOXEL_BITS, 0)]


def promoted_key(key: Col, levels: int) -> Column:
    return voxel_key([F.shiftright(v, levels) for v in voxel_of_key(key)])


def voxel_center(q: Col, size: float) -> Column:
    return c(q) * F.lit(size) + F.lit(size / 2)


def gaussian_box(mean: Vec, variance: Vec, k: float = 2.5, floor: float = 1e-4) -> list[Column]:
    half = [k * F.sqrt(F.greatest(c(v), F.lit(floor))) for v in variance]
    return [c(m) - h for m, h in zip(mean, half, strict=True)] + [c(m) + h for m, h in zip(mean, half, strict=True)]


def box_volume(box: Vec) -> Column:
    a, b, d = (F.greatest(F.lit(0.0), c(box[i + 3]) - c(box[i])) for i in range(3))
    return a * b * d


def box_iou(p: Vec, q: Vec) -> Column:
    """0 if disjoint or degenerate."""
    both = box_volume([F.greatest(c(p[i]), c(q[i])) for i in range(3)] + [F.least(c(p[i]), c(q[i])) for i in range(3, 6)])
    union = box_volume(p) + box_volume(q) - both
    return F.when((union > 0) & (both > 0), both / union).otherwise(F.lit(0.0))


def turned_box(center: Vec, size: Vec, heading: Col) -> list[Column]:
    """Axis-aligned box around one turned about the vertical axis (closed form of its eight corners)."""
    co, si = F.abs(F.cos(c(heading))), F.abs(F.sin(c(heading)))
    half = [(c(size[0]) * co + c(size[1]) * si) / 2, (c(size[0]) * si + c(size[1]) * co) / 2, c(size[2]) / 2]
    return [c(m) - h for m, h in zip(center, half, strict=True)] + [c(m) + h for m, h in zip(center, half, strict=True)]


def view_quality(score: Col, pixels: Col) -> Column:
    return c(score) * F.sqrt(F.greatest(F.lit(1.0), c(pixels).cast("double")))


def vote_weight(score: Col, pixels: Col) -> Column:
    return c(score) * F.sqrt(c(pixels).cast("double") / 500)


def padded_crop(x1: Col, y1: Col, x2: Col, y2: Col, width: int, height_: int, share: float = 0.08, least: float = 8.0) -> list[Column]:
    """A box grown by 8 % or 8 pixels, inside the image, at least one pixel."""
    px, py = (F.greatest(F.lit(least), (c(b) - c(a)) * share) for a, b in ((x1, x2), (y1, y2)))
    lo = [F.greatest(F.lit(0), F.floor(c(a) - p)).cast("long") for a, p in ((x1, px), (y1, py))]
    hi = [F.least(F.lit(n), F.ceil(c(b) + p)).cast("long") for b, p, n in ((x2, px, width), (y2, py, height_))]
    return [*lo, *[F.greatest(h, m + 1) for h, m in zip(hi, lo, strict=True)]]


def reciprocal_rank(rank: Col, k: float = 5.0) -> Column:
    return F.coalesce(1 / (F.lit(k) + c(rank)), F.lit(0.0))


def rerank_score(v: Col) -> Column:
    """[0, 1] as it is; [-1, 0) halved and moved up; else a sigmoid; not finite: 0."""
    x = c(v)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).when((x >= 0) & (x <= 1), x).when((x >= -1) & (x < 0), (x + 1) / 2).otherwise(sigmoid(x))


def image_id(keyframe: Col, face: Col) -> Column:
    return (c(keyframe) * 4 + c(face)).cast("long")


def hue_color(index: Col) -> Column:
    """Hex colour whose hue steps by the golden ratio."""
    h = (c(index).cast("double") * 0.618033988749895) % 1.0 * 6
    part = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs((h + n) % 6 - 3) - 1))
    two = lambda x: F.lpad(F.lower(F.hex(F.floor(x * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(part(0)), two(part(4)), two(part(2)))


def ray_distance(z: Col, u: Col, v: Col, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Planar depth as distance along the pixel's ray."""
    a, b = (c(u) - cx) / fx, (c(v) - cy) / fy
    return c(z) * F.sqrt(a * a + b * b + 1)


def depth_meters(raw: Col, scale: float = 1e-3, far: float | None = None) -> Column:
    """Metric depth; not a number, negative or (with ``far``) too far: 0."""
    d = c(raw).cast("double") * scale
    bad = d.isNull() | F.isnan(d) | (d < 0)
    if far is not None:
        bad |= d > far
    return F.when(bad, F.lit(0.0)).otherwise(d)


def symmetric_eigenvalues(s: Vec) -> list[Column]:
    """Eigenvalues (greatest first) of a packed symmetric matrix, in the trigonometric form."""
    xx, xy, xz, yy, yz, zz = map(c, s)
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    spread = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6)
    safe = F.greatest(spread, F.lit(1e-300))
    half = det3([(xx - mean) / safe, xy / safe, xz / safe, (yy - mean) / safe, yz / safe, (zz - mean) / safe]) / 2
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    first, last = mean + 2 * spread * F.cos(angle), mean + 2 * spread * F.cos(angle + F.lit(2 * 3.141592653589793 / 3))
    return [first, 3 * mean - first - last, last]


def eigen_floored(s: Vec, floor: float) -> list[Column]:
    """A packed symmetric matrix whose least eigenvalue is raised to ``floor`` by adding to the diagonal, only where it must be."""
    lift = F.greatest(F.lit(0.0), F.lit(floor) - symmetric_eigenvalues(s)[2])
    return [c(v) + (lift if i in (0, 3, 5) else 0) for i, v in enumerate(s)]


def bbox_edge_score(x1: Col, y1: Col, x2: Col, y2: Col, width: float, height_: float) -> Column:
    """1 where a box is well inside the image, 0 at its border."""
    margin = F.least(c(x1), c(y1), F.lit(float(width)) - c(x2), F.lit(float(height_)) - c(y2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin / max(16.0, 0.05 * min(width, height_))))


def edge_touch(x1: Col, y1: Col, x2: Col, y2: Col, width: int, height_: int) -> Column:
    """The share of a box's four edges that touch the image's border."""
    hits = [c(x1) <= 1, c(y1) <= 1, c(x2) >= width - 1, c(y2) >= height_ - 1]
    return sum((F.when(h, 0.25).otherwise(0.0) for h in hits[1:]), F.when(hits[0], 0.25).otherwise(0.0))


def frustum_view(s: Vec, a: Vec, name: str) -> tuple[Column, Column]:
    """(score, quality) of a view-dependent relation in one camera's frame (x right, y down, z ahead); quality 0 where either is out of view."""
    zs, za = c(s[2]), c(a[2])
    us, vs, ua, va = c(s[0]) / zs, c(s[1]) / zs, c(a[0]) / za, c(a[1]) / za
    seen = (zs > 0.3) & (za > 0.3) & (zs < 15) & (za < 15) & (F.abs(us) < 0.85) & (F.abs(ua) < 0.85) & (F.abs(vs) < 0.7) & (F.abs(va) < 0.7)
    gap, t = {"LeftOf": (ua - us, 0.08), "RightOf": (us - ua, 0.08), "InFrontOf": (za - zs, 0.30), "Behind": (zs - za, 0.30)}[name]
    score = 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), -gap / t))))
    quality = F.exp(-(us * us + ua * ua + vs * vs + va * va)) / (1 + F.least(zs, za) / 4)
    return F.when(seen, score), F.coalesce(F.when(seen, quality), F.lit(0.0))


def vertical_axis(named: Sequence[Col], refs: Col) -> Column:
    """0, 1 or 2: by the first name that tells, else y if one of the first 16 image references is of a y-up source, else z."""

    def told(x: Col) -> Column:
        t = F.lower(F.trim(c(x)))
        return (
            F.when(t.isin("0", "x", "+x", "-x", "x-up", "x_up"), 0)
            .when(t.isin("1", "y", "+y", "-y") | t.rlike("y-up|y_up|habitat|hm3d"), 1)
            .when(t.isin("2", "z", "+z", "-z") | t.rlike("z-up|z_up|scannet"), 2)
        )

    y_up = F.exists(F.slice(c(refs), 1, 16), lambda r: F.lower(r).rlike("hm3d|iref_vla|rendered_trajectory"))
    return F.coalesce(*[told(x) for x in named], F.when(y_up, 1), F.lit(2))


def relative_pose(ra: Sequence[Col], ta: Vec, rb: Sequence[Col], tb: Vec) -> tuple[list[Column], list[Column]]:
    """(R, t) of pose b seen from pose a: Ra' Rb and Ra' (tb - ta)."""
    back, shift = inverse_rigid(ra, ta)
    b = [c(v) for v in rb]
    turn = [back[3 * i] * b[j] + back[3 * i + 1] * b[3 + j] + back[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]
    return turn, rotated(back, tb, shift)


def swapped_box(box: Vec) -> list[Column]:
    """A box in the frame (X, Z, -Y)."""
    x1, y1, z1, x2, y2, z2 = map(c, box)
    return [x1, z1, -y2, x2, z2, -y1]
