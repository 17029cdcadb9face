"""Scalar and array projections as Column -> Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- coordinates ----------------------------------------------------------------------------------------------------


def sph2cart(r: Col, theta: Col, phi: Col) -> tuple[Column, Column, Column]:
    r, theta, phi = map(_c, (r, theta, phi))
    return r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)


def cart2sph(x: Col, y: Col, z: Col) -> tuple[Column, Column, Column]:
    """r, theta from the pole, phi in [0, 2 pi)."""
    x, y, z = map(_c, (x, y, z))
    angle = F.atan2(y, x)
    return F.sqrt(x * x + y * y + z * z), F.atan2(F.sqrt(x * x + y * y), z), F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def sph2latlon(theta: Col, phi: Col) -> tuple[Column, Column]:
    return (F.lit(math.pi / 2) - _c(theta)) * (180 / math.pi), _c(phi) * (180 / math.pi)


def latlon2sph(lat: Col, lon: Col) -> tuple[Column, Column]:
    return F.lit(math.pi / 2) - _c(lat) * (math.pi / 180), _c(lon) * (math.pi / 180)


# ---- compression and amplitudes -------------------------------------------------------------------------------------


def log_offset(x: Col, offset: float = 1e-10) -> Column:
    """ln(x + offset); with offset 0 a zero gives null."""
    return F.log(_c(x) + F.lit(float(offset)))


def amplitude(power: Col, area: Col | None = None, mode: str = "root_over_area") -> Column:
    """Normalised band power. mode: root, root_over_area, or root_of_root_over_area. Areas of zero give null."""
    root = F.sqrt(_c(power))
    if mode == "root":
        return root
    if area is None:
        raise ValueError(f"mode {mode!r} needs the area")
    share = F.try_divide(root, _c(area))
    if mode == "root_over_area":
        return share
    if mode == "root_of_root_over_area":
        return F.sqrt(share)
    raise ValueError(f"unknown mode {mode!r}: root, root_over_area, root_of_root_over_area")


def time_grid(n: int = 100, decades: float = 2.0) -> Column:
    """n diffusion times from 1 to 10^decades, evenly spaced on a logarithmic scale, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.pow(F.lit(10.0), j.cast("double") * decades / (n - 1)))


def soft_assignment(distance: Col, sigma: Col) -> Column:
    d, s = _c(distance), _c(sigma)
    return F.exp(-(d * d) / (2 * s * s))


def inverse_soft_assignment(encoded: Col, sigma: Col) -> Column:
    return _c(sigma) * F.sqrt(-2 * F.log(F.greatest(_c(encoded), F.lit(1e-10))))


def hashed_uniform(seed: int, *key: Col) -> Column:
    """A number between 0 and 1, both excluded, from the MD5 of seed and key: the same one wherever and whenever it is computed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(_c(k).cast("string") for k in key)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def hashed_normal(seed: int, *key: Col) -> Column:
    """A standard normal deviate from seed and key: Box and Muller's transform of two hashed numbers."""
    return F.sqrt(-2.0 * F.log(hashed_uniform(seed, *key, F.lit("r")))) * F.cos(2 * math.pi * hashed_uniform(seed, *key, F.lit("a")))


def noised(x: Col, level: float = 1e-10, seed: int | None = None, key: Col | None = None) -> Column:
    """x, or with a seed x plus Gaussian noise: by a hash of the key, the same on any partitioning; ties are otherwise broken by id."""
    if seed is None:
        return _c(x)
    return _c(x) + (F.randn(seed) if key is None else hashed_normal(seed, key)) * level


# ---- degrees --------------------------------------------------------------------------------------------------------


def degree(mode: Col) -> Column:
    """Degree l of mode m: l^2 <= m < (l + 1)^2."""
    return F.floor(F.sqrt(_c(mode).cast("double"))).cast("int")


def degree_weight(mode: Col) -> Column:
    return F.lit(1.0) / (2 * degree(mode) + 1)


EULER = 0.5772156649015329


def digamma_table(n: int) -> list[float]:
    """psi(1) .. psi(n) for whole numbers: the harmonic numbers less Euler's constant."""
    out, total = [], -EULER
    for i in range(1, n + 1):
        out.append(total)
        total += 1.0 / i
    return out


def digamma(n: Col, base: float = math.e) -> Column:
    """psi of a positive whole number, over ln(base): exact sum below 30, asymptotic series (error below 1e-15) from there."""
    x = _c(n).cast("double")
    low = F.aggregate(F.sequence(F.lit(1), F.greatest(_c(n).cast("int"), F.lit(1))), F.lit(-EULER), lambda s, i: s + F.when(i < _c(n), F.lit(1.0) / i).otherwise(0.0))
    high = F.log(x) - 0.5 / x - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6)) + 1 / (240 * F.pow(x, 8))
    return F.when(x < 30, low).otherwise(high) / math.log(base)


# ---- identifiers ----------------------------------------------------------------------------------------------------


def organoid_id(timepoint: Col, well: Col, label: Col) -> Column:
    return F.concat_ws("_", _c(timepoint), _c(well), _c(label).cast("string"))


def parse_organoid_id(uid: Col) -> tuple[Column, Column, Column]:
    """timepoint, well, label of an id; labels that are no whole number give null."""
    parts = F.split(_c(uid), "_")
    return F.get(parts, 0), F.get(parts, 1), F.get(parts, 2).try_cast("int")


def fold_timepoint(timepoint: Col) -> Column:
    """Characters four to six: `day4p5` and `day4p5-more` fold into `4p5`."""
    return F.substring(_c(timepoint), 4, 3)


def well_parts(well: Col) -> tuple[Column, Column]:
    """Row letter and column of a well."""
    return F.substring(_c(well), 1, 1), F.substring(_c(well), 2, 100)


def is_field(name: Col, suffix: str = "percentile95") -> Column:
    return F.endswith(_c(name), F.lit(suffix))


def field_prefix(name: Col, n: int = 5) -> Column:
    return F.substring(_c(name), 1, n)


def first_word(label: Col) -> Column:
    return F.get(F.split(_c(label), " "), 0)


def channel_name(t: Col, form: str = "hks-%s") -> Column:
    return F.format_string(form, _c(t).cast("string"))


def drop_first(values: Col, n: int = 3) -> Column:
    """All but the first n entries."""
    v = _c(values)
    return F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0)))


# ---- vectors --------------------------------------------------------------------------------------------------------


def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Col, b: Col) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def chebyshev(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: F.greatest(s, v))


def heat_kernel(lambdas: Col, phi: Col, times: Col) -> Column:
    """Sum over modes of exp(-lambda t) phi^2 for each time, as an array."""
    return F.transform(_c(times), lambda t: F.aggregate(F.zip_with(_c(lambdas), _c(phi), lambda v, p: F.exp(-v * t) * p * p), F.lit(0.0), lambda s, v: s + v))


def right_of_path(disp: Col, forward: Col, back: Col, normal: Col, tolerance: float = 1e-4) -> Column:
    """Whether a displacement lies right of a path at one of its points; all are structs x, y, z.

    Seen along the normal, one turns from the way back; what is met before the way forward, and not within the tolerance of the
    way back, is on that side.
    """
    d, f, k, n = map(_c, (disp, forward, back, normal))

    def inner(a: Column, b: Column) -> Column:
        return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]

    def along(v: Column) -> Column:
        """How far v goes forward, on the scale of `aside`."""
        return inner(v, f) * F.sqrt(inner(n, n) - inner(f, n) * inner(f, n) / inner(f, f))

    def aside(v: Column) -> Column:
        """The volume of v, the way forward and the normal."""
        return v["x"] * (f["y"] * n["z"] - f["z"] * n["y"]) + v["y"] * (f["z"] * n["x"] - f["x"] * n["z"]) + v["z"] * (f["x"] * n["y"] - f["y"] * n["x"])

    def turn(v: Column) -> Column:
        """From the way back to v, about the normal."""
        t = F.atan2(along(k) * aside(v) - aside(k) * along(v), along(k) * along(v) + aside(k) * aside(v))
        return F.when(t < 0, t + 2 * math.pi).otherwise(t)

    return (turn(d) > tolerance) & (turn(d) < turn(f))


# ---- spherical harmonics --------------------------------------------------------------------------------------------


def legendre_column(x: Col, m: int, lmax: int) -> Column:
    """Normalised associated functions of order m at x = sin(latitude), an array over the degrees m .. lmax: upward recurrence in a fold."""
    x = _c(x)
    scale = math.prod(math.sqrt((2 * k + 1) / (2 * k)) for k in range(1, m + 1)) * (math.sqrt(2) if m else 1.0)
    first = F.pow(F.greatest(F.lit(0.0), 1 - x * x), F.lit(m / 2)) * scale if m else x * 0 + 1.0
    a = [math.sqrt((2 * l + 1) * (2 * l - 1) / ((l - m) * (l + m))) for l in range(m + 1, lmax + 1)]
    b = [math.sqrt((2 * l + 1) * (l + m - 1) * (l - m - 1) / ((l - m) * (l + m) * (2 * l - 3))) if l > m + 1 else 0.0 for l in range(m + 1, lmax + 1)]
    if not a:
        return F.array(first)
    steps = F.array(*(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b")) for p, q in zip(a, b, strict=True)))

    def up(s: Column, c: Column) -> Column:
        now = c["a"] * x * F.element_at(s, -1) - c["b"] * F.coalesce(F.get(s, F.size(s) - 2), F.lit(0.0))
        return F.concat(s, F.array(now))

    return F.aggregate(steps, F.array(first), up)


def harmonic_names(lmax: int) -> list[tuple[int, int, int]]:
    """(sign, l, m) of the functions in order: sign 0 cosine, 1 sine."""
    return [(sign, l, m) for l in range(lmax + 1) for m in range(l + 1) for sign in ((0, 1) if m else (0,))]
