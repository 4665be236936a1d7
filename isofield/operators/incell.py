"""The surface inside one cell: multilinear coefficients, the polynomial along a ray, its real roots and the normal, all as columns.

phi inside a cell is the sum over sets k of axes of rho[k] times the local coordinates (0 to 1) of these axes; k is a bit mask like the
corner numbers of ``stencil.cells``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, KEY
from .stencil import cells

#: A leading coefficient of at most this share of the constant one counts as zero (a fixed value).
NEGLIGIBLE = 1e-10


def coefficients(corners: list[Column]) -> list[Column]:
    """rho for the corner values: by inclusion and exclusion over the corners that a set of axes spans."""
    out = []
    for k in range(len(corners)):
        terms = [(c, (k ^ c).bit_count() % 2) for c in range(len(corners)) if c & k == c]
        total = F.lit(0)
        for c, odd in terms:
            total = total - corners[c] if odd else total + corners[c]
        out.append(total)
    return out


def along_ray(rho: list[Column], origin: list[Column], direction: list[Column]) -> list[Column]:
    """Coefficients (of t to the power 0, 1, ...) of phi at origin + t * direction; one more than there are axes."""
    out = [F.lit(0.0)] * (len(origin) + 1)
    for k, r in enumerate(rho):
        term = [r]
        for b in range(len(origin)):
            if k >> b & 1:
                low = [origin[b] * c for c in term] + [F.lit(0.0)]
                high = [F.lit(0.0)] + [direction[b] * c for c in term]
                term = [x + y for x, y in zip(low, high, strict=True)]
        for power, c in enumerate(term):
            out[power] = out[power] + c
    return out


def normal(rho: list[Column], at: list[Column]) -> list[Column]:
    """Unit gradient of phi at local coordinates; zeros where the gradient is zero."""
    slope = []
    for axis in range(len(at)):
        total = F.lit(0.0)
        for k, r in enumerate(rho):
            if k >> axis & 1:
                term = r
                for b in range(len(at)):
                    if b != axis and k >> b & 1:
                        term = term * at[b]
                total = total + term
        slope.append(total)
    length = F.sqrt(sum((s * s for s in slope), F.lit(0.0)))
    return [F.when(length > 0, s / length).otherwise(0.0) for s in slope]


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _linear(c: list[Column]) -> Column:
    return F.when(F.abs(c[1]) > NEGLIGIBLE * F.abs(c[0]), F.array(-c[0] / c[1])).otherwise(F.array().cast("array<double>"))


def _quadratic(c: list[Column]) -> Column:
    under = c[1] * c[1] - 4.0 * c[0] * c[2]
    q = -0.5 * (c[1] + F.when(c[1] < 0, -F.sqrt(under)).otherwise(F.sqrt(under)))
    two = F.when(q == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array_sort(F.array(q / c[2], c[0] / q)))
    return F.when(F.abs(c[2]) <= NEGLIGIBLE * F.abs(c[0]), _linear(c)).when(under >= 0, two).otherwise(F.array().cast("array<double>"))


def _cubic(c: list[Column]) -> Column:
    def centred(m: Column) -> Column:
        a, b, d = m[0], m[1], m[2]
        return F.array(b - a * a / 3.0, 2.0 * a * a * a / 27.0 - a * b / 3.0 + d, a / 3.0)

    def solved(m: Column) -> Column:
        p, q, third = m[0], m[1], m[2]
        under = q * q / 4.0 + p * p * p / 27.0
        # three real roots (p < 0): on a circle about the centre of symmetry; else one, as the sum of two cube roots
        radius = 2.0 * F.sqrt(-p / 3.0)
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 3.0 * q / (p * radius)))) / 3.0
        three = F.array_sort(F.array(*[radius * F.cos(angle - 2.0 * pi * k / 3.0) - third for k in range(3)]))
        size = F.cbrt(F.abs(q) / 2.0 + F.sqrt(under))
        one = bound(F.when(q > 0, -size).otherwise(size), lambda u: F.array(F.when(u == 0, -third).otherwise(u - p / (3.0 * u) - third)))
        return F.when(under < 0, three).otherwise(one)

    monic = F.array(c[2] / c[3], c[1] / c[3], c[0] / c[3])
    return F.when(F.abs(c[3]) <= NEGLIGIBLE * F.abs(c[0]), _quadratic(c)).otherwise(bound(bound(monic, centred), solved))


def roots(c: list[Column]) -> Column:
    """Real roots, ascending, of a polynomial of degree 1 to 3 (coefficients from the constant up), as an array.

    A negligible leading coefficient lowers the degree. A quadratic has none or two (equal ones twice); a cubic one or three, and only its
    simple root where the other two coincide. A constant has none; null where a coefficient is null.
    """
    rule = {2: _linear, 3: _quadratic, 4: _cubic}.get(len(c))
    if rule is None:
        raise ValueError("degree must be 1, 2 or 3")
    known = lambda v: F.forall(v, lambda x: x.isNotNull())
    return bound(F.array(*[x.cast("double") for x in c]), lambda v: F.when(known(v), rule([v[i] for i in range(len(c))])))


def first_crossing(c: list[Column], low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """The least root from ``low`` to ``high`` at which the polynomial falls: where a ray enters the solid. Null if there is none."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))

    def falls(t: Column) -> Column:
        slope = F.lit(0.0)
        for power in range(len(c) - 1, 0, -1):
            slope = slope * t + power * c[power]
        return t.between(low, high) & (slope < 0)

    return F.get(F.filter(roots(c), falls), F.lit(0))


def whole_cells(points: DataFrame, axes: list[str] = AXES) -> DataFrame:
    """(layer, x, y, z, rho): cells of which every corner is held, with their coefficients as an array."""
    n = 1 << len(axes)
    c = cells(points, axes).where(F.size(F.filter("corners", lambda v: v["phi"].isNotNull())) == n)
    return c.select(*KEY, F.array(*coefficients([F.get("corners", F.lit(i))["phi"] for i in range(n)])).alias("rho"))


def entries(points: DataFrame, origin: list[Column], direction: list[Column], axes: list[str] = AXES) -> DataFrame:
    """(layer, x, y, z, t, normal): where a ray that starts at local coordinates ``origin`` of each whole cell enters the solid within it, and the
    normal there. Rays that don't are left out."""
    rho = [F.get("rho", F.lit(k)).cast("double") for k in range(1 << len(axes))]

    def spot(t: Column) -> list[Column]:
        return [o + t * d for o, d in zip(origin, direction, strict=True)]

    def within(t: Column) -> Column:
        inside = t.isNotNull()
        for s in spot(t):
            inside = inside & s.between(0.0, 1.0)
        return inside

    polynomial = F.array(*along_ray(rho, origin, direction))
    hits = bound(polynomial, lambda p: F.filter(F.array(first_crossing([p[i] for i in range(len(axes) + 1)])), within))
    found = whole_cells(points, axes).select(*KEY, "rho", F.explode(hits).alias("t"))
    return found.select(*KEY, "t", F.array(*normal(rho, spot(F.col("t")))).alias("normal"))
