"""Grids: index ranges, boundary kinds and their mapping, as column expressions.

A level set is a DataFrame with the columns layer, x, y, z (integers) and phi (in units of the grid spacing, negative inside). In two
dimensions z is the second axis and y is 0. Rows that are absent are far from the surface; their sign follows from the rows of
their column (see operators.stencil).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["layer", "x", "y", "z"]
AXES = ["x", "y", "z"]


class Boundary(Enum):
    REFLECTIVE = "REFLECTIVE"
    INFINITE = "INFINITE"
    PERIODIC = "PERIODIC"
    EXTENDED = "EXTENDED"

    @property
    def mirrors(self) -> bool:
        """Extended boundaries are mirrored like reflective ones by index arithmetic."""
        return self in (Boundary.REFLECTIVE, Boundary.EXTENDED)


@dataclass(frozen=True)
class Grid:
    """Index bounds and boundary kinds by axis (low and high side alike), and the spacing."""

    low: dict[str, int]
    high: dict[str, int]
    kind: dict[str, Boundary] = field(default_factory=dict)
    delta: float = 1.0
    open_axis: str = "z"

    def of(self, axis: str) -> Boundary:
        return self.kind.get(axis, Boundary.INFINITE)

    def wrap(self, axis: str, index: Column | str) -> Column:
        """The index inside the domain that ``index`` stands for; null beyond an infinite boundary.

        Periodic: indices repeat every high - low. Mirrored: they run back and forth with twice that period.
        """
        i = F.col(index) if isinstance(index, str) else index
        a, b = self.low[axis], self.high[axis]
        n = b - a
        if self.of(axis) is Boundary.PERIODIC:
            return (F.pmod(i - a, F.lit(n)) + a).cast("int")
        if self.of(axis).mirrors:
            m = F.pmod(i - a, F.lit(2 * n))
            return (F.when(m > n, 2 * n - m).otherwise(m) + a).cast("int")
        return F.when(i.between(a, b), i).cast("int")

    def reversed(self, axis: str, index: Column | str) -> Column:
        """Whether a direction along ``axis`` turns round at that index: in every other image of a mirrored domain."""
        i = F.col(index) if isinstance(index, str) else index
        if not self.of(axis).mirrors:
            return F.lit(False)
        a, b = self.low[axis], self.high[axis]
        return F.pmod(i - a, F.lit(2 * (b - a))) > b - a

    def position(self, axis: str, index: Column | str) -> Column:
        return (F.col(index) if isinstance(index, str) else index) * self.delta

    def inside(self) -> Column:
        """Whether a row's indices are in the domain (the open axis is unbounded)."""
        tests = [F.col(a).between(self.low[a], self.high[a]) for a in AXES if a != self.open_axis]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def axis_neighbours(points: DataFrame, reach: int = 1, axes: list[str] = AXES) -> DataFrame:
    """``points`` with one row for each neighbour along an axis up to ``reach`` away: axis, step, and its indices nx, ny, nz."""
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("step")) for a in axes for s in range(-reach, reach + 1) if s])
    out = points.withColumn("__o", F.explode(steps)).select("*", "__o.axis", "__o.step").drop("__o")
    return out.withColumns({f"n{a}": (F.col(a) + F.when(F.col("axis") == a, F.col("step")).otherwise(0)).cast("int") for a in AXES})


def box(spark, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """All index triples of a box; the range along x is dealt over the cluster, the others are exploded."""
    out = spark.range(low["x"], high["x"] + 1).select(F.col("id").cast("int").alias("x"))
    for a in ("y", "z"):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(low[a]), F.lit(high[a]))))
    return out


def quantise(phi: Column | str, bits: int, limit: float) -> Column:
    """A distance within +-``limit`` as a whole number of ``bits`` bits: round((phi / limit + 1) * (2**bits - 1) / 2)."""
    p = F.col(phi) if isinstance(phi, str) else phi
    top = (1 << bits) - 1
    return F.least(F.greatest(F.round((p / limit + 1) * top / 2), F.lit(0.0)), F.lit(float(top))).cast("bigint")


def dequantise(code: Column | str, bits: int, limit: float) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return (c * 2.0 / ((1 << bits) - 1) - 1) * limit


def stored_bits(bits: int) -> int:
    """The width that distances are stored with: 1, 2 and 4 as they are, else whole bytes up to 64."""
    if bits <= 2:
        return max(1, bits)
    return 4 if bits <= 4 else min(64, -(-bits // 8) * 8)
