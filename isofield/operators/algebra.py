"""Set algebra and upkeep of sparse level sets.

phi may be whole (thousandths of a cell) or real; ``unit`` is one cell in its measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import AXES, KEY, axis_neighbours
from .blocks import pruned, widened
from .stencil import neighbour_signs, probed

FAR = 1 << 40


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(layer, x, y, z, pa, pb): both values at every point that either holds; an absent one is FAR or -FAR by its side's column.

    Both sides meet in one shuffle by column, which serves the aggregation by point and the window by column. A side without rows in a
    column is outside there.
    """
    kind = a.schema["phi"].dataType
    rows = a.select(*KEY, F.col("phi").alias("pa"), F.lit(None).cast(kind).alias("pb")).unionByName(b.select(*KEY, F.lit(None).cast(kind).alias("pa"), F.col("phi").cast(kind).alias("pb")))
    at = rows.repartition("layer", "x", "y").groupBy(*KEY).agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    column = Window.partitionBy("layer", "x", "y").orderBy("z")
    down, up = column.rowsBetween(Window.unboundedPreceding, Window.currentRow), column.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def filled(c: str):
        near = F.coalesce(F.last(c, ignorenulls=True).over(down), F.first(c, ignorenulls=True).over(up))
        return F.coalesce(F.col(c), F.when(near < 0, F.lit(-FAR)).otherwise(F.lit(FAR)).cast(kind))

    return at.select(*KEY, filled("pa").alias("pa"), filled("pb").alias("pb"))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Solids a and b joined by ``how``: union (least), intersection (greatest) or difference (greatest with -b).

    Layers are combined one by one; give both sides the same layer numbers.
    """
    both = _sides(a, b)
    value = {"union": F.least("pa", "pb"), "intersection": F.greatest("pa", "pb"), "difference": F.greatest(F.col("pa"), -F.col("pb"))}[how]
    return both.select(*KEY, value.alias("phi")).where(F.abs("phi") < FAR)


def complement(a: DataFrame) -> DataFrame:
    """Inside and outside changed."""
    return a.withColumn("phi", -F.col("phi"))


def linear_combination(a: DataFrame, b: DataFrame, p, q) -> DataFrame:
    """p * a + q * b where both sides hold the point."""
    right = b.select(*KEY, F.col("phi").alias("__b"))
    return a.join(right, KEY).select(*KEY, (p * F.col("phi") + q * F.col("__b")).alias("phi"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """At every point that either side holds: whether signs differ (other_sign), a > b (above) and a < b (below). One shuffle for all three."""
    return _sides(a, b).select(*KEY, ((F.col("pa") < 0) != (F.col("pb") < 0)).alias("other_sign"), (F.col("pa") > F.col("pb")).alias("above"), (F.col("pa") < F.col("pb")).alias("below"))


def violations(a: DataFrame, b: DataFrame, test: str) -> DataFrame:
    """Points at which ``test`` fails: signs (equal signs), le (a <= b) or ge; a and b relate so if there are none."""
    return compared(a, b).where({"signs": "other_sign", "le": "above", "ge": "below"}[test]).select(*KEY)


def prune(points: DataFrame) -> DataFrame:
    """Points of which an axis neighbour has the other sign; a neighbour beyond an open edge has none."""
    return pruned(points)


def reduce_width(points: DataFrame, width) -> DataFrame:
    """Points within half of ``width`` of the surface."""
    return points.where(F.abs("phi") * 2 <= width)


def expand(points: DataFrame, width, unit=1000, start=None) -> DataFrame:
    """A band ``width`` wide: points within half of it stay as they are (from ``start``, one cell, on); every cycle another positive point gets the least
    neighbour value plus one cell, another negative one the largest less one, if that is within the cycle's limit.

    The number of cycles is fixed by the widths; all take place in blocks with borders, after one shuffle.
    """
    now = unit if start is None else start
    return widened(points, width, unit, now) if now < width else points.where(F.abs("phi") * 2 <= now)


def add_voxel_corners(points: DataFrame, unit=1000, axes: list[str] = AXES) -> DataFrame:
    """``points`` and the absent points diagonal (one step on every axis) to an active one, valued from their axis neighbours.

    A point in a column without rows, beyond an open edge, has no sign and is not added.
    """
    steps = F.array(*[F.struct(*[F.lit(1 if c >> i & 1 else -1).alias(a) for i, a in enumerate(axes)]) for c in range(1 << len(axes))])
    active = points.where(F.abs("phi") * 2 <= unit).withColumn("__d", F.explode(steps))
    asked = active.select("layer", *[(F.col(a) + F.col(f"__d.{a}")).cast("int").alias(a) if a in axes else F.col(a) for a in AXES]).distinct()
    asked = asked.join(points.select(*KEY), KEY, "left_anti")
    near = axis_neighbours(points.select(*KEY, "phi"), 1, axes).select("layer", *[F.col(f"n{a}").alias(a) for a in AXES], "phi")
    value = near.groupBy(*KEY).agg((F.min("phi") + unit).alias("up"), (F.max("phi") - unit).alias("down"))
    new = probed(points, asked.join(value, KEY)).where("sign is not null")
    return points.select(*KEY, "phi").unionByName(new.select(*KEY, F.when(F.col("sign") > 0, F.col("up")).otherwise(F.col("down")).cast(points.schema["phi"].dataType).alias("phi")))


def add_layers(points: DataFrame, n: int) -> DataFrame:
    """``n`` copies of the top layer above it; a negative ``n`` removes that many layers just below the top."""
    top = points.agg(F.max("layer")).first()[0]
    if top is None or n == 0:
        return points
    if n > 0:
        copies = points.where(F.col("layer") == top).withColumn("layer", F.explode(F.sequence(F.lit(top + 1), F.lit(top + n))))
        return points.unionByName(copies)
    if -n > top:
        raise ValueError("not so many layers below the top")
    kept = points.where((F.col("layer") < top + n) | (F.col("layer") == top))
    return kept.withColumn("layer", F.when(F.col("layer") == top, top + n).otherwise(F.col("layer")).cast("int"))


def wrap_layers(points: DataFrame) -> DataFrame:
    """Layers made to contain those below them: at each point the least phi of a layer and all lower ones that hold it."""
    upto = Window.partitionBy("x", "y", "z").orderBy("layer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("phi", F.min("phi").over(upto))


def inconsistent(points: DataFrame, unit=1000) -> DataFrame:
    """Pairs of held axis neighbours whose values differ by more than one cell and a tenth: a distance field has none."""
    return neighbour_signs(points).where(F.col("phi").isNotNull() & (F.abs(F.col("own") - F.col("phi")) * 10 > 11 * unit))


def summary(points: DataFrame, unit=1000) -> DataFrame:
    """Rows, active rows and sum of phi by layer."""
    return points.groupBy("layer").agg(F.count("*").alias("n_points"), F.sum((F.abs("phi") * 2 <= unit).cast("bigint")).alias("n_active"), F.sum("phi").alias("sum_phi"))
