"""Stencils on sparse level sets: neighbour values, and signs of points that no row holds.

Neighbours within a reach are found in blocks with borders (see ``blocks``), single points by a window over their column. The sign of an absent point is that of the nearest row below in its column, else of the nearest above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import AXES, KEY, Grid, axis_neighbours
from .blocks import cell_corners, offset_values


def neighbour_values(points: DataFrame, reach: int = 1, grid: Grid | None = None) -> DataFrame:
    """``points`` with a column for each axis and step (xm1, xp1, ... by ``reach``): phi of that neighbour, null if absent.

    With a grid, neighbours beyond its bounds are looked up where its boundary kinds map them.
    """
    return offset_values(points, {f"{a}{'m' if s < 0 else 'p'}{abs(s)}": tuple(s if b == a else 0 for b in AXES) for a in AXES for s in range(-reach, reach + 1) if s}, grid)


def probed(points: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (layer, x, y, z and more) with ``sign`` (-1 or 1, null for a column without rows) and phi (null if absent).

    Rows and probes of a column meet in one window over z, so a probe costs no join, and any number of probes one shuffle.
    """
    extra = [c for c in probes.columns if c not in KEY]
    rows = points.select(*KEY, F.col("phi"), F.lit(0).alias("__probe"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    asks = probes.select(*KEY, F.lit(None).cast(points.schema["phi"].dataType).alias("phi"), F.lit(1).alias("__probe"), *extra)
    column = Window.partitionBy("layer", "x", "y").orderBy("z", "__probe")
    down, up = column.rowsBetween(Window.unboundedPreceding, Window.currentRow), column.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = F.when(F.col("__probe") == 0, F.struct("z", "phi"))
    below, above = F.last(held, ignorenulls=True).over(down), F.first(held, ignorenulls=True).over(up)
    out = rows.union(asks).withColumn("__below", below).withColumn("__above", above).where("__probe = 1")
    near = F.coalesce(F.col("__below.phi"), F.col("__above.phi"))
    return out.select(*KEY, F.when(near < 0, -1).when(near.isNotNull(), 1).alias("sign"), F.when(F.col("__below.z") == F.col("z"), F.col("__below.phi")).alias("phi"), *extra)


def neighbour_signs(points: DataFrame, axes: list[str] = AXES) -> DataFrame:
    """One row for each point and axis neighbour: the point's layer, x, y, z, its phi (own), the neighbour's sign and phi.

    Neighbours in columns without any row have a null sign (open edges of the domain).
    """
    asks = axis_neighbours(points.select(*KEY, "phi"), 1, axes).select("layer", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"), F.struct("x", "y", "z", F.col("phi").alias("own"), "axis", "step").alias("at"))
    return probed(points, asks).select("layer", "at.x", "at.y", "at.z", "at.own", "at.axis", "at.step", "sign", "phi")


def cells(points: DataFrame, axes: list[str] = AXES) -> DataFrame:
    """(layer, x, y, z, code, corners): cells by their lowest corner, for each cell that a row touches and whose corners all have a sign.

    code: sum of 2**c over corners c that are not negative; corner c lies at +1 along axes[b] where bit b of c is set. corners: phi of
    each corner, null where absent.
    """
    return cell_corners(points, axes)
