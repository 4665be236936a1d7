"""Analytic level sets: planes, boxes, spheres, in units of the grid spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid, box


def _of(spark: SparkSession, grid: Grid, phi, width: float, layer: int) -> DataFrame:
    rows = box(spark, grid.low, grid.high).withColumn("phi", phi).where(F.abs("phi") <= width)
    return rows.select(F.lit(layer).alias("layer"), "x", "y", "z", "phi")


def plane(spark: SparkSession, grid: Grid, axis: str, at: float, sign: int = 1, width: float = 1.5, layer: int = 0) -> DataFrame:
    """Half space below ``at`` on an axis (``sign`` -1: above)."""
    return _of(spark, grid, (F.col(axis) - F.lit(float(at))) * sign, width, layer)


def sphere(spark: SparkSession, grid: Grid, centre: tuple[float, float, float], radius: float, width: float = 1.5, layer: int = 0) -> DataFrame:
    d = sum(((F.col(a) - F.lit(float(c))) ** 2 for a, c in zip("xyz", centre, strict=True)), F.lit(0.0))
    return _of(spark, grid, F.sqrt(d) - radius, width, layer)


def block(spark: SparkSession, grid: Grid, low: tuple[float, ...], high: tuple[float, ...], width: float = 1.5, layer: int = 0) -> DataFrame:
    """A box from corner to corner: the greatest of its six half spaces."""
    sides = [F.greatest(F.lit(float(a)) - F.col(x), F.col(x) - F.lit(float(b))) for x, a, b in zip("xyz", low, high, strict=True)]
    return _of(spark, grid, F.greatest(*sides), width, layer)


def from_points(points: DataFrame) -> DataFrame:
    """A level set from (layer, x, y, z, phi) rows in any order; of rows at one point that nearest the surface counts (ties: the smaller)."""
    return points.groupBy("layer", "x", "y", "z").agg(F.min_by("phi", F.struct(F.abs("phi"), F.col("phi"))).alias("phi"))
