"""Operations on a whole stack of layers: levelling, masks, Boolean operations with another solid.

A stack is a level set whose layers contain those below them. Layers are a handful; each step is one shuffle by column for all layers that it concerns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import KEY
from .algebra import combine, complement, prune


def _numbers(points: DataFrame) -> list[int]:
    return sorted(r[0] for r in points.select("layer").distinct().collect())


def _for_layers(solid: DataFrame, layers: list[int]) -> DataFrame:
    """``solid`` (x, y, z, phi) once for each of ``layers``."""
    return solid.select(F.explode(F.array(*[F.lit(n) for n in layers])).alias("layer"), "x", "y", "z", "phi")


def half_space(points: DataFrame, at, unit=1000) -> DataFrame:
    """(x, y, z, phi) of the solid up to z = ``at`` (in the measure of phi) over every column of ``points``, a band of three cells."""
    low = int(at // unit) - 1
    columns = points.select("x", "y").distinct().withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(low + 3))))
    phi = (F.col("z") * unit - F.lit(at)).cast(points.schema["phi"].dataType)
    return columns.withColumn("phi", phi).where(F.abs("phi") * 2 <= 3 * unit)


def planarised(points: DataFrame, at, fill: bool = False, unit=1000) -> DataFrame:
    """Every layer cut off above z = ``at`` and pruned; ``fill``: a new top layer fills up to there. An empty table stays empty."""
    layers = _numbers(points)
    if not layers:
        return points.select(*KEY, "phi")
    plane = half_space(points, at, unit)
    out = prune(combine(points, _for_layers(plane, layers), "intersection"))
    return out.unionByName(_for_layers(plane, [layers[-1] + 1]).select(*out.columns)) if fill else out


def masked(points: DataFrame, mask: DataFrame, over_others: bool = False) -> DataFrame:
    """The stack on a mask (x, y, z, phi), which becomes layer 0 and part of every layer above it; their numbers rise by one.

    The mask is only where no layer was, unless it goes ``over_others``.
    """
    layers = _numbers(points)
    own = _for_layers(mask, [0])
    if not over_others:
        for n in layers:
            own = combine(own, points.where(F.col("layer") == n).withColumn("layer", F.lit(0)), "difference")
    if not layers:
        return own.select(*KEY, "phi")
    stack = combine(points, _for_layers(own, layers), "union").withColumn("layer", F.col("layer") + 1)
    return own.select(*KEY, "phi").unionByName(stack.select(*KEY, "phi"))


def boolean(points: DataFrame, solid: DataFrame, level: int, invert: bool = False, wrap: bool = False) -> DataFrame:
    """The top layers joined with ``solid`` (x, y, z, phi), or with its complement (``invert``), and pruned; other layers stay.

    ``level`` > 0: so many of them become the union with it; < 0: so many the intersection, and with ``wrap`` they keep what the layer below them
    holds. Level 0 changes nothing.
    """
    layers = _numbers(points)
    top = layers[-abs(level) :] if level else []
    if abs(level) > len(layers):
        raise ValueError("not so many layers")
    if not top:
        return points.select(*KEY, "phi")
    other = _for_layers(complement(solid) if invert else solid, top)
    out = combine(points.where(F.col("layer").isin(top)), other, "union" if level > 0 else "intersection")
    under = layers[: -abs(level)]
    if level < 0 and wrap and under:
        out = combine(out, _for_layers(points.where(F.col("layer") == under[-1]), top), "union")
    return points.where(F.col("layer").isin(under)).select(*KEY, "phi").unionByName(prune(out))
