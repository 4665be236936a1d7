"""Weighted essentially non-oscillatory slopes of third and fifth order (Jiang and Peng), as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, Grid
from .stencil import neighbour_values

#: Keeps smoothness ratios finite where the field is linear (a fixed value).
EPSILON = 1e-6


def weno3(d: list[Column]) -> Column:
    """Slope from three differences in a row, the one farthest upwind first."""
    far, near, ahead = d
    bend_up, bend_on = far - near, near - ahead
    r = (EPSILON + bend_up * bend_up) / (EPSILON + bend_on * bend_on)
    return (near + ahead - (far - 2.0 * near + ahead) / (1.0 + 2.0 * r * r)) / 2.0


def weno5(d: list[Column]) -> Column:
    """Slope from five differences v1 to v5 in a row, the one farthest upwind first.

    Three parabolas fit three differences each; a fit counts by its ideal weight over its roughness (to the first power).
    """
    v1, v2, v3, v4, v5 = d
    left = (2.0 * v1 - 7.0 * v2 + 11.0 * v3) / 6.0
    centre = (-v2 + 5.0 * v3 + 2.0 * v4) / 6.0
    right = (2.0 * v3 + 5.0 * v4 - v5) / 6.0

    def roughness(bend: Column, tilt: Column) -> Column:
        return 13.0 / 12.0 * bend * bend + tilt * tilt / 4.0

    rough_left = roughness(v1 - 2.0 * v2 + v3, v1 - 4.0 * v2 + 3.0 * v3)
    rough_centre = roughness(v2 - 2.0 * v3 + v4, v2 - v4)
    rough_right = roughness(v3 - 2.0 * v4 + v5, 3.0 * v3 - 4.0 * v4 + v5)
    weight_left = F.lit(0.1) / (EPSILON + rough_left)
    weight_centre = F.lit(0.6) / (EPSILON + rough_centre)
    weight_right = F.lit(0.3) / (EPSILON + rough_right)
    return (weight_left * left + weight_centre * centre + weight_right * right) / (weight_left + weight_centre + weight_right)


def weno_slopes(points: DataFrame, order: int = 3, axes: list[str] = AXES, grid: Grid | None = None) -> DataFrame:
    """``points`` with the slope from below and from above for each axis (x_below, x_above, ...), in phi by cell.

    Null where a slope's own stencil isn't whole: order 3 needs two neighbours upwind and one on the other side, order 5 three and
    two. All axes share one shuffle.
    """
    if order not in (3, 5):
        raise ValueError(f"no order {order}; there are 3 and 5")
    reach, rule = (2, weno3) if order == 3 else (3, weno5)
    v = neighbour_values(points, reach, grid)
    out = {}
    for a in axes:
        line = [F.col(f"{a}m{s}") for s in range(reach, 0, -1)] + [F.col("phi")] + [F.col(f"{a}p{s}") for s in range(1, reach + 1)]
        d = [(q - p).cast("double") for p, q in zip(line, line[1:], strict=False)]
        out[f"{a}_below"], out[f"{a}_above"] = rule(d[:order]), rule(d[::-1][:order])
    return v.withColumns(out).select(*points.columns, *out)
