"""Level sets from surfaces whose elements are turned either way: what is inside follows from crossings, not from orientation.

Grid lines along an axis cross the elements (segments in two dimensions, triangles in three). A grid point is inside if the line along the open axis
has crossed the surface an odd number of times before it. A line that runs through a corner or an edge is taken to pass beside it,
a little higher along the first of the other axes and still less along the second (lower on the last line of a domain, which thus stays inside it), so elements
that share the edge agree on which of them it crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import AXES, KEY
from .meshing import cornered, cumulative_hulls, interfaces


def _sides(axis: str, axes: list[str]) -> list[str]:
    return [a for a in axes if a != axis]


def crossings(elements: DataFrame, along: str, axes: list[str] = AXES, high: dict[str, int] | None = None) -> DataFrame:
    """Where grid lines along ``along`` cross ``elements`` (layer; at: corners in cells, two or three by the dimension): the other columns of the row, the
    line's indices and ``hit``.

    ``high``: the domain's last index by axis. One explosion to the lines in the box of each element; no shuffle.
    """
    others = _sides(along, axes)
    n = len(axes)
    at = [F.get("at", F.lit(i)) for i in range(n)]  # without errors where a filter of sizes comes later
    rows = elements
    for b in others:
        low, top = F.least(*[at[i][b] for i in range(n)]), F.greatest(*[at[i][b] for i in range(n)])
        rows = rows.where(F.ceil(low) <= F.floor(top)).withColumn(f"__{b}", F.explode(F.sequence(F.ceil(low).cast("int"), F.floor(top).cast("int"))))
    # to which side of the line's index the line is taken to pass
    aside = {b: F.when(F.col(f"__{b}") == high[b], -1).otherwise(1) if high and b in high else F.lit(1) for b in others}
    if n == 2:
        (c,) = others
        line = F.col(f"__{c}")
        under = [F.when(aside[c] > 0, at[i][c] <= line).otherwise(at[i][c] < line) for i in range(2)]
        crossed = under[0] != under[1]
        hit = at[0][along] + (line - at[0][c]) / (at[1][c] - at[0][c]) * (at[1][along] - at[0][along])
    else:
        b, c = others

        def turn(i: int, j: int) -> Column:
            return (at[i][b] - F.col(f"__{b}")) * (at[j][c] - F.col(f"__{c}")) - (at[j][b] - F.col(f"__{b}")) * (at[i][c] - F.col(f"__{c}"))

        def side(i: int, j: int) -> Column:
            # on the edge's line: by how the turn changes along the first axis, else along the second
            first, second = (at[i][c] - at[j][c]) * aside[b], (at[j][b] - at[i][b]) * aside[c]
            return F.signum(F.when(turn(i, j) != 0, turn(i, j)).when(first != 0, first).otherwise(second))

        w = [turn(1, 2), turn(2, 0), turn(0, 1)]
        whole = w[0] + w[1] + w[2]
        s = [side(1, 2), side(2, 0), side(0, 1)]
        crossed = (whole != 0) & (s[0] == s[1]) & (s[1] == s[2])
        hit = (w[0] * at[0][along] + w[1] * at[1][along] + w[2] * at[2][along]) / whole
    held = [c for c in elements.columns if c != "at"]
    return rows.where(crossed).select(*held, *[F.col(f"__{b}").alias(b) for b in others], hit.alias("hit"))


def level_sets(elements: DataFrame, axes: list[str] = AXES, along: list[str] | None = None, high: dict[str, int] | None = None, solid_below: bool = False, counted: str | None = None) -> DataFrame:
    """Level set (layer, x, y, z, phi in cells) of each layer's surface, whose elements (layer, at: corners in cells) may be turned either way.

    The grid points before and after each crossing along the axes ``along`` (all, unless told) take the distance to the nearest one; inside is what the
    surface, which must be closed along the last of ``axes`` (the open one), has crossed an odd number of times before. ``solid_below``: a sheet,
    with the solid below it. ``high``: the domain's last index by axis. ``counted``: a boolean column; an element where it is false closes the surface but
    gives no distances (a removed side of the domain). A point on the surface has phi 0. Repeated elements cancel in pairs. An empty table gives an empty result.

    Crossings come from a narrow pass; points and crossings of the open axis meet in one shuffle by column, where a window counts.
    """
    open_axis, flat = axes[-1], [a for a in AXES if a not in axes]
    own = elements.select("layer", "at", (F.col(counted) if counted else F.lit(True)).alias("counted"))
    up = crossings(own, open_axis, axes, high)
    near = None
    for a in along or axes:
        found = (up if a == open_axis else crossings(own, a, axes, high)).where("counted")
        found = found.withColumn(a, F.explode(F.array_distinct(F.array(F.floor("hit"), F.ceil("hit"))))).select("layer", *[F.col(b).cast("int").alias(b) if b in axes else F.lit(0).alias(b) for b in AXES], F.abs(F.col("hit") - F.col(a)).alias("d"))
        near = found if near is None else near.unionByName(found)
    column = ["layer", *[a for a in AXES if a != open_axis]]
    points = near.repartition(*column).groupBy(*KEY).agg(F.min("d").alias("d"))
    # a point stands before a crossing at its own place
    rows = points.select(*column, F.col(open_axis).cast("double").alias("at"), F.lit(0).alias("n"), F.col(open_axis).alias("i"), "d")
    lines = up.select("layer", *[F.col(a).cast("int").alias(a) if a in axes else F.lit(0).alias(a) for a in column[1:]], F.col("hit").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("d"))
    before = F.sum("n").over(Window.partitionBy(*column).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    signed = rows.unionByName(lines.repartition(*column)).withColumn("before", before).where("n = 0")
    inside = F.col("before") % 2 == (0 if solid_below else 1)
    out = signed.withColumn("phi", F.when(F.col("d") == 0, 0.0).when(inside, -F.col("d")).otherwise(F.col("d")))
    if flat:
        out = out.drop(*flat).withColumns({a: F.lit(0) for a in flat})
    return out.select("layer", *[F.col("i").alias(a) if a == open_axis else F.col(a) for a in AXES], "phi")


def _on_sides(removed: dict[str, tuple[float | None, float | None]], eps: float) -> Column:
    """Whether an element lies, within ``eps``, on a removed side of the domain."""
    out = F.lit(False)
    for a, sides in removed.items():
        for side in sides:
            if side is not None:
                out = out | F.forall("at", lambda p: F.abs(p[a] - F.lit(float(side))) <= eps)  # noqa: B023
    return out


def _in_cells(nodes: DataFrame, delta: float) -> DataFrame:
    return nodes.select("node_id", *[(F.col(a) / float(delta)).alias(a) if a in nodes.columns else F.lit(0.0).alias(a) for a in AXES])


def surfaces_to_level_sets(elements: DataFrame, nodes: DataFrame, axes: list[str] = AXES, delta: float = 1.0, high: dict[str, int] | None = None, removed: dict[str, tuple[float | None, float | None]] | None = None, eps: float = 1e-6) -> DataFrame:
    """Level sets from surfaces: ``elements`` (layer, nodes: ids of two or three corners), ``nodes`` (node_id, x, y, z), a grid of ``delta``.

    Elements on ``removed`` sides (low and high coordinate by axis, null for a side that stays) close the solid but give no distances.
    """
    at = cornered(elements.select("layer", "nodes"), _in_cells(nodes, delta))
    cells = {a: tuple(None if s is None else s / delta for s in sides) for a, sides in (removed or {}).items()}
    return level_sets(at.withColumn("counted", ~_on_sides(cells, eps / delta)), axes, high=high, counted="counted")


def hulls_to_level_sets(faces: DataFrame, nodes: DataFrame, axes: list[str] = AXES, **more) -> DataFrame:
    """Level sets from the hull of each material: ``faces`` (face: sorted node ids; material). Layer m is the solid of all materials up to m; faces
    between two of these cancel, so that layers contain those below them. Further arguments as for ``surfaces_to_level_sets``."""
    hulls = cumulative_hulls(faces).select(F.col("material").alias("layer"), F.col("face").alias("nodes"))
    return surfaces_to_level_sets(hulls, nodes, axes, **more)


def volumes_to_level_sets(elements: DataFrame, nodes: DataFrame, axes: list[str] = AXES, **more) -> DataFrame:
    """Level sets from a volume mesh of triangles (two axes) or tetrahedra (three): ``elements`` (nodes, material). Layer m is the solid of all materials up
    to m. Materials are whole numbers in any order; how elements are turned doesn't matter. Further arguments as for ``surfaces_to_level_sets``.

    Faces between materials come from one aggregation; each is in every layer from its lower material to below its higher one.
    """
    top = elements.agg(F.max("material")).first()[0]
    m = F.explode(F.sequence(F.col("mat_low").cast("int"), F.least(F.col("mat_high"), F.lit(0 if top is None else top + 1)).cast("int") - 1))
    faces = interfaces(elements).select(m.alias("layer"), F.col("face").alias("nodes"))
    own = faces.join(elements.select(F.col("material").alias("layer")).distinct(), "layer", "left_semi")
    return surfaces_to_level_sets(own, nodes, axes, **more)
