"""Surface meshes from level sets, and level-set inputs from volume meshes."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import AXES
from ..functions.numbering import numbered
from .components import connected_components
from .blocks import cell_parts


def segments_of(code: int) -> list[list[list[int]]]:
    """Segments of marching squares for a case, as pairs of cut sides (pairs of corners), from a rule: a side is cut if its corners differ;
    two cuts are joined; with four, those around each corner that is not negative."""
    sides = [[0, 1], [1, 3], [2, 3], [0, 2]]
    plus = [bool(code >> c & 1) for c in range(4)]
    cut = [s for s in sides if plus[s[0]] != plus[s[1]]]
    if len(cut) == 2:
        return [cut]
    return [[s for s in cut if c in s] for c in range(4) if plus[c]] if cut else []


def triangles_of(code: int) -> list[list[list[int]]]:
    """Triangles in a cube for a case, as triples of cut edges: the cube is six tetrahedra along paths from corner 0 to corner 7 (one for each
    order of the axes), and a tetrahedron is cut in one triangle or in a quadrangle of two."""
    out = []
    for order in permutations((1, 2, 4)):
        tet = [0, order[0], order[0] + order[1], 7]
        up = [c for c in tet if code >> c & 1]
        down = [c for c in tet if not code >> c & 1]
        edge = lambda a, b: sorted((a, b))
        if len(up) in (1, 3):
            one, three = (up[0], down) if len(up) == 1 else (down[0], up)
            out.append([edge(one, c) for c in three])
        elif len(up) == 2:
            a, b, c, d = edge(up[0], down[0]), edge(up[0], down[1]), edge(up[1], down[0]), edge(up[1], down[1])
            out += [[a, b, c], [b, c, d]]
    return out


def simplices_of(code: int, n: int) -> list[list[list[int]]]:
    """What is negative in a square (``n`` 2) or cube (3) for a case, as triangles or tetrahedra whose nodes are corners ([c, c]) or cut edges.

    The cell is cut along paths from corner 0 to its opposite, one for each order of the axes. Of such a simplex, with corners a0, a1, ... inside
    and b0, b1, ... outside, in order of their numbers, a part has a0 to aj and the cuts of a staircase from (aj, b0) to the
    last pair. Neighbouring cells order a shared side alike, so they cut it alike.
    """
    out = []
    for order in permutations([1 << i for i in range(n)]):
        path = [sum(order[:i]) for i in range(n + 1)]
        ins, outs = [c for c in path if not code >> c & 1], [c for c in path if code >> c & 1]
        if not outs:
            out.append([[c, c] for c in path])
            continue
        for j in range(len(ins)):
            right, up = len(ins) - 1 - j, len(outs) - 1
            for rights in combinations(range(right + up), right):
                i, o, cuts = j, 0, [sorted((ins[j], outs[0]))]
                for step in range(right + up):
                    i, o = (i + 1, o) if step in rights else (i, o + 1)
                    cuts.append(sorted((ins[i], outs[o])))
                out.append([[c, c] for c in ins[: j + 1]] + cuts)
    return out


def surface(points: DataFrame, axes: list[str], far: float = 1500) -> DataFrame:
    """(layer, x, y, z, part, nodes): segments (two axes) or triangles (three) of the surface, by cell.

    A node is a struct of its edge (lowest corner and the step to the other), so elements that share an edge share the node, and t: where on
    the edge phi is 0. A corner that no row holds lies beyond the band and counts ``far`` by its sign, so that the surface
    is whole where it is steeper than the band. The case table has one entry a case, made
    from the rules above (256 at most).
    """
    return _elements(cuts(points, axes, far), axes)


def cuts(points: DataFrame, axes: list[str], far: float = 1500) -> DataFrame:
    """``surface`` with its nodes as they are within the cell: edges (of corners a and b, 4 or 8 times a and b) and t, for those who need no more."""
    return cell_parts(points, axes, _cases(segments_of if len(axes) == 2 else triangles_of, axes), far)


def solid(points: DataFrame, axes: list[str] = AXES, far: float = 1500) -> DataFrame:
    """As ``surface``: triangles (two axes) or tetrahedra (three) of the inside, in every cell that the band touches; turned either way.

    A node that is a corner has no step and t 0. The mesh is conforming. Cells deeper than the band have no row and no element;
    a wider band (``algebra.expand``) reaches them. A material is the solid of its layer less the one below (``algebra.combine``).
    """
    return _elements(cell_parts(points, axes, _cases(lambda code: simplices_of(code, len(axes)), axes), far), axes)


def sizes(elements: DataFrame) -> DataFrame:
    """Elements of ``solid`` with ``size``: the area or volume in cells. Sides are taken from whole steps and shares of edges, so digits don't depend on the place."""
    n = lambda k: F.get("nodes", F.lit(k))

    def side(k: int) -> list[Column]:
        return [(n(k)[a] - n(0)[a]) + (n(k)["t"] * n(k)[f"d{a}"] - n(0)["t"] * n(0)[f"d{a}"]) for a in AXES]

    u, v, w = (side(k) for k in (1, 2, 3))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2.0
    volume = F.abs(cross[0] * w[0] + cross[1] * w[1] + cross[2] * w[2]) / 6.0
    return elements.withColumn("size", F.when(F.size("nodes") == 3, area).otherwise(volume))


def _cases(rule: Callable[[int], list[list[list[int]]]], axes: list[str]) -> dict[int, list[list[list[int]]]]:
    return {code: rule(code) for code in range(1 << (1 << len(axes)))}


def _elements(parts: DataFrame, axes: list[str]) -> DataFrame:
    """Elements with their nodes on the grid, from ``cell_parts``."""
    bit = lambda k, i: F.shiftright(k, i).bitwiseAND(1)

    def node(e: Column, t: Column) -> Column:
        a, b = F.shiftright(e, len(axes)), e.bitwiseAND((1 << len(axes)) - 1)
        low = [(F.col(x) + (bit(a, axes.index(x)) if x in axes else F.lit(0))).cast("int").alias(x) for x in AXES]
        step = [(bit(b, axes.index(x)) - bit(a, axes.index(x)) if x in axes else F.lit(0)).cast("int").alias(f"d{x}") for x in AXES]
        return F.struct(*low, *step, t.alias("t"))

    return parts.select("layer", *AXES, "part", F.zip_with("edges", "t", node).alias("nodes"))


def surface_nodes(elements: DataFrame) -> DataFrame:
    """Distinct nodes of ``surface`` with coordinates px, py, pz; an edge that several cells cut is one node.

    ox, oy, oz: the end of the edge nearer to the surface (the first of equal ones), whose data a node takes.
    """
    nodes = elements.select("layer", F.explode("nodes").alias("n")).select("layer", "n.*").groupBy("layer", *AXES, "dx", "dy", "dz").agg(F.min("t").alias("t"))
    owner = {f"o{a}": (F.col(a) + F.when(F.col("t") <= 0.5, 0).otherwise(F.col(f"d{a}"))).cast("int") for a in AXES}
    return nodes.withColumns({f"p{a}": F.col(a) + F.col("t") * F.col(f"d{a}") for a in AXES} | owner)


def indexed(elements: DataFrame, data: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``surface`` as a mesh: nodes (node_id from 0, layer, x, y, z and the columns of ``data``) and elements (elem_id from 0, layer, nodes).

    ``data``: layer, x, y, z and series of points (velocities, rates, coverages, material); a node takes those of its owner.
    """
    edge = ["layer", *AXES, "dx", "dy", "dz"]
    nodes = numbered(surface_nodes(elements), edge, name="nodes").withColumnRenamed("before", "node_id")
    parts = numbered(elements, ["layer", *AXES, "part"], name="elements").withColumnRenamed("before", "elem_id")
    corners = parts.select("elem_id", "layer", F.posexplode("nodes").alias("at", "n")).select("elem_id", "layer", "at", *[F.col(f"n.{c}").alias(c) for c in edge[1:]])
    met = corners.join(_dealt(nodes.select(*edge, "node_id")), edge)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id"))), lambda x: x["node_id"])
    out = nodes.select("node_id", "layer", *[F.col(f"p{a}").alias(a) for a in AXES], *[f"o{a}" for a in AXES])
    if data is not None:
        out = out.join(data.withColumnsRenamed({a: f"o{a}" for a in AXES}), ["layer", *[f"o{a}" for a in AXES]], "left")
    return out.drop(*[f"o{a}" for a in AXES]), met.groupBy("elem_id", "layer").agg(ids.alias("nodes"))


def materials(elements: DataFrame) -> DataFrame:
    return elements.select("material").distinct()


def interfaces(elements: DataFrame) -> DataFrame:
    """(face, mat_low, mat_high): faces (sorted node ids) of volume elements (nodes array, material) between different materials; the outside has
    one material more than the largest. A face that one element has is on the outside.

    One explosion to faces, one aggregation with partial results.
    """
    face = lambda skip: F.array_sort(F.filter("nodes", lambda x, i: i != skip))
    faces = elements.select("material", F.explode(F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), face)).alias("face"))
    outside = elements.agg((F.max("material") + 1).alias("outside"))
    g = faces.groupBy("face").agg(F.min("material").alias("mat_low"), F.max("material").alias("mat_high"), F.count("*").alias("n"))
    # one row, whatever the mesh
    g = g.join(F.broadcast(outside), F.lit(True)).withColumn("mat_high", F.when(F.col("n") == 1, F.col("outside")).otherwise(F.col("mat_high")))
    return g.where("mat_low <> mat_high").select("face", "mat_low", "mat_high")


def surfaces_by_material(faces: DataFrame, n_materials: int) -> DataFrame:
    """(material, face): surface m has the faces with mat_low <= m < mat_high, for m below ``n_materials``."""
    m = F.explode(F.sequence(F.col("mat_low"), F.least(F.col("mat_high"), F.lit(n_materials)) - 1))
    return faces.where(F.col("mat_low") < n_materials).select(m.alias("material"), "face")


def hull_surfaces(faces: DataFrame) -> DataFrame:
    """Faces (face, material) that occur an odd number of times; pairs cancel."""
    return faces.groupBy("material", "face").agg(F.count("*").alias("n")).where("n % 2 = 1").select("material", "face")


def bounding_box(nodes: DataFrame, axes: list[str] = AXES) -> DataFrame:
    return nodes.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def merged_nodes(nodes: DataFrame, eps: float, axes: list[str] = AXES) -> DataFrame:
    """(node_id, merged_id): nodes that a chain of steps of at most ``eps`` joins become the one with the smallest id.

    Nodes at the same place are joined first, so that however many there are make one. The rest meet in bins of width ``eps``: a node is sent to its own bin
    and to half of the bins around it, where distances are tested; what is linked goes by connected components. A bin should hold few places, which a
    tolerance well below the size of the elements gives.
    """
    places = nodes.groupBy(*axes).agg(F.min("node_id").alias("place"))
    bins = [F.floor(F.col(a) / eps).cast("bigint").alias(f"b{a}") for a in axes]
    around = [d for d in product((-1, 0, 1), repeat=len(axes)) if d >= (0,) * len(axes)]
    offsets = F.array(*[F.struct(*[F.lit(i).alias(a) for a, i in zip(axes, d, strict=True)]) for d in around])
    held = places.select("place", *axes, *bins)
    asks = held.select(F.col("place").alias("u"), *[F.col(a).alias(f"u{a}") for a in axes], *[F.col(f"b{a}").alias(f"h{a}") for a in axes], F.explode(offsets).alias("d"))
    asks = asks.select("u", *[f"u{a}" for a in axes], *[(F.col(f"h{a}") + F.col(f"d.{a}")).alias(f"b{a}") for a in axes])
    apart = sum(((F.col(a) - F.col(f"u{a}")) * (F.col(a) - F.col(f"u{a}")) for a in axes), F.lit(0.0))
    links = asks.join(held, [f"b{a}" for a in axes]).where((F.col("u") != F.col("place")) & (apart <= eps * eps)).select("u", F.col("place").alias("v"))
    roots = connected_components(links).select(F.col("node").alias("place"), "root")
    own = nodes.select("node_id", *axes).join(places, axes).select("node_id", "place")
    return own.join(roots, "place", "left").select("node_id", F.coalesce("root", "place").alias("merged_id"))


def merged(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """``elements`` (nodes and more) with nodes replaced by ``ids`` (node_id, merged_id), without those that lose their extent."""
    rows = elements.withColumn("__row", F.monotonically_increasing_id())
    met = rows.select("*", F.posexplode("nodes").alias("__k", "node_id")).join(_dealt(ids), "node_id")
    held = [F.first(c).alias(c) for c in elements.columns if c != "nodes"]
    out = met.groupBy("__row").agg(*held, F.transform(F.array_sort(F.collect_list(F.struct("__k", "merged_id"))), lambda x: x["merged_id"]).alias("nodes"))
    return without_degenerate(out.select(*elements.columns))


def turned(elements: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``elements`` (elem_id, nodes: three ids) turned alike: of two triangles at an edge each runs along it the other way. With ``nodes`` (node_id, x, y, z), closed
    surfaces are turned outward.

    Every triangle counts twice, once for each way round; an edge of two triangles links the ways that agree. Connected components of these are the pieces of the
    surface, each in both ways, and the one that keeps the triangle with the smallest id is taken. A one-sided surface holds both ways in one component: an
    error. Edges of three or more triangles link nothing; a triangle by itself stays. Two triangles that meet in several edges are linked by each.
    """
    t = elements.select("elem_id", "nodes")
    sides = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a < b).alias("up")) for a, b in ((F.col("nodes")[i], F.col("nodes")[(i + 1) % 3]) for i in range(3))])
    edges = t.select("elem_id", F.explode(sides).alias("s")).groupBy("s.a", "s.b").agg(F.min(F.struct("elem_id", "s.up")).alias("p"), F.max(F.struct("elem_id", "s.up")).alias("q"), F.count("*").alias("n"))
    pairs = edges.where("n = 2 and p.elem_id <> q.elem_id").select(F.col("p.elem_id").alias("p"), F.col("q.elem_id").alias("q"), (F.col("p.up") == F.col("q.up")).cast("int").alias("other"))
    # a way round: twice the id, and one more for the reverse
    links = pairs.select(F.explode(F.array(*[F.struct((F.col("p") * 2 + w).alias("u"), (F.col("q") * 2 + F.abs(F.col("other") - w)).alias("v")) for w in (0, 1)])).alias("l")).select("l.u", "l.v")
    roots = connected_components(links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")))
    ways = roots.groupBy(F.expr("node div 2").alias("elem_id")).agg(F.max(F.when(F.col("node") % 2 == 0, F.col("root"))).alias("kept"), F.max(F.when(F.col("node") % 2 == 1, F.col("root"))).alias("reverse"))
    if ways.where("kept = reverse").take(1):
        raise ValueError("a one-sided surface has no outside")
    found = t.join(_dealt(ways), "elem_id", "left").select("elem_id", "nodes", F.coalesce(F.col("reverse") < F.col("kept"), F.lit(False)).alias("flip"), F.coalesce(F.least("kept", "reverse"), F.col("elem_id") * 2).alias("piece"))
    if nodes is not None:
        ways = found.select("elem_id", "piece", "flip")
        size = cornered(elements.select("elem_id", "nodes"), nodes).join(_dealt(ways), "elem_id")
        # six times the volume between a triangle and the origin
        at = F.col("at")
        six = dot(cross([at[0][a] for a in AXES], [at[1][a] for a in AXES]), [at[2][a] for a in AXES])
        volume = size.groupBy("piece").agg(F.sum(F.when(F.col("flip"), -six).otherwise(six)).alias("volume"))
        loose = edges.where("n <> 2").select(F.explode(F.array("p.elem_id", "q.elem_id")).alias("elem_id")).join(_dealt(ways), "elem_id").select("piece").distinct().withColumn("open", F.lit(True))
        found = found.join(_dealt(volume), "piece", "left").join(_dealt(loose), "piece", "left").withColumn("flip", F.col("flip") != (F.col("open").isNull() & (F.col("volume") < 0)))
    reverse = found.select("elem_id", "flip")
    old = F.col("nodes")
    return elements.join(_dealt(reverse), "elem_id").withColumn("nodes", F.when(F.col("flip"), F.array(old[0], old[2], old[1])).otherwise(old)).select(*elements.columns)


def _dealt(rows: DataFrame) -> DataFrame:
    """The side of a join that grows with the mesh: never sent whole to the driver. The planner takes an explosion for no longer than what it explodes,
    so it would broadcast the elements made from a small table."""
    return rows.hint("merge")


def without_degenerate(elements: DataFrame) -> DataFrame:
    """Elements whose nodes are all different."""
    return elements.where(F.size(F.array_distinct("nodes")) == F.size("nodes"))


def distances(segments: DataFrame, layer: int = 0) -> DataFrame:
    """Level set (layer, x, y, z, phi) from oriented surface segments (ax, az, bx, bz) in two dimensions; the solid is on the left.

    Every segment meets the grid lines in its bounding box; each meeting gives the grid points before and after it with their signed axis distance; of
    several values at a point the nearest counts (ties: the smaller). One explosion for each axis, one aggregation.
    """
    out = None
    for along, across in (("x", "z"), ("z", "x")):
        a0, a1, c0, c1 = (F.col(f"{e}{x}") for x in (along, across) for e in "ab")
        s = segments.where(c0 != c1).withColumn("line", F.explode(F.filter(F.sequence(F.ceil(F.least(c0, c1)).cast("int"), F.greatest(F.floor(F.greatest(c0, c1)), F.ceil(F.least(c0, c1))).cast("int")), lambda i: (i <= F.greatest(c0, c1)) & (i >= F.least(c0, c1)))))
        hit = a0 + (F.col("line") - c0) / (c1 - c0) * (a1 - a0)
        side = F.signum(c1 - c0) * (1 if along == "x" else -1)
        s = s.withColumn("hit", hit).withColumn("side", side).withColumn("p", F.explode(F.array_distinct(F.array(F.floor("hit"), F.ceil("hit"))).cast("array<int>")))
        phi = (F.col("p") - F.col("hit")) * F.col("side")
        cols = {along: F.col("p"), across: F.col("line")}
        rows = s.select(F.lit(layer).alias("layer"), cols["x"].alias("x"), F.lit(0).alias("y"), cols["z"].alias("z"), phi.alias("phi"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("layer", "x", "y", "z").agg(F.min_by("phi", F.struct(F.abs("phi"), F.col("phi"))).alias("phi"))


def cornered(elements: DataFrame, nodes: DataFrame, ids: str = "nodes") -> DataFrame:
    """``elements`` with ``at``: the coordinates (struct of x, y, z) of the node ids in the array ``ids``, in order. One join."""
    rows = elements.withColumn("__row", F.monotonically_increasing_id()) if "elem_id" not in elements.columns else elements.withColumn("__row", F.col("elem_id"))
    each = rows.select("*", F.posexplode(ids).alias("__k", "__id"))
    met = each.join(_dealt(nodes.select(F.col("node_id").alias("__id"), F.struct(*AXES).alias("__at"))), "__id")
    held = [F.first(c).alias(c) for c in elements.columns]
    return met.groupBy("__row").agg(*held, F.transform(F.array_sort(F.collect_list(F.struct("__k", "__at"))), lambda x: x["__at"]).alias("at")).drop("__row")


def minus(a: Column, b: Column) -> list[Column]:
    return [a[x] - b[x] for x in AXES]


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def triangle_normal(at: Column) -> list[Column]:
    """Twice the area of a triangle (array of x, y, z) as a vector, to the side from which its corners run counterclockwise."""
    return cross(minus(at[1], at[0]), minus(at[2], at[0]))


def signed_volume(at: Column) -> Column:
    """Volume of a tetrahedron (array of x, y, z), negative if its last corner lies behind the first three."""
    return dot(triangle_normal(at), minus(at[3], at[0])) / 6.0


def orientation(at: Column) -> Column:
    """1, -1 or 0 by the sign of the volume."""
    return F.signum(signed_volume(at)).cast("int")


def oriented_interfaces(elements: DataFrame, nodes: DataFrame, removed: dict[str, tuple[float | None, float | None]] | None = None, eps: float = 1e-6) -> DataFrame:
    """(face, at, mat_low, mat_high): faces of tetrahedra between different materials with their corners, in the order that points out of the side with the
    lower material; the outside has one material more than the largest.

    Faces that lie, within ``eps``, on a removed side of the domain (``removed``: low and high coordinate by axis, null for a side that stays) are
    left out. One join for coordinates, one aggregation by face.
    """
    t = cornered(elements, nodes)
    order = lambda k, a: F.array(*[a[i] for i in range(4) if i != k])
    faces = t.select("material", F.explode(F.array(*[F.struct(order(k, F.col("nodes")).alias("ids"), order(k, F.col("at")).alias("at"), F.col("at")[k].alias("apex")) for k in range(4)])).alias("f")).select("material", "f.*")
    faces = faces.withColumn("face", F.array_sort("ids"))
    behind = dot(triangle_normal(F.col("at")), minus(F.col("apex"), F.col("at")[0])) < 0
    faces = faces.withColumn("at", F.when(behind, F.col("at")).otherwise(F.array(F.col("at")[0], F.col("at")[2], F.col("at")[1])))
    outside = elements.agg((F.max("material") + 1).alias("outside"))
    g = faces.groupBy("face").agg(F.min(F.struct("material", "at")).alias("low"), F.max("material").alias("mat_high"), F.count("*").alias("n"))
    # one row, whatever the mesh
    g = g.join(F.broadcast(outside), F.lit(True)).withColumn("mat_high", F.when(F.col("n") == 1, F.col("outside")).otherwise(F.col("mat_high")))
    out = g.select("face", "low.at", F.col("low.material").alias("mat_low"), "mat_high").where("mat_low <> mat_high")

    def on(axis: str, side: float) -> Column:
        return F.forall("at", lambda p: F.abs(p[axis] - F.lit(float(side))) <= eps)

    for axis, sides in (removed or {}).items():
        for side in sides:
            out = out if side is None else out.where(~on(axis, side))
    return out


def wafer_below(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A wafer under a mesh (node_id, x, y, z): nodes (node_id, x, y, z) and elements (elem_id, nodes, material 1) of a box of six conforming tetrahedra.

    Along x and y the box reaches past the mesh by its extent on either side; along z it hangs below the mesh, as thick as the mesh is high. One row of
    extents, whatever the mesh; an empty mesh gives none.
    """
    box = bounding_box(nodes).where("min_x is not null")
    wide = {a: (2 * F.col(f"min_{a}") - F.col(f"max_{a}"), (F.col("min_z") if a == "z" else 2 * F.col(f"max_{a}") - F.col(f"min_{a}"))) for a in AXES}
    corners = F.array(*[F.struct(F.lit(c).cast("bigint").alias("node_id"), *[wide[a][c >> i & 1].alias(a) for i, a in enumerate(AXES)]) for c in range(8)])
    paths = [[sum(order[:i]) for i in range(4)] for order in permutations((1, 2, 4))]
    parts = F.array(*[F.struct(F.lit(i).cast("bigint").alias("elem_id"), F.array(*[F.lit(c) for c in p]).alias("nodes"), F.lit(1).alias("material")) for i, p in enumerate(paths)])
    return box.select(F.explode(corners).alias("n")).select("n.*"), box.select(F.explode(parts).alias("e")).select("e.*")


def cumulative_hulls(faces: DataFrame) -> DataFrame:
    """(material, face) of the hull of all materials up to each one: faces (face, material) that occur an odd number of times at or below it.

    Faces are counted once, and each count holds until the next material of that face; one shuffle by face.
    """
    own = faces.groupBy("face", "material").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("face").orderBy("material"))
    after = F.lead("material").over(Window.partitionBy("face").orderBy("material"))
    spans = own.select("face", F.col("material").alias("from"), upto.alias("n"), after.alias("to")).where("n % 2 = 1")
    last = faces.agg(F.max("material")).first()[0]
    span = F.explode(F.sequence("from", F.coalesce(F.col("to") - 1, F.lit(last)).cast("int")))
    out = spans.select(F.col("from").cast("int").alias("from"), "to", "face").select(span.alias("material"), "face") if last is not None else spans.select(F.col("from").alias("material"), "face")
    return out.join(faces.select("material").distinct(), "material", "left_semi").select("material", "face")


def grid_bounds(nodes: DataFrame, delta: float = 1.0, eps: float = 1e-6, axes: list[str] = AXES) -> DataFrame:
    """low_x, high_x and so on: the grid indices inside the box of ``nodes``; a side within ``eps`` of an index is on it."""
    box = bounding_box(nodes, axes)
    sides = [f for a in axes for f in (F.ceil(F.col(f"min_{a}") / delta - eps).cast("int").alias(f"low_{a}"), F.floor(F.col(f"max_{a}") / delta + eps).cast("int").alias(f"high_{a}"))]
    return box.select(*sides)


def triangle_distances(triangles: DataFrame, along: list[str] = AXES) -> DataFrame:
    """Level set (layer, x, y, z, phi) from triangles (layer and at: three corners in cells, whose order points out of the solid).

    Every triangle meets the grid lines along each axis in its bounding box; each meeting gives the grid points before and after it with their
    signed axis distance; of several values at a point the nearest counts (ties: the smaller). ``prune`` the result for a band of one
    cell. An explosion to the grid lines of each triangle, an aggregation by point; lines run through edges and corners as well.
    """
    out = None
    for a in along:
        b, c = [x for x in ("x", "y", "z", "x", "y")[AXES.index(a) + 1 : AXES.index(a) + 3]]
        at = F.col("at")
        low = {x: F.least(*[at[i][x] for i in range(3)]) for x in (b, c)}
        high = {x: F.greatest(*[at[i][x] for i in range(3)]) for x in (b, c)}
        rows = triangles.select("layer", "at", triangle_normal(at)[AXES.index(a)].alias("n")).where("n <> 0")
        for x in (b, c):
            inside = (F.ceil(low[x]) <= F.floor(high[x]))
            rows = rows.where(inside).withColumn(x, F.explode(F.sequence(F.ceil(low[x]).cast("int"), F.floor(high[x]).cast("int"))))
        # twice the areas of the three parts into which the line cuts the triangle's projection
        part = lambda i, j: (at[i][b] - F.col(b)) * (at[j][c] - F.col(c)) - (at[j][b] - F.col(b)) * (at[i][c] - F.col(c))  # noqa: B023, E731
        w = [part(1, 2), part(2, 0), part(0, 1)]
        whole = w[0] + w[1] + w[2]
        rows = rows.where(F.least(*[x * F.signum(whole) for x in w]) >= 0)
        hit = (w[0] * at[0][a] + w[1] * at[1][a] + w[2] * at[2][a]) / whole
        rows = rows.select("layer", b, c, "n", hit.alias("hit")).withColumn(a, F.explode(F.array_distinct(F.array(F.floor("hit"), F.ceil("hit"))).cast("array<int>")))
        rows = rows.select("layer", *AXES, ((F.col(a) - F.col("hit")) * F.signum("n")).alias("phi"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("layer", *AXES).agg(F.min_by("phi", F.struct(F.abs("phi"), F.col("phi"))).alias("phi"))


def level_sets_of(elements: DataFrame, nodes: DataFrame, delta: float = 1.0, removed: dict[str, tuple[float | None, float | None]] | None = None, eps: float = 1e-6, axes: list[str] = AXES, high: dict[str, int] | None = None) -> DataFrame:
    """Level sets from a volume mesh of tetrahedra, or of triangles on two ``axes``: layer m is the solid of all materials up to m, in cells of ``delta``.

    Interfaces, then the surfaces of each material, then distances; points of which no neighbour has the other sign are not pruned. Tetrahedra go by the
    orientation of their faces, triangles by crossings (see ``parity``, where ``high`` is explained).
    """
    if len(axes) == 2:
        from .parity import volumes_to_level_sets

        return volumes_to_level_sets(elements, nodes, axes, delta=delta, removed=removed, eps=eps, high=high)
    scaled = nodes.select("node_id", *[(F.col(a) / float(delta)).alias(a) for a in AXES])
    cells_removed = {a: tuple(None if s is None else s / delta for s in sides) for a, sides in (removed or {}).items()}
    faces = oriented_interfaces(elements, scaled, cells_removed, eps / delta)
    top = elements.agg(F.max("material")).first()[0]
    if top is None:
        return triangle_distances(faces)
    m = F.explode(F.sequence("mat_low", F.least(F.col("mat_high"), F.lit(top + 1)) - 1))
    return triangle_distances(faces.where(F.col("mat_low") <= top).select(m.alias("layer"), "at"))
