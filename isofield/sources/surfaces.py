"""Surface and volume meshes in further text formats: VTK polygons, VTK XML, and grids that build elements from faces and edges.

Sections are ranges of line numbers; where a format lets numbers run on over lines, every number gets its place from a running sum of
the numbers a line holds. Only headers, a few lines, come to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .meshes import _numbers, _section, lines


def _each(rows: DataFrame) -> DataFrame:
    """(no, each): the words of lines that have some."""
    return rows.select("no", F.filter(F.split("line", r"\s+"), lambda x: x != "").alias("each")).where(F.size("each") > 0)


def _even(rows: DataFrame) -> tuple[DataFrame, int, int] | None:
    """(i, each), how many lines there are and how many words each has, if they follow each other and all have as many; one row comes to the driver."""
    each = _each(rows)
    size = F.size("each")
    least, most, first, last, n = each.agg(F.min(size), F.max(size), F.min("no"), F.max("no"), F.count("*")).first()
    return (each.select((F.col("no") - first).alias("i"), "each"), n, most) if n and least == most and last - first + 1 == n else None


def stream(rows: DataFrame, kind: str = "double") -> DataFrame:
    """(i, v): the numbers of consecutive lines (no, line) in order, from 0. Lines of equally many numbers say by their own number which these are."""
    even = _even(rows)
    n = even[0].select((F.col("i") * even[2]).alias("before"), "each") if even else numbered(_each(rows), ["no"], F.size("each"), "stream")
    return n.select("before", F.posexplode("each").alias("at", "v")).select((F.col("before") + F.col("at")).alias("i"), F.col("v").try_cast(kind).alias("v"))


def _coordinates(rows: DataFrame) -> DataFrame:
    """(node_id, x, y, z) of consecutive lines that hold three numbers a node, on one line or not."""
    even = _even(rows)
    if even and even[2] == 3:
        return even[0].select(F.col("i").alias("node_id"), *[F.col("each")[k].try_cast("double").alias(a) for k, a in enumerate("xyz")])
    part = [F.max(F.when(F.col("i") % 3 == k, F.col("v"))).alias(a) for k, a in enumerate("xyz")]
    return stream(rows).groupBy(F.expr("i div 3").alias("node_id")).agg(*part)


def read_vtk_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Legacy ASCII polygons or lines: nodes (node_id, x, y, z and, if the file has point scalars, value) and elements (elem_id, nodes)."""
    rows = lines(spark, path)
    heads = rows.where(F.col("line").rlike(r"^(DATASET|POINTS|POLYGONS|LINES|POINT_DATA|CELL_DATA|SCALARS|LOOKUP_TABLE|NORMALS|VECTORS)\b")).orderBy("no").collect()  # a few rows
    at: dict[str, tuple[int, list[str]]] = {}
    for h in heads:
        at.setdefault(h["line"].split()[0], (h["no"], h["line"].split()))
    shapes = at.get("POLYGONS") or at.get("LINES")
    if at.get("DATASET", (0, ["", ""]))[1][1] != "POLYDATA" or "POINTS" not in at or not shapes:
        raise ValueError("not a surface of polygons or lines")
    end = lambda no: min((h["no"] for h in heads if h["no"] > no), default=1 << 62) - 1
    span = lambda no: rows.where(F.col("no").between(no + 1, end(no)))
    nodes = _coordinates(span(at["POINTS"][0]))
    elements = _section(rows, shapes[0] + 1, int(shapes[1][1])).select(F.col("i").alias("elem_id"), F.slice(_numbers("line", "int"), 2, 1 << 20).alias("nodes"))
    if "POINT_DATA" in at and "LOOKUP_TABLE" in at and at["LOOKUP_TABLE"][0] > at["POINT_DATA"][0]:
        values = stream(span(at["LOOKUP_TABLE"][0])).select(F.col("i").alias("node_id"), F.col("v").alias("value"))
        nodes = nodes.join(values, "node_id", "left")
    return nodes, elements


def _arrays(rows: DataFrame) -> dict[str, DataFrame]:
    """The ASCII arrays of a VTK XML file by name (Points where they have none); tags stand on lines of their own."""
    heads = rows.where(F.col("line").startswith("<")).orderBy("no").select("no", "line").collect()  # tags only
    found, parent = {}, ""
    for h, after in zip(heads, heads[1:], strict=False):
        tag = re.match(r"<(\w+)", h["line"])
        if not tag:
            continue
        if tag[1] != "DataArray":
            parent = tag[1]
            continue
        if 'format="ascii"' not in h["line"]:
            raise ValueError("only ascii arrays can be read")
        name = re.search(r'Name="([^"]*)"', h["line"])
        key = "Points" if parent == "Points" else f"{parent}/{name[1] if name else ''}"
        found[key] = rows.where(F.col("no").between(h["no"] + 1, after["no"] - 1))
    return found


def _shapes(connectivity: DataFrame, offsets: DataFrame) -> DataFrame:
    """(elem_id, nodes): the ids of each element, whose offsets say where it ends."""
    ends = stream(offsets, "bigint").select(F.col("i").alias("elem_id"), F.col("v").alias("end"))
    even = _even(connectivity)
    if even:
        each, lines_, width = even
        n, whole = ends.agg(F.count("*"), F.count(F.when(F.col("end") == (F.col("elem_id") + 1) * width, 1))).first()
        if n == whole == lines_:
            # an element a line
            return each.select(F.col("i").alias("elem_id"), F.transform("each", lambda x: x.try_cast("int")).alias("nodes"))
    starts = ends.select((F.col("elem_id") + 1).alias("elem_id"), F.col("end").alias("start"))
    spans = ends.join(starts, "elem_id", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    at = spans.select("elem_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    ids = at.join(stream(connectivity, "int"), "i")
    return ids.groupBy("elem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("nodes"))


def read_vtp(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """VTK XML polygons or lines (ASCII): nodes (node_id, x, y, z and a column for each point array) and elements (elem_id, nodes)."""
    found = _arrays(lines(spark, path))
    kind = next((k for k in ("Polys", "Lines") if f"{k}/connectivity" in found), None)
    if "Points" not in found or not kind:
        raise ValueError("no points, or neither polygons nor lines")
    nodes = _coordinates(found["Points"])
    for key, rows in found.items():
        if key.startswith("PointData/"):
            nodes = nodes.join(stream(rows).select(F.col("i").alias("node_id"), F.col("v").alias(key[10:])), "node_id", "left")
    return nodes, _shapes(found[f"{kind}/connectivity"], found[f"{kind}/offsets"])


def read_vtu(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """VTK XML volume (ASCII): nodes (node_id, x, y, z) and elements (elem_id, nodes, material); the cell array Material, else 1."""
    found = _arrays(lines(spark, path))
    if "Points" not in found or "Cells/connectivity" not in found:
        raise ValueError("no points or no cells")
    elements = _shapes(found["Cells/connectivity"], found["Cells/offsets"])
    if "CellData/Material" in found:
        elements = elements.join(stream(found["CellData/Material"], "int").select(F.col("i").alias("elem_id"), F.col("v").alias("material")), "elem_id")
    else:
        elements = elements.withColumn("material", F.lit(1))
    return _coordinates(found["Points"]), elements


def read_grd(spark: SparkSession, path: str, dimensions: int = 3) -> tuple[DataFrame, DataFrame]:
    """Grids whose elements refer to faces (three dimensions) or edges (two), and faces to edges; -k - 1 means k the other way round.

    Regions list their elements; the first has the highest material, the last has 1.
    """
    rows = lines(spark, path)
    heads = rows.where(F.col("line").rlike(r"^(Vertices|Edges|Faces|Elements|Region|\})")).orderBy("no").collect()  # a few rows a region
    spans: dict[str, list[tuple[int, int]]] = {}
    region = False
    for h, after in zip(heads, heads[1:], strict=False):
        word = re.match(r"\w+|\}", h["line"])[0]
        region = region or word == "Region"
        if word not in ("}", "Region"):
            spans.setdefault("Members" if region and word == "Elements" else word, []).append((h["no"] + 1, after["no"] - 1))
    if not {"Vertices", "Edges", "Elements"} <= spans.keys():
        raise ValueError("no vertices, edges or elements")
    part = lambda name: rows.where(F.col("no").between(*spans[name][0]) & (F.col("line") != ""))

    def records(name: str) -> DataFrame:
        return numbered(part(name), ["no"]).select(F.col("before").alias("id"), _numbers("line", "int").alias("v"))

    v = stream(part("Vertices"))
    axis = lambda k: F.max(F.when(F.col("i") % dimensions == k, F.col("v"))) if k < dimensions else F.lit(0.0)
    nodes = v.groupBy(F.expr(f"i div {dimensions}").alias("node_id")).agg(*[axis(k).alias(a) for k, a in enumerate("xyz")])
    e = stream(part("Edges"), "int")
    ends = e.groupBy(F.expr("cast(i div 2 as int)").alias("edge")).agg(*[F.max(F.when(F.col("i") % 2 == k, F.col("v"))).alias(n) for k, n in enumerate(("a", "b"))])

    def first_nodes(of: DataFrame) -> DataFrame:
        """(id, nodes): the first node of every edge that a record refers to, in order."""
        refs = of.select("id", F.posexplode(F.slice("v", 2, 16)).alias("at", "ref")).withColumn("edge", F.when(F.col("ref") < 0, -F.col("ref") - 1).otherwise(F.col("ref")))
        met = refs.join(ends, "edge").select("id", "at", F.when(F.col("ref") < 0, F.col("b")).otherwise(F.col("a")).alias("node"))
        return met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("nodes"))

    if dimensions == 2:
        elements = first_nodes(records("Elements"))
    else:
        faces = first_nodes(records("Faces")).select(F.col("id").cast("int").alias("face"), "nodes")
        face = lambda k: F.when(F.get("v", F.lit(k)) < 0, -F.get("v", F.lit(k)) - 1).otherwise(F.get("v", F.lit(k)))
        two = records("Elements").select("id", face(1).alias("f1"), face(2).alias("f2"))
        two = two.join(faces.select(F.col("face").alias("f1"), F.col("nodes").alias("base")), "f1").join(faces.select(F.col("face").alias("f2"), F.col("nodes").alias("side")), "f2")
        elements = two.select("id", F.concat("base", F.slice(F.array_except("side", "base"), 1, 1)).alias("nodes"))
    members = None
    for k, (a, b) in enumerate(spans.get("Members", [])):
        own = stream(rows.where(F.col("no").between(a, b)), "bigint").select(F.col("v").alias("id"), F.lit(len(spans["Members"]) - k).alias("material"))
        members = own if members is None else members.union(own)
    elements = elements.join(members, "id") if members is not None else elements.withColumn("material", F.lit(1))
    return nodes, elements.select(F.col("id").alias("elem_id"), "nodes", "material")


def read_table(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """A short table of two numbers a line (angle, yield), in order of the first; for ``analytics.interpolated``. At most 10,000 lines."""
    pairs = lines(spark, path).where("line <> ''").select(_numbers("line", "double").alias("v")).select(F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))
    rows = pairs.orderBy("a", "b").limit(10_001).collect()
    if len(rows) > 10_000 or any(r["a"] is None or r["b"] is None for r in rows):
        raise ValueError("not a short table of two numbers a line")
    return [(r["a"], r["b"]) for r in rows]
