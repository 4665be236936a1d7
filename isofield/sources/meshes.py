"""Volume meshes in text formats, read as line tables: nodes (node_id, x, y, z) and elements (elem_id, nodes, material).

Headers are found by filters; lines carry their number from one ordered read, so sections are ranges of numbers and a
row's place in its section is a difference. Node ids count from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import stored


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(no, line): the lines of a text file, or of a folder of parts in order of their names, with their numbers from 0.

    Blocks of the files get their offsets from a count of lines by block; only that table (a row a block) is summed in one place.
    """
    block = ["file", "start"]
    text = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = stored(text.withColumn("at", F.monotonically_increasing_id()), "lines")
    # a block's lines were numbered one after the other, by one task, so their places need no sorting
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    offsets = sizes.select(*block, (F.sum("n").over(Window.orderBy(*block)) - F.col("n") - F.col("first")).alias("offset"))
    return rows.join(F.broadcast(offsets), block).select((F.col("at") + F.col("offset")).alias("no"), F.trim("value").alias("line"))


def _numbers(line: Column | str, kind: str) -> Column:
    return F.transform(F.split(F.trim(F.col(line) if isinstance(line, str) else line), r"\s+"), lambda x: x.try_cast(kind))


def _section(rows: DataFrame, start: int, count: int) -> DataFrame:
    return rows.where(F.col("no").between(start, start + count - 1)).withColumn("i", F.col("no") - start)


def _nodes(rows: DataFrame) -> DataFrame:
    v = rows.withColumn("v", _numbers("line", "double"))
    return v.select(F.col("i").alias("node_id"), *[F.coalesce(F.get("v", F.lit(k)), F.lit(0.0)).alias(a) for k, a in enumerate("xyz")])


def read_dx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """OpenDX: objects "positions", "connections" and "data", each with a header that ends in ``items N data follows``."""
    rows = lines(spark, path)
    heads = rows.where(F.col("line").startswith("object")).orderBy("no").collect()  # one row a section
    found = {}
    for h in heads:
        if m := re.match(r'object\s+"?(\w+)"?.*items\s+(\d+)\s+data follows', h["line"]):
            found[m[1]] = _section(rows, h["no"] + 1, int(m[2]))
    if not {"positions", "connections"} <= found.keys():
        raise ValueError("the file has no positions or no connections")
    elements = found["connections"].select(F.col("i").alias("elem_id"), _numbers("line", "int").alias("nodes"))
    if "data" in found:
        elements = elements.join(found["data"].select(F.col("i").alias("elem_id"), F.col("line").try_cast("int").alias("material")), "elem_id")
    else:
        elements = elements.withColumn("material", F.lit(1))
    return _nodes(found["positions"]), elements


def read_vtk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Legacy ASCII VTK, unstructured grids: tetrahedra (type 10) and triangles (5); a quad (9) becomes two triangles; other types are dropped."""
    rows = lines(spark, path)
    heads = rows.where(F.col("line").rlike(r"^(DATASET|POINTS|CELLS|CELL_TYPES|CELL_DATA|SCALARS|LOOKUP_TABLE)\b")).orderBy("no").collect()  # a few rows
    at = {}
    for h in heads:
        at.setdefault(h["line"].split()[0], (h["no"], h["line"].split()))
    if at.get("DATASET", (0, ["", ""]))[1][1] != "UNSTRUCTURED_GRID" or not {"POINTS", "CELLS", "CELL_TYPES"} <= at.keys():
        raise ValueError("not an unstructured grid with cell types")
    count = lambda k: int(at[k][1][1])
    nodes = _nodes(_section(rows, at["POINTS"][0] + 1, count("POINTS")))
    cells = _section(rows, at["CELLS"][0] + 1, count("CELLS")).select("i", F.slice(_numbers("line", "int"), 2, 8).alias("nodes"))
    types = _section(rows, at["CELL_TYPES"][0] + 1, count("CELL_TYPES")).select("i", F.col("line").try_cast("int").alias("type"))
    elements = cells.join(types, "i").where(F.col("type").isin(5, 9, 10))
    if "LOOKUP_TABLE" in at and "CELL_DATA" in at:
        data = _section(rows, at["LOOKUP_TABLE"][0] + 1, count("CELL_DATA")).select("i", F.col("line").try_cast("int").alias("material"))
        elements = elements.join(data, "i")
    else:
        elements = elements.withColumn("material", F.lit(1))
    corner = lambda *k: F.array(*[F.get("nodes", F.lit(i)) for i in k])
    parts = F.when(F.col("type") == 9, F.array(corner(0, 1, 2), corner(0, 2, 3))).otherwise(F.array(F.col("nodes")))
    return nodes, elements.select(F.col("i").alias("elem_id"), F.explode(parts).alias("nodes"), "material")


def read_str(spark: SparkSession, path: str, ignored: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Tetrahedra in ASCII: ``c id x y z`` nodes and ``T id region n n n n`` elements (ids from 1); regions in ``ignored`` are dropped and the others
    numbered anew from 0 in order."""
    rows = lines(spark, path).select(F.split("line", r"\s+").alias("v"))
    nodes = rows.where("v[0] = 'c'").select((F.get("v", F.lit(1)).try_cast("bigint") - 1).alias("node_id"), *[F.get("v", F.lit(i + 2)).try_cast("double").alias(a) for i, a in enumerate("xyz")])
    tets = rows.where("v[0] = 'T'").select((F.get("v", F.lit(1)).try_cast("bigint") - 1).alias("elem_id"), F.array(*[F.get("v", F.lit(i)).try_cast("int") - 1 for i in range(3, 7)]).alias("nodes"), F.get("v", F.lit(2)).try_cast("int").alias("region"))
    tets = tets.where(~F.col("region").isin(*ignored)) if ignored else tets
    number = tets.select("region").distinct().withColumn("material", F.row_number().over(Window.orderBy("region")) - 1)
    return nodes, tets.join(F.broadcast(number), "region").select("elem_id", "nodes", "material")


def transformed(nodes: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), negate: tuple[bool, ...] = (False, False, False), shift: tuple[float, ...] = (0.0, 0.0, 0.0), scale: float = 1.0) -> DataFrame:
    """Axes in the given order, signs turned where asked, then shifted and scaled. Only columns change."""
    return nodes.select("node_id", *[(((-F.col(a) if n else F.col(a)) + s) * scale).alias(b) for a, b, n, s in zip(axes, "xyz", negate, shift, strict=True)])


def mapped_materials(elements: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Materials renamed; those that map to 0 or less, and those that aren't named, are dropped."""
    kind = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return elements.withColumn("material", F.try_element_at(kind, F.col("material"))).where("material > 0")
