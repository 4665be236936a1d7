"""Results as files, written by the tasks that hold them, in order of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, KEY
from ..functions.numbering import numbered


def _ordered(df: DataFrame, by: list[str]) -> DataFrame:
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def write_rates(rates: DataFrame, path: str, delta: float | None = None, axes: list[str] = AXES) -> None:
    """Lines ``i j k rate``, blank separated, without header; with ``delta`` coordinates instead of indices. A folder of parts in order."""
    at = [F.col(a) if delta is None else F.col(a) * F.lit(float(delta)) for a in axes]
    _ordered(rates.select(*axes, "rate"), axes[::-1]).select(*[c.alias(a) for a, c in zip(axes, at, strict=True)], "rate").write.csv(path, sep=" ")


def write_points(points: DataFrame, path: str) -> None:
    """Points of level sets with all their columns (values, normals) as Parquet, sorted by layer and index, so that readers skip by range."""
    _ordered(points, [KEY[0], *AXES[::-1]]).write.parquet(path)


def _text(sections: list[DataFrame], path: str) -> None:
    """Lines (i, line) of consecutive sections as a folder of text parts in order; joined, they are the file."""
    out = None
    for k, s in enumerate(sections):
        s = s.select(F.lit(k).alias("section"), F.col("i").cast("bigint").alias("i"), "line")
        out = s if out is None else out.unionByName(s)
    _ordered(out, ["section", "i"]).select("line").write.text(path)


def _head(like: DataFrame, *lines: str) -> DataFrame:
    """The given lines as a section."""
    texts = F.array(*[F.lit(x) for x in lines])
    return like.sparkSession.range(0, 1, 1, 1).select(F.posexplode(texts).alias("i", "line")).select(F.col("i").cast("bigint").alias("i"), "line")


def _joined(*parts) -> Column:
    return F.concat_ws(" ", *parts)


def _xyz(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("i"), _joined("x", "y", "z").alias("line"))


def _ids(elements: DataFrame, *before: Column) -> DataFrame:
    return elements.select(F.col("elem_id").alias("i"), _joined(*before, F.array_join("nodes", " ")).alias("line"))


def _series(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias("i"), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("0")).alias("line"))


def write_dx(nodes: DataFrame, elements: DataFrame, path: str, series: list[str] = ()) -> None:
    """OpenDX: positions, connections and a data object for each column of ``nodes`` in ``series``.

    nodes: node_id (0 to n - 1), x, y, z; elements: elem_id (0 to n - 1), nodes (ids).
    """
    n, m = nodes.count(), elements.count()
    size = elements.select(F.size("nodes")).first()
    width = size[0] if size else 3
    sections = [
        _head(nodes, f'object "positions" class array type float rank 1 shape 3 items {n} data follows'),
        _xyz(nodes),
        _head(nodes, f'object "connections" class array type int rank 1 shape {width} items {m} data follows'),
        _ids(elements),
        _head(nodes, f'attribute "element type" string "{ {2: "lines", 3: "triangles", 4: "tetrahedra"}[width] }"', 'attribute "ref" string "positions"'),
    ]
    for s in series:
        sections += [_head(nodes, f'object "{s}_data" class array type float rank 0 items {n} data follows'), _series(nodes, s), _head(nodes, 'attribute "dep" string "positions"')]
    fields = ['object "profile" class field', '  component "positions" value "positions"', '  component "connections" value "connections"']
    for s in series:
        fields += [f'object "{s}" class field', '  component "positions" value "positions"', '  component "connections" value "connections"', f'  component "data" value "{s}_data"']
    _text([*sections, _head(nodes, *fields, "end")], path)


#: Numbers of VTK cell types by nodes: line, triangle, tetrahedron (fixed values).
VTK_TYPES = {2: 3, 3: 5, 4: 10}


def write_vtk(nodes: DataFrame, elements: DataFrame, path: str, series: list[str] = ()) -> None:
    """Legacy ASCII unstructured grid of lines, triangles or tetrahedra, with point scalars for ``series`` and, where ``elements`` has a
    column material, cell scalars of that name."""
    n, m = nodes.count(), elements.count()
    total = elements.agg(F.sum(F.size("nodes") + 1)).first()[0] or 0
    kind = F.create_map(*[F.lit(x) for kv in VTK_TYPES.items() for x in kv])[F.size("nodes")]
    sections = [
        _head(nodes, "# vtk DataFile Version 2.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} float"),
        _xyz(nodes),
        _head(nodes, f"CELLS {m} {total}"),
        _ids(elements, F.size("nodes").cast("string")),
        _head(nodes, f"CELL_TYPES {m}"),
        elements.select(F.col("elem_id").alias("i"), kind.cast("string").alias("line")),
    ]
    if "material" in elements.columns:
        sections += [_head(nodes, f"CELL_DATA {m}", "SCALARS Material int 1", "LOOKUP_TABLE default"), elements.select(F.col("elem_id").alias("i"), F.col("material").cast("string").alias("line"))]
    if series:
        sections.append(_head(nodes, f"POINT_DATA {n}"))
    for s in series:
        sections += [_head(nodes, f"SCALARS {s} float 1", "LOOKUP_TABLE default"), _series(nodes, s)]
    _text(sections, path)


def _array(name: str, kind: str, rows: DataFrame, parts: int = 1) -> list[DataFrame]:
    more = f' NumberOfComponents="{parts}"' if parts > 1 else ""
    return [_head(rows, f'<DataArray type="{kind}" Name="{name}"{more} format="ascii">'), rows, _head(rows, "</DataArray>")]


def _ends(elements: DataFrame) -> DataFrame:
    ends = numbered(elements, ["elem_id"], F.size("nodes"), "ends")
    return ends.select(F.col("elem_id").alias("i"), (F.col("before") + F.size("nodes")).cast("string").alias("line"))


def write_vtp(nodes: DataFrame, elements: DataFrame, path: str, series: list[str] = ()) -> None:
    """VTK XML (ASCII) of triangles or lines, with point arrays for ``series``."""
    n, m = nodes.count(), elements.count()
    size = elements.select(F.size("nodes")).first()
    kind, other = ("Lines", "Polys") if size and size[0] == 2 else ("Polys", "Lines")
    head = _head(nodes, '<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian">', "<PolyData>", f'<Piece NumberOfPoints="{n}" NumberOf{kind}="{m}" NumberOf{other}="0">', "<PointData>")
    sections = [head, *[x for s in series for x in _array(s, "Float64", _series(nodes, s))], _head(nodes, "</PointData>", "<Points>"), *_array("Points", "Float64", _xyz(nodes), 3), _head(nodes, "</Points>", f"<{kind}>")]
    sections += [*_array("connectivity", "Int64", _ids(elements)), *_array("offsets", "Int64", _ends(elements)), _head(nodes, f"</{kind}>", "</Piece>", "</PolyData>", "</VTKFile>")]
    _text(sections, path)


def write_vtu(nodes: DataFrame, elements: DataFrame, path: str) -> None:
    """VTK XML (ASCII) of a volume or surface mesh, with the cell array Material."""
    n, m = nodes.count(), elements.count()
    kind = F.create_map(*[F.lit(x) for kv in VTK_TYPES.items() for x in kv])[F.size("nodes")]
    types = elements.select(F.col("elem_id").alias("i"), kind.cast("string").alias("line"))
    material = elements.select(F.col("elem_id").alias("i"), F.col("material").cast("string").alias("line"))
    sections = [_head(nodes, '<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian">', "<UnstructuredGrid>", f'<Piece NumberOfPoints="{n}" NumberOfCells="{m}">', "<Points>"), *_array("Points", "Float64", _xyz(nodes), 3)]
    sections += [_head(nodes, "</Points>", "<Cells>"), *_array("connectivity", "Int64", _ids(elements)), *_array("offsets", "Int64", _ends(elements)), *_array("types", "UInt8", types)]
    sections += [_head(nodes, "</Cells>", "<CellData>"), *_array("Material", "Int32", material), _head(nodes, "</CellData>", "</Piece>", "</UnstructuredGrid>", "</VTKFile>")]
    _text(sections, path)


def write_grid(points: DataFrame, path: str, limit: float, only_signs: bool = False, axes: list[str] = AXES) -> None:
    """Points of a level set as OpenDX: indices, and phi held within +-``limit`` (or +-``limit`` by sign alone)."""
    value = F.when(F.col("phi") < 0, F.lit(-float(limit))).otherwise(F.lit(float(limit))) if only_signs else F.greatest(F.least(F.col("phi").cast("double"), F.lit(float(limit))), F.lit(-float(limit)))
    rows = numbered(points.select(*KEY, value.alias("v")), [KEY[0], *axes[::-1]]).withColumnRenamed("before", "i")
    n = rows.count()
    at = rows.select("i", _joined(*[F.col(a).cast("string") for a in axes]).alias("line"))
    tail = _head(rows, 'attribute "dep" string "positions"', 'object "data" class field', 'component "positions" value 1', 'component "data" value 2', "end")
    _text([_head(rows, f"object 1 class array type float rank 1 shape {len(axes)} items {n} data follows"), at, _head(rows, f"object 2 class array type float rank 0 items {n} data follows"), rows.select("i", F.col("v").cast("string").alias("line")), tail], path)
