"""Meshes and level sets written as text and read back; formats that others write."""

import pytest
from pyspark.sql import functions as F

from isofield.functions.grid import AXES, Grid
from isofield.operators import meshing
from isofield.sources import meshes, shapes, surfaces, writers


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def mesh(spark):
    grid = Grid(dict.fromkeys(AXES, -5), dict.fromkeys(AXES, 5))
    ball = shapes.sphere(spark, grid, (0.2, 0.1, 0), 3.3)
    nodes, elements = meshing.indexed(meshing.surface(ball, AXES, 1.5), ball.withColumn("speed", F.col("x") + 0.5).drop("phi"))
    return nodes.persist(), elements.persist()


def test_indexed_mesh(mesh):
    nodes, elements = mesh
    n = nodes.count()
    assert [r[0] for r in nodes.select("node_id").orderBy("node_id").collect()] == list(range(n)) and nodes.where("speed is null").count() == 0
    used = {i for r in elements.collect() for i in r["nodes"]}
    assert used == set(range(n)) and {len(r["nodes"]) for r in elements.collect()} == {3}
    # closed: every side belongs to two triangles
    sides = elements.select(F.explode(F.expr("array(array_sort(array(nodes[0], nodes[1])), array_sort(array(nodes[1], nodes[2])), array_sort(array(nodes[0], nodes[2])))")).alias("s")).groupBy("s").count()
    assert sides.where("count <> 2").count() == 0


@pytest.mark.parametrize("form", ["dx", "vtk", "vtp"])
def test_surface_round_trip(spark, mesh, tmp_path, form):
    nodes, elements = mesh
    path = str(tmp_path / "m")
    write, read = {"dx": (writers.write_dx, meshes.read_dx), "vtk": (writers.write_vtk, meshes.read_vtk), "vtp": (writers.write_vtp, surfaces.read_vtp)}[form]
    write(nodes, elements, path, ["speed"])
    n, e = read(spark, path)
    assert rows(n, "node_id", "x", "y", "z") == rows(nodes, "node_id", "x", "y", "z") and rows(e, "elem_id", "nodes") == rows(elements, "elem_id", "nodes")
    if form == "vtp":
        assert rows(n, "node_id", "speed") == rows(nodes, "node_id", "speed")


@pytest.mark.parametrize("form", ["vtk", "vtu"])
def test_volume_round_trip(spark, tmp_path, form):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.5, 0.0), (3, 0.0, 0.0, 1e-7), (4, 1.0, 1.0, 1.0)], "node_id bigint, x double, y double, z double")
    elements = spark.createDataFrame([(0, [0, 1, 2, 3], 2), (1, [1, 2, 3, 4], 1)], "elem_id bigint, nodes array<int>, material int")
    path = str(tmp_path / "v")
    write, read = {"vtk": (writers.write_vtk, meshes.read_vtk), "vtu": (writers.write_vtu, surfaces.read_vtu)}[form]
    write(nodes, elements, path)
    n, e = read(spark, path)
    assert rows(n, "node_id", "x", "y", "z") == rows(nodes, "node_id", "x", "y", "z") and rows(e, "elem_id", "nodes", "material") == rows(elements, "elem_id", "nodes", "material")


def test_polygons_with_numbers_that_run_on(spark, tmp_path):
    (tmp_path / "p.vtk").write_text("# vtk DataFile Version 3.0\nv\nASCII\nDATASET POLYDATA\nPOINTS 4 float\n0 0 0 1 0\n0 0 1 0\n1 1 -2.5e-1\nPOLYGONS 2 8\n3 0 1 2\n3 1 2 3\n\nPOINT_DATA 4\nSCALARS s float\nLOOKUP_TABLE default\n5 6\n7 8\n")
    n, e = surfaces.read_vtk_surface(spark, str(tmp_path / "p.vtk"))
    assert rows(n, "node_id", "x", "y", "z", "value") == [(0, 0.0, 0.0, 0.0, 5.0), (1, 1.0, 0.0, 0.0, 6.0), (2, 0.0, 1.0, 0.0, 7.0), (3, 1.0, 1.0, -0.25, 8.0)]
    assert rows(e, "elem_id", "nodes") == [(0, [0, 1, 2]), (1, [1, 2, 3])]


def test_grid_of_faces(spark, tmp_path):
    """One tetrahedron 0 1 2 3; the second of its faces turns an edge round."""
    (tmp_path / "g.grd").write_text("""nb_vertices = 4
nb_edges = 6
nb_faces = 4
nb_elements = 1
nb_regions = 1
Vertices (4) {
0 0 0
1 0 0
0 1 0
0 0 1
}
Edges (6) {
0 1
1 2
2 0
0 3
1 3
2 3
}
Faces (4) {
3 0 1 2
3 0 4 -4
3 1 5 -5
3 2 3 -6
}
Elements (1) {
5 0 1 2 3
}
Region ("a") {
material = Si
Elements (1) {
0
}
}
""")
    n, e = surfaces.read_grd(spark, str(tmp_path / "g.grd"))
    assert rows(n, "node_id", "x", "y", "z") == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]
    assert rows(e, "elem_id", "nodes", "material") == [(0, [0, 1, 2, 3], 1)]


def test_level_set_grid(spark, tmp_path):
    p = spark.createDataFrame([(0, 1, 2, 3, -0.4), (0, 1, 2, 4, 0.6), (0, 1, 2, 5, 9.0)], "layer int, x int, y int, z int, phi double")
    writers.write_grid(p, str(tmp_path / "g"), 1.0)
    lines = [r[0] for r in meshes.lines(spark, str(tmp_path / "g")).orderBy("no").select("line").collect()]
    assert lines[:6] == ["object 1 class array type float rank 1 shape 3 items 3 data follows", "1 2 3", "1 2 4", "1 2 5", "object 2 class array type float rank 0 items 3 data follows", "-0.4"] and lines[7] == "1.0"


def test_short_table(spark, tmp_path):
    (tmp_path / "y.txt").write_text("30 2\n0 1.5\n\n60 0\n")
    assert surfaces.read_table(spark, str(tmp_path / "y.txt")) == [(0.0, 1.5), (30.0, 2.0), (60.0, 0.0)]
    (tmp_path / "z.txt").write_text("a b\n")
    with pytest.raises(ValueError):
        surfaces.read_table(spark, str(tmp_path / "z.txt"))


def test_parts_are_read_in_order(spark, tmp_path):
    """Parts of falling and rising size, dealt to several tasks."""
    (tmp_path / "f").mkdir()
    want = []
    for k, n in enumerate((3, 500, 1, 40)):
        own = [f"{k} {i}" for i in range(n)]
        (tmp_path / "f" / f"part-0000{k}.txt").write_text("\n".join(own) + "\n")
        want += own
    got = meshes.lines(spark, str(tmp_path / "f")).collect()
    assert [r["line"] for r in sorted(got, key=lambda r: r["no"])] == want and sorted(r["no"] for r in got) == list(range(len(want)))


def test_even_lines_need_no_joins(spark, tmp_path):
    """Meshes with as many numbers on every line are read without sorting, joining or grouping them; others give the same."""
    nodes = spark.range(50).select(F.col("id").alias("node_id"), *[(F.col("id") * k / 8).alias(a) for a, k in (("x", 1), ("y", 3), ("z", 5))])
    elements = spark.range(48).select(F.col("id").alias("elem_id"), F.array(*[F.col("id") + k for k in range(3)]).alias("nodes"), (F.col("id") % 4).alias("material"))
    path = str(tmp_path / "even")
    writers.write_vtu(nodes, elements, path)
    want = [sorted(tuple(map(str, r)) for r in d.collect()) for d in (nodes, elements.select("elem_id", "nodes", "material"))]
    found = surfaces.read_vtu(spark, path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "max(CASE" not in plan(found[0]) and "Window [row_number" not in plan(found[0])
    assert "collect_list" not in plan(found[1]) and "Window [row_number" not in plan(found[1])
    text = "\n".join("\n".join(p.read_text().splitlines()) for p in sorted((tmp_path / "even").glob("part-*")) if p.stat().st_size)
    # numbers of the first element run on over two lines, those of two nodes stand on one
    one, two = text.index("\n0 1 2\n"), text.index("\n0.0 0.0 0.0\n")
    uneven = text[:two] + "\n0.0 0.0 0.0 " + text[two + len("\n0.0 0.0 0.0\n") : one] + "\n0\n1 2\n" + text[one + len("\n0 1 2\n") :]
    (tmp_path / "uneven.vtu").write_text(uneven)
    for got in (found, surfaces.read_vtu(spark, str(tmp_path / "uneven.vtu"))):
        assert [sorted(tuple(map(str, r)) for r in d.select(c).collect()) for d, c in zip(got, (["node_id", "x", "y", "z"], ["elem_id", "nodes", "material"]), strict=True)] == want
