"""Algebraic properties, analytic solutions and small known cases."""

import math

import pytest
from pyspark.sql import functions as F

from isofield.functions import random
from isofield.functions.grid import KEY, Boundary, Grid, dequantise, quantise, stored_bits
from isofield.operators import algebra, analytics, meshing
from isofield.operators.components import connected_components
from isofield.operators.weno import weno_slopes
from isofield.sources import meshes, parameters, shapes, writers
from isofield.streaming import streamed_rates

G = Grid({"x": 0, "y": 0, "z": -6}, {"x": 12, "y": 6, "z": 6}, {"x": Boundary.PERIODIC, "y": Boundary.PERIODIC})


def points(df):
    return {tuple(r[:4]): round(r[4], 9) for r in df.select(*KEY, "phi").collect()}


@pytest.fixture(scope="module")
def two(spark):
    a = shapes.sphere(spark, Grid({"x": -6, "y": -6, "z": -6}, {"x": 6, "y": 6, "z": 6}), (0, 0, 0), 4.0)
    b = shapes.sphere(spark, Grid({"x": -6, "y": -6, "z": -6}, {"x": 8, "y": 6, "z": 6}), (2, 0, 0), 4.0)
    return a.cache(), b.cache()


def test_set_algebra(two):
    a, b = two
    union, both = algebra.combine(a, b, "union"), algebra.combine(a, b, "intersection")
    assert points(algebra.combine(a, a, "union")) == points(a)
    assert points(union) == points(algebra.combine(b, a, "union"))
    turned = algebra.complement(algebra.combine(algebra.complement(a), algebra.complement(b), "intersection"))
    shared = set(points(union)) & set(points(turned))
    assert shared and all(points(union)[k] == points(turned)[k] for k in shared)
    assert not algebra.violations(both, a, "ge").count()
    assert not algebra.violations(a, a, "signs").count()


def test_prune_and_expand(two):
    a, _ = two
    pruned = algebra.prune(a)
    assert points(algebra.prune(pruned)) == points(pruned)
    thin = algebra.reduce_width(a, 1.0)
    assert points(algebra.reduce_width(algebra.expand(thin, 3.0, 1.0), 1.0)) == points(thin)
    assert algebra.expand(thin, 5.0, 1.0).count() > algebra.expand(thin, 3.0, 1.0).count() > thin.count()


def test_layers(two):
    a, _ = two
    three = algebra.add_layers(a, 2)
    assert [r[0] for r in three.select("layer").distinct().orderBy("layer").collect()] == [0, 1, 2]
    assert algebra.add_layers(three, -1).select("layer").distinct().count() == 2
    with pytest.raises(ValueError):
        algebra.add_layers(a, -1)


def test_normals_and_curvature(spark, two):
    n = analytics.normals(two[0]).where(F.abs("phi") <= 0.5)
    worst = n.agg(F.max(F.abs(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) - 1)), F.avg((F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")) / F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))).first()
    assert worst[0] < 1e-9 and worst[1] > 0.97
    wide = shapes.sphere(spark, Grid({"x": -8, "y": -8, "z": -8}, {"x": 8, "y": 8, "z": 8}), (0, 0, 0), 5.0, 3.0)
    k = analytics.curvature(wide).where(F.abs("phi") <= 0.5).agg(F.avg("curvature")).first()[0]
    assert abs(k - 1 / 5) < 0.02


def test_connectivity_and_visibility(spark):
    g = Grid({"x": 0, "y": 0, "z": -8}, {"x": 10, "y": 10, "z": 4})
    ground = shapes.plane(spark, g, "z", 0.5)
    cave = shapes.block(spark, g, (3, 3, -6), (6, 6, -3))
    c = analytics.connected(algebra.combine(ground, cave, "difference"))
    assert {r["connected"] for r in c.where("x = 4 and y = 4").collect()} == {True, False}
    assert c.where("x = 0 and not connected").count() == 0
    v = analytics.active(analytics.visible(algebra.combine(ground, cave, "difference")), 1.0)
    assert v.where("z < -1 and visible").count() == 0 and v.where("z >= 0 and not visible").count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)] + [(10 + i, 11 + i) for i in range(60)], "u int, v int")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {10 + i: 10 for i in range(61)}
    assert connected_components(links.where("u > 1000")).count() == 0


def test_surface_of_all_square_cases():
    assert [len(meshing.segments_of(c)) for c in range(16)] == [0, 1, 1, 1, 1, 1, 2, 1, 1, 2, 1, 1, 1, 1, 1, 0]
    assert all(len(meshing.triangles_of(c)) == len(meshing.triangles_of(255 - c)) for c in range(256))


def test_sphere_mesh_is_closed(two):
    mesh = meshing.surface(algebra.expand(two[0], 5.0, 1.0, start=3.0), ["x", "y", "z"])
    ends = mesh.select("layer", F.transform("nodes", lambda n: F.struct(n["x"], n["y"], n["z"], n["dx"], n["dy"], n["dz"])).alias("n"))
    sides = ends.select(F.explode(F.expr("array(array_sort(array(n[0], n[1])), array_sort(array(n[1], n[2])), array_sort(array(n[0], n[2])))")).alias("s")).where("s[0] <> s[1]")
    assert sides.groupBy("s").count().where("count % 2 = 1").count() == 0
    r = meshing.surface_nodes(mesh).agg(F.avg(F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2))).first()[0]
    assert abs(r - 4) < 0.05


def test_interfaces(spark):
    e = spark.createDataFrame([([0, 1, 2, 3], 1), ([1, 2, 3, 4], 2)], "nodes array<int>, material int")
    f = {tuple(r["face"]): (r["mat_low"], r["mat_high"]) for r in meshing.interfaces(e).collect()}
    assert f[1, 2, 3] == (1, 2) and len(f) == 7 and f[0, 1, 2] == (1, 3)


def test_distance_transform(spark):
    s = spark.createDataFrame([(0.0, 2.25, 10.0, 2.25)], "ax double, az double, bx double, bz double")
    d = {(r["x"], r["z"]): r["phi"] for r in meshing.distances(s).collect()}
    assert abs(abs(d[5, 2]) - 0.25) < 1e-9 and abs(abs(d[5, 3]) - 0.75) < 1e-9 and d[5, 2] * d[5, 3] < 0


def test_random_is_a_function_of_its_counters(spark):
    u = spark.range(20000).select(random.uniform(5, F.col("id"), F.lit(2)).alias("u"))
    m = u.agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u"), F.countDistinct("u")).first()
    assert abs(m[0] - 0.5) < 0.01 and abs(m[1] - 1 / math.sqrt(12)) < 0.01 and 0 < m[2] and m[3] < 1 and m[4] > 19900


def test_grid_mapping(spark):
    g = Grid({"x": 0}, {"x": 4}, {"x": Boundary.REFLECTIVE})
    got = [tuple(r) for r in spark.range(-5, 7).select("id", g.wrap("x", "id"), g.reversed("x", "id")).collect()]
    assert [r[1] for r in got] == [3, 4, 3, 2, 1, 0, 1, 2, 3, 4, 3, 2] and got[0][2] is False and got[3][2] is True


def test_quantised(spark):
    worst = spark.range(0, 201).select((F.col("id") / 100 - 1).alias("p")).select(F.max(F.abs(F.col("p") - dequantise(quantise("p", 8, 1.0), 8, 1.0)))).first()[0]
    assert worst <= 1 / 255 + 1e-12
    assert [stored_bits(b) for b in (1, 2, 3, 5, 9, 60, 99)] == [1, 2, 4, 8, 16, 64, 64]


def test_parameters(tmp_path):
    text = '''// a comment
    geometry_file = "a.dx"; /* more */ grid_delta=0.5e-6; cfl_condition = 0.5; num_dimensions=2; default_disk_orientation={0,0};
    boundary_conditions = { {PERIODIC,PERIODIC}, {INFINITE, INFINITE} };
    processes = { { model_name="ConstantRates"; process_time = 20; output_times={5,1}; output_times_period_length=2; output_times_periodicity=3; parameters={ direction={0,-1,0}; constant_rates={-1} }; } };'''
    (tmp_path / "par.txt").write_text(text)
    p = parameters.read(str(tmp_path / "par.txt"))
    assert p["boundary_conditions"] == [["PERIODIC", "PERIODIC"], ["INFINITE", "INFINITE"]] and p["default_disc_orientation"] == [0, 0]
    assert parameters.output_times(p["processes"][0]) == [1, 3, 5, 7, 9]
    assert p["processes"][0]["parameters"]["direction"] == [0, -1, 0]
    for bad in ("a = 1; a = 2;", "a = {1", "}", "= 3"):
        with pytest.raises(ValueError):
            parameters.parse(bad)


def test_mesh_readers(spark, tmp_path):
    (tmp_path / "m.dx").write_text('object "positions" class array type float rank 1 shape 2 items 3 data follows\n 0 0\n 1 0\n 0 1\nobject "connections" class array type int rank 1 shape 3 items 1 data follows\n0 1 2\nattribute "ref" string "positions"\nobject "data" class array type int items 1 data follows\n4\n')
    n, e = meshes.read_dx(spark, str(tmp_path / "m.dx"))
    assert n.count() == 3 and e.first()["nodes"] == [0, 1, 2] and e.first()["material"] == 4
    (tmp_path / "m.vtk").write_text("# vtk DataFile Version 2.0\nx\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 4 float\n0 0 0\n1 0 0\n1 1 0\n0 1 0\nCELLS 1 5\n4 0 1 2 3\nCELL_TYPES 1\n9\nCELL_DATA 1\nSCALARS Material int 1\nLOOKUP_TABLE default\n7\n")
    n, e = meshes.read_vtk(spark, str(tmp_path / "m.vtk"))
    assert sorted(r["nodes"] for r in e.collect()) == [[0, 1, 2], [0, 2, 3]]
    (tmp_path / "m.str").write_text("k 3 4 3 0 2\nc 1 0 0 0\nc 2 1 0 0\nc 3 0 1 0\nc 4 0 0 1\nT 1 5 1 2 3 4 1 2 3 4\nT 2 9 1 2 3 4 1 2 3 4\n")
    n, e = meshes.read_str(spark, str(tmp_path / "m.str"), (5,))
    assert n.count() == 4 and [tuple(r) for r in e.select("nodes", "material").collect()] == [([0, 1, 2, 3], 0)]
    assert meshes.transformed(n, ("z", "x", "y"), (True, False, False), scale=2.0).where("node_id = 3").first()["x"] == -2.0
    assert meshes.mapped_materials(e, {0: 3}).first()["material"] == 3


def test_stream(spark, tmp_path):
    t = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 1, 3.0), ("2024-01-01 01:10:00", 1, 4.0)], "ts string, active_pid int, weight double").withColumn("ts", F.to_timestamp("ts"))
    t.write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "hits"))
    q = streamed_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("rates").select("rate", "n_hits").collect()) == sorted(tuple(r) for r in streamed_rates(t).select("rate", "n_hits").collect()) == [(4.0, 1), (5.0, 2)]


@pytest.mark.parametrize("order", [3, 5])
def test_weno_slopes_converge(spark, order):
    worst = []
    for n in (20, 40):
        line = spark.range(n).select(F.lit(0).alias("layer"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.sin(F.col("id") / n).alias("phi"))
        rows = weno_slopes(line, order, ["x"]).where("x_below is not null and x_above is not null").collect()
        assert len(rows) == n - order - 1
        worst.append(max(abs(s * n - math.cos(r["x"] / n)) for r in rows for s in (r["x_below"], r["x_above"])))
    assert worst[0] < 1e-2 and worst[1] < worst[0] / 2
    assert weno_slopes(line.where("x < 0"), order, ["x"]).count() == 0
    with pytest.raises(ValueError):
        weno_slopes(line, 4)


def test_writers(spark, two, tmp_path):
    a, _ = two
    writers.write_points(a, str(tmp_path / "points"))
    assert points(spark.read.parquet(str(tmp_path / "points"))) == points(a)
    rates = analytics.active(a, 1.0).withColumn("rate", F.col("x") * 0.5)
    writers.write_rates(rates, str(tmp_path / "rates"), delta=0.1)
    lines = [line.split(" ") for p in sorted((tmp_path / "rates").glob("part-*")) for line in p.read_text().splitlines()]
    assert len(lines) == rates.count() and all(len(r) == 4 and float(r[3]) == pytest.approx(float(r[0]) * 5) for r in lines)
    assert [float(r[2]) for r in lines] == sorted(float(r[2]) for r in lines)


def test_layered_rates(spark):
    rows = [(1, 0, 0, 0, 0.1, -2.0), (0, 0, 0, 0, 0.3, -1.0)]
    p = analytics.layered_rates(spark.createDataFrame(rows, "layer int, x int, y int, z int, phi double, rate double")).collect()
    assert [(x["rate"], x["stop"]) for x in p[0]["rates"]] == [(-2.0, 0.3), (-1.0, None)]


def test_crystal_rate(spark):
    known = {(1, 0, 0): 1.0, (1, 1, 0): 2.0, (1, 1, 1): 0.5, (3, 1, 1): 3.0}
    rows = []
    for (a, b, c), r in known.items():
        size = math.sqrt(a * a + b * b + c * c)
        rows += [(x / size, y / size, z / size, r) for x, y, z in ((a, b, c), (-c, a, b), (b, -c, -a))]
    d = spark.createDataFrame(rows, "nx double, ny double, nz double, r double")
    got = d.select("r", analytics.crystal_rate({k: F.lit(v) for k, v in known.items()}).alias("v")).collect()
    assert all(abs(x["r"] - x["v"]) < 1e-9 for x in got)
