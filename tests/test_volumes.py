"""Volume meshes: orientation, interfaces, hulls and level sets in three dimensions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from isofield.operators import meshing


@pytest.fixture(scope="module")
def cubes(spark):
    """Boxes of 4 x 4 cells over one another, 2 high each, as tetrahedra along paths of the axes; materials 0 and 1 from below."""
    nodes, elements = {}, []

    def node(p):
        return nodes.setdefault(p, len(nodes))

    for x, y, z in itertools.product(range(2), range(2), range(2)):
        for order in itertools.permutations(range(3)):
            p, ids = [x * 2, y * 2, z * 2], []
            ids.append(node(tuple(p)))
            for a in order:
                p[a] += 2
                ids.append(node(tuple(p)))
            elements.append((len(elements), ids, z))
    n = spark.createDataFrame([(i, *map(float, p)) for p, i in nodes.items()], "node_id bigint, x double, y double, z double")
    return n, spark.createDataFrame(elements, "elem_id bigint, nodes array<int>, material int")


def test_volume_and_orientation(cubes):
    nodes, elements = cubes
    v = meshing.cornered(elements, nodes).select(meshing.signed_volume(F.col("at")).alias("v"), meshing.orientation(F.col("at")).alias("o")).collect()
    assert len(v) == 48 and all(math.isclose(abs(r["v"]), 8 / 6) and r["o"] == math.copysign(1, r["v"]) for r in v)


def test_interfaces_point_out(cubes):
    nodes, elements = cubes
    f = meshing.oriented_interfaces(elements, nodes)
    of = f.select("mat_low", "mat_high", F.array(*meshing.triangle_normal(F.col("at"))).alias("n"), F.col("at")[0].alias("p")).collect()
    # between the materials: 8 triangles, all upwards; outside: 2 * 4 sides of 4 triangles, top and bottom 8 each
    between = [r for r in of if (r["mat_low"], r["mat_high"]) == (0, 1)]
    assert len(between) == 8 and all(r["n"][2] > 0 and r["p"]["z"] == 2 for r in between) and len(of) == 8 + 16 + 32
    for r in of:
        if r["mat_high"] == 2:
            axis = max(range(3), key=lambda i: abs(r["n"][i]))
            assert (r["n"][axis] > 0) == (r["p"]["xyz"[axis]] == 4)
    kept = meshing.oriented_interfaces(elements, nodes, {"x": (0.0, 4.0), "y": (0.0, 4.0), "z": (0.0, None)})
    assert kept.count() == 16


def test_level_sets(cubes):
    nodes, elements = cubes
    ls = meshing.level_sets_of(elements, nodes, 0.5, {"x": (0.0, 4.0), "y": (0.0, 4.0), "z": (0.0, None)}).collect()
    for layer, top in ((0, 4), (1, 8)):
        own = [r for r in ls if r["layer"] == layer]
        assert {(r["x"], r["y"]) for r in own} == set(itertools.product(range(9), range(9))) and all(r["z"] == top and r["phi"] == 0 for r in own)
    shifted = nodes.withColumn("z", F.col("z") + 0.15)
    ls = meshing.level_sets_of(elements, shifted, 0.5, {"x": (0.0, 4.0), "y": (0.0, 4.0), "z": (0.15, None)}).collect()
    assert {(r["layer"], r["z"], round(r["phi"], 9)) for r in ls} == {(0, 4, -0.3), (0, 5, 0.7), (1, 8, -0.3), (1, 9, 0.7)} and len(ls) == 4 * 81


def test_closed_box(cubes):
    """All sides at once: the signs inside and outside, and the nearest of several distances."""
    nodes, elements = cubes
    ls = {(r["x"], r["y"], r["z"]): r["phi"] for r in meshing.level_sets_of(elements, nodes.select("node_id", *[(F.col(a) * 1.0 + 0.25).alias(a) for a in "xyz"])).where("layer = 1").collect()}
    for (x, y, z), phi in ls.items():
        inside = all(0.25 < v < 4.25 for v in (x, y, z))
        assert (phi < 0) == inside and abs(phi) <= 0.75 + 1e-9
    assert math.isclose(ls[1, 2, 2], -0.75) and math.isclose(ls[4, 2, 2], -0.25) and math.isclose(ls[5, 2, 2], 0.75) and math.isclose(ls[0, 2, 2], 0.25)


def test_cumulative_hulls(spark):
    faces = spark.createDataFrame([([1, 2], 0), ([1, 2], 1), ([2, 3], 0), ([4, 5], 1), ([4, 5], 2), ([6, 7], 2)], "face array<int>, material int")
    got = sorted((r["material"], tuple(r["face"])) for r in meshing.cumulative_hulls(faces).collect())
    want = []
    rows = [((1, 2), 0), ((1, 2), 1), ((2, 3), 0), ((4, 5), 1), ((4, 5), 2), ((6, 7), 2)]
    for m in (0, 1, 2):
        for f in sorted({f for f, _ in rows}):
            if sum(g == f and k <= m for g, k in rows) % 2:
                want.append((m, f))
    assert got == sorted(want)


def test_grid_bounds(spark):
    d = spark.createDataFrame([(0, -1.0000001, 0.2, 0.0), (1, 3.9999999, 2.7, 1.0)], "node_id int, x double, y double, z double")
    assert tuple(meshing.grid_bounds(d).first()) == (-1, 4, 1, 2, 0, 1)
