"""Level sets from surfaces whose elements are turned either way, against analytic solids."""

import random

import pytest
from pyspark.sql import functions as F

from isofield.functions.grid import Grid
from isofield.operators import meshing, parity
from isofield.sources import shapes

BOX = [(0, 1, 3), (0, 3, 2), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 3, 7), (1, 7, 5)]


def shuffled(rows, seed=1):
    r = random.Random(seed)
    return [(layer, r.sample(list(ids), len(ids))) for layer, ids in rows]


def box_nodes(low, high):
    return [(i, *(float(h if i >> k & 1 else lo) for k, (lo, h) in enumerate(zip(low, high)))) for i in range(8)]


def rows(df):
    return {tuple(r[:4]): r["phi"] for r in df.select("layer", "x", "y", "z", "phi").collect()}


@pytest.mark.parametrize("low, high", [((0.5, 0.25, -0.25), (4.5, 3.75, 3.5)), ((0, 0, 0), (3, 2, 4)), ((-1.5, 0, 0.5), (2, 2, 2.5))])
def test_box_is_a_block(spark, low, high):
    """Corners in any order give the level set of the analytic block: inside, the nearest side along an axis."""
    nodes = spark.createDataFrame(box_nodes(low, high), "node_id int, x double, y double, z double")
    faces = spark.createDataFrame(shuffled([(0, f) for f in BOX]), "layer int, nodes array<int>")
    import math

    found = rows(parity.surfaces_to_level_sets(faces, nodes, high={a: math.floor(h) for a, h in zip("xyz", high)}))
    grid = Grid(dict(zip("xyz", (-4, -4, -4))), dict(zip("xyz", (9, 9, 9))))
    want = rows(shapes.block(spark, grid, low, high, width=1.0))
    assert len(found) > 30
    for k, v in found.items():
        assert abs(v) <= 1 and v == pytest.approx(want[k], abs=1e-9), (k, v)
    # every inner point next to a side is there
    assert all(k in found for k, v in want.items() if -1 < v < 0)


def test_sphere_from_shuffled_triangles(spark):
    """A tetrahedral mesh's surface with random turns against the oriented way, which needs the turns."""
    r = random.Random(4)
    c = (4.3, 4.1, 3.9)
    import math

    lat, lon = 9, 12
    at = lambda i, j: (c[0] + 3.1 * math.sin(math.pi * i / lat) * math.cos(2 * math.pi * j / lon), c[1] + 3.1 * math.sin(math.pi * i / lat) * math.sin(2 * math.pi * j / lon), c[2] + 3.1 * math.cos(math.pi * i / lat))
    tri = [t for i in range(lat) for j in range(lon) for t in (((i, j), (i + 1, j), (i + 1, (j + 1) % lon)), ((i, j), (i + 1, (j + 1) % lon), (i, (j + 1) % lon)))]
    tri = [[at(*p) if 0 < p[0] < lat else at(p[0], 0) for p in t] for t in tri]
    tri = [t for t in tri if len(set(t)) == 3]
    schema = "layer int, at array<struct<x:double,y:double,z:double>>"
    oriented = rows(meshing.triangle_distances(spark.createDataFrame([(0, t) for t in tri], schema)))
    found = rows(parity.level_sets(spark.createDataFrame([(0, r.sample(t, 3)) for t in tri], schema)))
    assert found.keys() == oriented.keys() and len(found) > 150
    assert all(found[k] == pytest.approx(oriented[k], abs=1e-9) for k in found)


def test_sheet_with_solid_below(spark):
    at = [[(x, y, 2.25), (x + 1, y, 2.25), (x + 1, y + 1, 2.25)] for x in range(3) for y in range(3)] + [[(x, y, 2.25), (x + 1, y + 1, 2.25), (x, y + 1, 2.25)] for x in range(3) for y in range(3)]
    sheet = spark.createDataFrame([(0, [tuple(map(float, p)) for p in t]) for t in at], "layer int, at array<struct<x:double,y:double,z:double>>")
    found = rows(parity.level_sets(sheet, high={"x": 3, "y": 3}, solid_below=True))
    assert found == {(0, x, y, z): z - 2.25 for x in range(4) for y in range(4) for z in (2, 3)}


def test_flat_volume_and_removed_sides(spark):
    """Two materials as triangles in a plane; the sides of the domain give no points, its last line is inside."""
    nodes = spark.createDataFrame([(i, float(i % 2 * 4), [0.0, 1.25, 2.5][i // 2]) for i in range(6)], "node_id int, x double, z double")
    tri = [([0, 1, 3], 0), ([3, 0, 2], 0), ([5, 2, 3], 1), ([2, 5, 4], 1)]
    volume = spark.createDataFrame(tri, "nodes array<int>, material int")
    found = rows(parity.volumes_to_level_sets(volume, nodes, ["x", "z"], removed={"x": (0.0, 4.0), "z": (0.0, None)}, high={"x": 4}))
    want = {(m, x, 0, z): z - h for m, h in ((0, 1.25), (1, 2.5)) for x in range(5) for z in (int(h), int(h) + 1)}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert rows(meshing.level_sets_of(volume, nodes, removed={"x": (0.0, 4.0), "z": (0.0, None)}, axes=["x", "z"], high={"x": 4})) == found


def test_hulls_of_two_boxes(spark):
    """Hulls share a face, which cancels in the layer that holds both."""
    a, b = box_nodes((0, 0, 0.5), (3, 3, 1.75)), box_nodes((0, 0, 1.75), (3, 3, 4.25))
    ids = {p[1:]: i for i, p in enumerate(dict.fromkeys(q[1:] for q in a + b)) for p in [(None, *p)]}
    nodes = spark.createDataFrame([(i, *p) for p, i in ids.items()], "node_id int, x double, y double, z double")
    faces = [(m, sorted(ids[box[i][1:]] for i in f)) for m, box in enumerate((a, b)) for f in BOX]
    df = spark.createDataFrame(faces, "material int, face array<int>").withColumn("face", F.col("face"))
    found = rows(parity.hulls_to_level_sets(df, nodes, removed={a: (0.0, 3.0) for a in "xy"}, high={"x": 3, "y": 3}))
    want = {(m, x, y, z): s * (z - h) for x in range(4) for y in range(4) for m, hs in enumerate(([(-1, 0.5), (1, 1.75)], [(-1, 0.5), (1, 4.25)])) for s, h in hs for z in (int(h), int(h) + 1)}
    near = {}
    for m, x, y, z in want:
        near[m, x, y, z] = min((s * (z - h) for s, h in ([(-1, 0.5), (1, 1.75)], [(-1, 0.5), (1, 4.25)])[m]), key=abs)
    assert found == {k: pytest.approx(v) for k, v in near.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "layer int, at array<struct<x:double,y:double,z:double>>")
    assert parity.level_sets(none).count() == 0 and parity.level_sets(none, ["x", "z"]).columns == ["layer", "x", "y", "z", "phi"]
