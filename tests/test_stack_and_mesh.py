"""As-of merges, layer stacks, merged nodes and turned triangles against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from isofield.functions.asof import interpolate
from isofield.operators import algebra, analytics, layers, meshing


def curve(table, v):
    if v is None or not table:
        return None
    xs = [x for x, _ in table]
    i = bisect.bisect_right(xs, v)
    if i == 0 or i == len(xs):
        return table[0 if i == 0 else -1][1]
    (a, ya), (b, yb) = table[i - 1], table[i]
    return ya + (v - a) * ((yb - ya) / (b - a))


def test_interpolation_in_tables_of_any_size(spark):
    r = random.Random(3)
    table = sorted({round(r.uniform(-50, 50), 2): r.uniform(-9, 9) for _ in range(3000)}.items())
    asked = [(i, None if i % 97 == 0 else 7.25 if i % 3 == 0 else r.uniform(-60, 60), i) for i in range(4000)] + [(i + 4000, x, 0) for i, (x, _) in enumerate(table[:50])]
    df = spark.createDataFrame(asked, "id int, v double, below int").repartition(5)
    points = spark.createDataFrame([*table, (table[5][0], -100.0), (None, 1.0), (3.0, None)], "x double, y double").repartition(4)
    got = interpolate(df, F.col("v"), points, "value")
    assert got.columns == ["id", "v", "below", "value"]
    found = {x["id"]: x["value"] for x in got.collect()}
    assert len(found) == len(asked) and all(found[i] == (None if v is None else pytest.approx(curve(table, v), abs=1e-9)) for i, v, _ in asked)
    short = {x["id"]: x["value"] for x in df.select("id", analytics.interpolated(F.col("v"), table).alias("value")).collect()}
    assert all(short[i] == (None if v is None else pytest.approx(curve(table, v), abs=1e-9)) for i, v, _ in asked)
    assert interpolate(df, F.col("v"), points.limit(0), "value").where("value is not null").count() == 0 and interpolate(df.limit(0), F.col("v"), points, "value").count() == 0
    one = df.select(analytics.interpolated(F.col("v"), [(1.0, 4.0)]).alias("value")).where("value is not null").distinct().collect()
    assert [x[0] for x in one] == [4.0]


def test_corners_at_an_open_edge(spark):
    """A column that no row holds has no sign, so nothing is put there."""
    p = spark.createDataFrame([(0, 0, 0, 0, -400), (0, 0, 0, 1, 600), (0, 1, 0, 0, -300), (0, 1, 0, 1, 700)], "layer int, x int, y int, z int, phi bigint")
    assert algebra.add_voxel_corners(p).where("y <> 0").count() == 0
    got = {tuple(r[:4]): r[4] for r in algebra.add_voxel_corners(p, axes=["x", "z"]).collect()}
    assert got[0, 0, 0, -1] == -1400 and got[0, 1, 0, -1] == -1300 and len(got) == 6


FAR = 10**9


@pytest.fixture(scope="module")
def stack(spark):
    r = random.Random(6)
    h = {}
    for x in range(9):
        for y in range(4):
            a = r.randint(1000, 9000)
            h[x, y] = [a, a + r.randint(0, 4000), a + r.randint(4000, 9000)]
    rows = [(m, x, y, z, 1000 * z - v) for (x, y), hs in h.items() for m, v in enumerate(hs) for z in range(-2, 25) if abs(1000 * z - v) <= 1500]
    other = [(x, y, z, max(5000 - 1000 * z, 1000 * z - 11000)) for x in range(9) for y in range(4) if (x + y) % 3 for z in range(3, 14) if abs(max(5000 - 1000 * z, 1000 * z - 11000)) <= 1500]
    return rows, spark.createDataFrame(rows, "layer int, x int, y int, z int, phi bigint"), other, spark.createDataFrame(other, "x int, y int, z int, phi bigint")


def side(held, p):
    """The value at a point, or far by the nearest row in its column; outside without rows."""
    if p in held:
        return held[p]
    column = sorted((q[2], v) for q, v in held.items() if q[:2] == p[:2])
    near = [v for z, v in column if z <= p[2]][-1:] or [v for z, v in column if z > p[2]][:1]
    return -FAR if near and near[0] < 0 else FAR


def joined(a, b, how):
    f = {"union": min, "intersection": max, "difference": lambda u, v: max(u, -v)}[how]
    out = {p: f(side(a, p), side(b, p)) for p in a.keys() | b.keys()}
    return {p: v for p, v in out.items() if abs(v) < FAR}


def kept(a):
    columns = {p[:2] for p in a}
    near = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    look = [(p, tuple(i + d for i, d in zip(p, s))) for p in a for s in near]
    good = {p for p, q in look if q[:2] in columns and (side(a, q) < 0) != (a[p] < 0)}
    return {p: a[p] for p in good}


def split(rows):
    out = {}
    for m, *p, v in rows:
        out.setdefault(m, {})[tuple(p)] = v
    return out


def found(df):
    return split([tuple(r) for r in df.select("layer", "x", "y", "z", "phi").collect()])


def test_planarised(stack):
    rows, df, _, _ = stack
    have = split(rows)
    plane = {(x, y, z): 1000 * z - 6300 for x in range(9) for y in range(4) for z in (5, 6, 7)}
    want = {m: kept(joined(a, plane, "intersection")) for m, a in have.items()}
    assert found(layers.planarised(df, 6300)) == want
    assert found(layers.planarised(df, 6300, fill=True)) == want | {3: plane}
    assert layers.planarised(df.limit(0), 6300).count() == 0


def test_masked(stack):
    rows, df, mask, mask_df = stack
    have, own = split(rows), {p[:3]: p[3] for p in mask}
    assert found(layers.masked(df, mask_df, over_others=True)) == {0: own} | {m + 1: joined(a, own, "union") for m, a in have.items()}
    for a in have.values():
        own = joined(own, a, "difference")
    assert found(layers.masked(df, mask_df)) == {0: own} | {m + 1: joined(a, own, "union") for m, a in have.items()}


@pytest.mark.parametrize("level, invert, wrap", [(2, False, False), (-2, False, False), (-2, False, True), (1, True, False), (-3, True, True)])
def test_boolean(stack, level, invert, wrap):
    rows, df, solid, solid_df = stack
    have, other = split(rows), {p[:3]: -p[3] if invert else p[3] for p in solid}
    want = dict(have)
    top = sorted(have)[-abs(level) :]
    for m in top:
        a = joined(have[m], other, "union" if level > 0 else "intersection")
        want[m] = kept(joined(a, have[top[0] - 1], "union") if level < 0 and wrap and top[0] else a)
    assert found(layers.boolean(df, solid_df, level, invert, wrap)) == {m: a for m, a in want.items() if a}
    with pytest.raises(ValueError, match="layers"):
        layers.boolean(df, solid_df, 4)


def test_nodes_within_a_tolerance(spark):
    """Chains across the borders of bins, many nodes at one place; against all pairs."""
    r = random.Random(2)
    at = [tuple(r.randint(-200, 200) for _ in range(3)) for _ in range(500)]
    at += [(25, 0, 0), (25 + 24, 0, 0), (-1, 0, 0), (0, 0, 0)] + [(7, 7, 7)] * 40
    rows = [(i * 3 + 1, *map(float, p)) for i, p in enumerate(at)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sum((a - b) ** 2 for a, b in zip(rows[i][1:], rows[j][1:])) <= 25 * 25:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    df = spark.createDataFrame(rows, "node_id int, x double, y double, z double").repartition(4)
    ids = meshing.merged_nodes(df, 25.0)
    assert {x["node_id"]: x["merged_id"] for x in ids.collect()} == want and len(set(want.values())) < 420
    a, b, c = rows[-1][0], rows[-2][0], rows[0][0]
    e = spark.createDataFrame([([a, b, c], 1), ([rows[1][0], rows[2][0], c], 2)], "nodes array<int>, material int")
    assert [(x["nodes"], x["material"]) for x in meshing.merged(e, ids).collect()] == ([([want[rows[1][0]], want[rows[2][0]], want[c]], 2)] if len({want[rows[1][0]], want[rows[2][0]], want[c]}) == 3 else [])
    assert meshing.merged_nodes(df.limit(0), 1.0).count() == 0


def test_turned(spark):
    r = random.Random(9)
    box = [(0, 3, 1), (0, 2, 3), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 7, 3), (2, 6, 7), (0, 6, 2), (0, 4, 6), (1, 3, 7), (1, 7, 5)]
    nodes = [(8 * b + i, 10.0 * b + (i & 1), float(i >> 1 & 1), float(i >> 2)) for b in range(3) for i in range(8)]
    tri = [(b * 100 + k, r.sample([8 * b + i for i in f], 3), b) for b in range(3) for k, f in enumerate(box)]
    n = spark.createDataFrame(nodes, "node_id int, x double, y double, z double")
    df = spark.createDataFrame(tri, "elem_id int, nodes array<int>, box int").repartition(3)
    got = meshing.turned(df, n)
    assert got.columns == df.columns and got.count() == 36
    at = {p[0]: p[1:] for p in nodes}

    def outward(row):
        a, b, c = (at[i] for i in row["nodes"])
        u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
        normal = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        middle = (10 * row["box"] + 0.5, 0.5, 0.5)
        return sum(m * (sum(p[i] for p in (a, b, c)) / 3 - middle[i]) for i, m in enumerate(normal)) > 0

    assert all(outward(row) for row in got.collect())
    band = [(k, [k, (k + 1) % 5, (k + 2) % 5]) for k in range(5)]  # a one-sided strip
    with pytest.raises(ValueError, match="one-sided"):
        meshing.turned(spark.createDataFrame(band, "elem_id int, nodes array<int>"))
    alone = spark.createDataFrame([(1, [5, 6, 7]), (2, [7, 8, 9])], "elem_id int, nodes array<int>")
    assert {tuple(x) for x in meshing.turned(alone).selectExpr("elem_id", "nodes[0]", "nodes[1]").collect()} == {(1, 5, 6), (2, 7, 8)}


def test_wafer_below(spark):
    mesh = spark.createDataFrame([(0, 1.0, 10.0, 5.0), (1, 3.0, 16.0, 9.0), (2, 2.0, 11.0, 6.0)], "node_id int, x double, y double, z double")
    nodes, elements = meshing.wafer_below(mesh)
    assert {tuple(r[1:]) for r in nodes.collect()} == {(x, y, z) for x in (-1.0, 5.0) for y in (4.0, 22.0) for z in (1.0, 5.0)}
    volume = meshing.cornered(elements, nodes).agg(F.sum(F.abs(meshing.signed_volume(F.col("at"))))).first()[0]
    assert volume == pytest.approx(6 * 18 * 4) and elements.where("material = 1").count() == 6
    none = meshing.wafer_below(mesh.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def test_meshes_are_not_broadcast(spark):
    """Elements and nodes that are exploded from a small table count as small; no plan may send them whole to the driver."""
    some = spark.range(3).select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "id")
    elements = some.select((F.col("id") * 10 + F.col("k")).alias("elem_id"), F.array(*[F.col("id") * 100 + F.col("k") + i for i in range(3)]).alias("nodes"))
    nodes = elements.select(F.explode("nodes").alias("node_id")).select("node_id", *[(F.col("node_id") % m).cast("double").alias(a) for a, m in (("x", 7), ("y", 5), ("z", 3))])
    ids = nodes.select("node_id", F.col("node_id").alias("merged_id"))
    for out in (meshing.cornered(elements, nodes), meshing.turned(elements), meshing.turned(elements, nodes.distinct()), meshing.merged(elements, ids)):
        assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
