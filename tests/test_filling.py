"""Volumes of stacked layers: no gaps, no overlaps, shared faces, the same extent as what the layers enclose."""

import math
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from isofield.operators import filling


def stack(spark, heights, wide=4.0, low=-9):
    """Level sets (layers from 0) of columns {(x, y): [h0, h1, ...]}, as z - h where that is within ``wide``."""
    rows = [(m, x, y, z, z - h) for (x, y), hs in heights.items() for m, h in enumerate(hs) for z in range(low, 30) if abs(z - h) <= wide]
    return spark.createDataFrame(rows, "layer int, x int, y int, z int, phi double").repartition(3)


@pytest.fixture(scope="module")
def heights():
    r = random.Random(8)
    out = {}
    for x, y in product(range(-3, 4), range(30, 36)):
        h = r.uniform(-2, 1)
        out[x, y] = [h, h + r.choice([0, r.uniform(0, 2)]), h + r.uniform(2, 9)]
    return out


def test_every_case_of_a_simplex():
    """Parts of a simplex have its extent together, and each lies on its side."""
    r = random.Random(1)
    for n in (2, 3):
        for code in range(1 << (n + 1)):
            at = [[r.random() for _ in range(n)] for _ in range(n + 1)]
            v = [r.uniform(0.1, 1) * (1 if code >> i & 1 else -1) for i in range(n + 1)]

            def size(p):
                m = [[b - a for a, b in zip(p[0], q)] for q in p[1:]]
                return abs(m[0][0] * m[1][1] - m[0][1] * m[1][0]) / 2 if n == 2 else abs(sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))) / 6

            total = 0
            for inside, nodes in filling.pieces_of(code, n):
                t = [0 if i == j else v[i] / (v[i] - v[j]) for i, j in nodes]
                p = [[a + s * (b - a) for a, b in zip(at[i], at[j])] for (i, j), s in zip(nodes, t)]
                values = [v[i] + s * (v[j] - v[i]) for (i, j), s in zip(nodes, t)]
                assert all(x <= 1e-12 if inside else x >= -1e-12 for x in values)
                total += size(p)
            assert total == pytest.approx(size(at))


def test_volumes_of_columns(spark, heights):
    got = filling.filled(stack(spark, heights, 14.0), far=20.0, low=-5)
    size = got.groupBy("x", "y", "material").agg(F.sum(filling.extent(F.col("nodes"))).alias("v"))
    found = {tuple(r[:3]): r["v"] for r in size.collect()}
    h = heights
    mean = lambda x, y, m: (2 * h[x, y][m] + 2 * h[x + 1, y + 1][m] + h[x + 1, y][m] + h[x, y + 1][m]) / 6
    for x, y in product(range(-3, 3), range(30, 35)):
        below = -5.0
        for m in range(3):
            assert found.pop((x, y, m), 0.0) == pytest.approx(mean(x, y, m) - below, abs=1e-9)
            below = mean(x, y, m)
    assert not found


def test_boxes_are_not_cells(spark, heights):
    """What a box covers is one row, however high; cells to clip lie at the layers only."""
    p = filling.pieces(stack(spark, heights, 14.0), far=20.0, low=-100_000).collect()
    boxes = [r for r in p if r["material"] >= 0]
    assert max(r["height"] for r in boxes) > 99_000 and len(p) < 6 * 5 * 60
    assert all(len(r["v"]) == (0 if r["material"] >= 0 else 24) for r in p)


def test_neighbouring_elements_share_faces(spark, heights):
    """Split boxes and clipped cells: a face inside the filled region has two elements, whatever their materials."""
    got = filling.filled(stack(spark, heights, 14.0), far=20.0, low=-3, split=True).collect()
    faces = Counter()
    for r in got:
        nodes = [tuple(round(v, 7) for v in n) for n in r["nodes"]]
        for k in range(4):
            faces[tuple(sorted(nodes[:k] + nodes[k + 1 :]))] += 1
    assert set(faces.values()) <= {1, 2}
    h = heights

    def top(x, y):
        i, j = min(math.floor(x), 2), min(math.floor(y), 34)
        u, w = x - i, y - j
        a, b, c, d = (h[i, j][2], h[i + 1, j][2], h[i, j + 1][2], h[i + 1, j + 1][2])
        return a + u * (b - a) + w * (d - b) if u >= w else a + w * (c - a) + u * (d - c)

    for face, n in faces.items():
        outer = any(all(abs(p[i] - v) < 1e-6 for p in face) for i, v in ((0, -3), (0, 3), (1, 30), (1, 35), (2, -3))) or all(abs(p[2] - top(p[0], p[1])) < 1e-5 for p in face)
        assert (n == 1) == outer, face


def test_hulls_close(spark, heights):
    """Every edge of a material's hull has an even number of its faces."""
    got = filling.hulls(filling.filled(stack(spark, heights, 14.0), far=20.0, low=-3, split=True), 7).collect()
    edges = Counter((r["material"], tuple(sorted((tuple(r["face"][i]), tuple(r["face"][j]))))) for r in got for i, j in ((0, 1), (1, 2), (0, 2)))
    assert {m for m, _ in edges} == {0, 1, 2} and all(n % 2 == 0 for n in edges.values())


def test_two_dimensions(spark):
    h = {(x, 0): [0.3 * x, 0.3 * x + 2.5] for x in range(5)}
    got = filling.filled(stack(spark, h, 6.0), ["x", "z"], far=9.0, low=-2)
    found = {tuple(r[:2]): r[2] for r in got.groupBy("x", "material").agg(F.sum(filling.extent(F.col("nodes"), ["x", "z"]))).collect()}
    assert found == {k: pytest.approx(v) for x in range(4) for k, v in (((x, 0), 0.3 * x + 0.15 + 2), ((x, 1), 2.5))}


def test_steep_sides_and_empty(spark):
    """Columns that differ by more than the band: every cell between the heights is cut, by sign where no row lies."""
    h = {(x, y): [20.5 if x < 2 else 0.5] for x in range(4) for y in range(3)}
    got = filling.filled(stack(spark, h, 1.5), far=1.5, low=-2, split=True)
    total = got.agg(F.sum(filling.extent(F.col("nodes")))).first()[0]
    # flat parts exactly; the wall stands half way, where -far and far meet
    assert total == pytest.approx(2 * 22.5 + 2 * 2.5 + 2 * (2.5 + 20 * 0.5), abs=0.5)
    none = stack(spark, h).limit(0)
    assert filling.filled(none).count() == 0 and filling.pieces(none).count() == 0


def test_volumes_where_they_are_made(spark, heights):
    """Sums by column of cells, far out too, are those of the layers' means; nothing is joined for them, and one sum crosses the shuffle for each."""
    far = stack(spark, heights, 14.0).withColumn("x", (F.col("x") + 1_000_000_000).cast("int"))
    out = filling.volumes(far, far=20.0, low=-5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "explode(nodes" not in plan
    got = {(v.x - 1_000_000_000, v.y, v.material): v.extent for v in out.collect()}
    h = heights
    mean = lambda x, y, m: (2 * h[x, y][m] + 2 * h[x + 1, y + 1][m] + h[x + 1, y][m] + h[x, y + 1][m]) / 6
    for x, y in product(range(-3, 3), range(30, 35)):
        for m in range(3):
            assert got.pop((x, y, m), 0.0) == pytest.approx(mean(x, y, m) - (mean(x, y, m - 1) if m else -5.0), abs=1e-12)
    assert not got
