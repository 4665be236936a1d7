"""Stencils by blocks against look-ups in a dictionary: negative indices, borders, images beyond bounds, other columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from isofield.functions.grid import AXES, Boundary, Grid
from isofield.operators import algebra, analytics, blocks, stencil


def field(seed, n=700, low=-40, high=45):
    r = random.Random(seed)
    return {(r.choice((0, 3)), r.randint(low, high), r.randint(low, high), r.randint(-4, 4)): r.randint(-1500, 1500) for _ in range(n)}


@pytest.fixture(scope="module")
def points(spark):
    held = field(1)
    return held, spark.createDataFrame([(*k, v, [k[1], k[2]]) for k, v in held.items()], "layer int, x int, y int, z int, phi bigint, more array<int>").repartition(5)


def test_offsets(points):
    held, df = points
    offsets = {"a": (1, 0, 0), "b": (-2, 1, 0), "c": (0, 0, -1), "d": (0, 15, 1)}
    got = blocks.offset_values(df, offsets)
    assert got.columns == [*df.columns, *offsets]
    rows = {tuple(r[:4]): r for r in got.collect()}
    assert rows.keys() == held.keys()
    for k, r in rows.items():
        assert r["phi"] == held[k] and r["more"] == [k[1], k[2]]
        assert [r[n] for n in offsets] == [held.get((k[0], k[1] + o[0], k[2] + o[1], k[3] + o[2])) for o in offsets.values()]


@pytest.mark.parametrize("kind", [Boundary.PERIODIC, Boundary.REFLECTIVE, Boundary.INFINITE])
def test_boundaries(spark, kind):
    grid = Grid({"x": -3, "y": 0}, {"x": 9, "y": 40}, {"x": kind, "y": kind})
    held = {k: v for k, v in field(2, 4000, -3, 40).items() if k[1] <= 9 and k[2] >= 0}

    def wrap(i, a):
        lo, n = grid.low[a], grid.high[a] - grid.low[a]
        if kind is Boundary.PERIODIC:
            return (i - lo) % n + lo
        if kind is Boundary.REFLECTIVE:
            m = (i - lo) % (2 * n)
            return (2 * n - m if m > n else m) + lo
        return i if lo <= i <= lo + n else None

    df = spark.createDataFrame([(*k, v) for k, v in held.items()], "layer int, x int, y int, z int, phi bigint")
    got = stencil.neighbour_values(df, 2, grid).collect()
    assert len(got) == len(held)
    for r in got:
        for i, a in enumerate(AXES):
            for s in (-2, -1, 1, 2):
                k = [r["layer"], r["x"], r["y"], r["z"]]
                k[i + 1] += s
                k[1], k[2] = wrap(k[1], "x"), wrap(k[2], "y")
                assert r[f"{a}{'m' if s < 0 else 'p'}{abs(s)}"] == held.get(tuple(k)), (kind, r, a, s)


def sign(held, layer, x, y, z):
    column = sorted((k[3], v) for k, v in held.items() if k[:3] == (layer, x, y))
    near = [v for q, v in column if q <= z][-1:] or [v for q, v in column if q > z][:1]
    return None if not near else -1 if near[0] < 0 else 1


def test_prune_and_cells(points):
    held, df = points
    columns = {}
    for k, v in held.items():
        columns.setdefault(k[:3], {})[k] = v
    at = lambda layer, x, y, z: sign(columns.get((layer, x, y), {}), layer, x, y, z)
    near = [(s * (a == 0), s * (a == 1), s * (a == 2)) for a in range(3) for s in (-1, 1)]
    want = {k for k, v in held.items() if any(s is not None and (s < 0) != (v < 0) for s in (at(k[0], k[1] + d[0], k[2] + d[1], k[3] + d[2]) for d in near))}
    assert {tuple(r[:4]) for r in algebra.prune(df).collect()} == want
    for axes in (AXES, ["x", "z"]):
        steps = [tuple(c >> axes.index(a) & 1 if a in axes else 0 for a in AXES) for c in range(1 << len(axes))]
        want = {}
        for k in held:
            for d in steps:
                low = (k[0], *(i - s for i, s in zip(k[1:], d)))
                corner = [(low[0], *(i + s for i, s in zip(low[1:], e))) for e in steps]
                signs = [at(*c) for c in corner]
                if all(signs):
                    want[low] = (sum(1 << c for c, s in enumerate(signs) if s > 0), [(c, held.get(p), s) for c, (p, s) in enumerate(zip(corner, signs))])
        got = {tuple(r[:4]): (r["code"], [tuple(c) for c in r["corners"]]) for r in stencil.cells(df, axes).collect()}
        assert got == want and (want or axes == AXES)


def test_empty_null_and_reach(points):
    held, df = points
    none = df.limit(0)
    assert blocks.offset_values(none, {"a": (1, 0, 0)}).count() == 0 and stencil.cells(none).count() == 0 and algebra.prune(none).count() == 0
    assert blocks.offset_values(df.withColumn("phi", F.when(F.col("x") > 0, F.col("phi"))), {"a": (1, 0, 0)}).count() == sum(k[1] > 0 for k in held)
    with pytest.raises(ValueError, match="reach"):
        blocks.offset_values(df, {"a": (16, 0, 0)})


def _expanded(rows, width, unit, start):
    """``algebra.expand`` in plain Python: rows {(layer, x, y, z): phi}."""
    columns = {}
    for (layer, x, y, z), v in rows.items():
        columns.setdefault((layer, x, y), []).append((z, v))
    out, now = {k: v for k, v in rows.items() if abs(v) * 2 <= start}, start
    while now < width:
        now, near = min(now + 2 * unit, width), {}
        for (layer, x, y, z), v in out.items():
            for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                near.setdefault((layer, x + d[0], y + d[1], z + d[2]), []).append(v)
        for k, v in near.items():
            column = columns.get(k[:3])
            if k in out or not column:
                continue
            below = [c for c in column if c[0] <= k[3]]
            sign = (max(below) if below else min(column))[1]
            value = max(v) - unit if sign < 0 else min(v) + unit
            if abs(value) * 2 <= now:
                out[k] = value
    return out


def test_widened_in_one_shuffle(spark):
    """Bands across block borders, below zero and with holes, against plain Python; all cycles and the stencil behind them take one shuffle."""
    r = random.Random(5)
    rows = {(layer, x, y, z): 1000 * z - h for layer in (0, 1) for x in range(-37, 38) for y in range(28, 36) if r.random() < 0.8 for h in [r.randrange(-6000, 6000)] for z in range(-8, 9) if abs(1000 * z - h) <= 2500}
    d = spark.createDataFrame([(*k, v) for k, v in rows.items()], "layer int, x int, y int, z int, phi bigint")
    for start, width in ((3000, 7000), (1000, 9000), (1000, 2500)):
        out = algebra.expand(d, width, 1000, start=start)
        assert {(q.layer, q.x, q.y, q.z): q.phi for q in out.collect()} == _expanded(rows, width, 1000, start)
    real = algebra.expand(d.withColumn("phi", F.col("phi") / 1000.0), 7.0, 1.0, start=3.0)
    want = _expanded({k: v / 1000.0 for k, v in rows.items()}, 7.0, 1.0, 3.0)
    assert {(q.layer, q.x, q.y, q.z): q.phi for q in real.collect()} == want
    fused = analytics.curvature(d, (7000, 1000, 3000))
    wide = algebra.expand(d, 7000, 1000, start=3000).withColumn("phi", F.col("phi") / 1000.0)
    apart = analytics.curvature(wide).where("abs(phi) <= 0.5")
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, apart.collect())) and fused.count() > 0
    for out in (algebra.expand(d, 9000, 1000), analytics.curvature(d, (7000, 1000, 3000))):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_runs_join_within_blocks_first(spark, monkeypatch):
    """Components of runs across blocks against plain Python; only runs beside a block's border are linked by the iteration."""
    r = random.Random(11)
    rows = [(0, x, y, z, r.choice((-500, 500))) for x in range(-40, 40) for y in range(-3, 35) for z in range(3) if r.random() < 0.9]
    d = spark.createDataFrame(rows, "layer int, x int, y int, z int, phi bigint")
    links, real = [], analytics.connected_components
    monkeypatch.setattr(analytics, "connected_components", lambda e: (links.append(e.count()), real(e))[1])
    got = {(q.x, q.y, q.run): (q.sign, q.z_from, q.z_to, q.root) for q in analytics.run_components(d).collect()}
    assert {k: v[:3] for k, v in got.items()} == {(q.x, q.y, q.run): (q.sign, q.z_from, q.z_to) for q in analytics.runs(d).collect()}
    top = {k: k for k in got}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for k, a in got.items():
        for dx, dy in ((1, 0), (0, 1)):
            for run in range(1, 5):
                b = got.get((k[0] + dx, k[1] + dy, run))
                if b and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]:
                    top[find(k)] = find((k[0] + dx, k[1] + dy, run))
    assert len({(find(k), v[3]) for k, v in got.items()}) == len({find(k) for k in got}) == len({v[3] for v in got.values()}) > 10
    flags = {(q.x, q.y, q.run): q.connected for q in analytics.connected(d).collect()}
    open_ = {find(k) for k, v in got.items() if v[0] > 0 and v[2] == 1 << 30}
    assert flags == {k: find(k) in open_ for k, v in got.items() if v[0] > 0}
    border = sum(k[0] % 32 in (0, 31) or k[1] % 32 in (0, 31) for k in got)
    assert 0 < links[0] <= 2 * border < len(got)
    analytics.run_components(d.where("x between 1 and 30 and y between 1 and 30")).count()
    assert links[-1] == 0
