"""Meshes of the inside: right sizes, and sides that neighbours share."""

import math

from pyspark.sql import functions as F

from isofield.functions.grid import AXES, box
from isofield.operators import meshing


def field(spark, n, phi, low=0):
    d = box(spark, {a: low for a in AXES}, {a: n for a in AXES})
    return d.select(F.lit(0).alias("layer"), *AXES, F.expr(phi).cast("bigint").alias("phi"))


def volume(e, low=-8):
    """Of the cells from ``low`` up; a field reaches one cell below its lowest point, by the sign of the column."""
    return meshing.sizes(e).where(F.col("z") >= low).agg(F.sum("size")).first()[0]


def test_plane_and_sphere(spark):
    assert math.isclose(volume(meshing.solid(field(spark, 4, "1000 * z - 1700 + 100 * x")), 0), 4 * 4 * (1.7 - 0.2), rel_tol=1e-9)
    ball = meshing.solid(field(spark, 8, "1000 * (sqrt(x * x + y * y + z * z) - 6)", -8))
    assert math.isclose(volume(ball), 4 / 3 * math.pi * 216, rel_tol=0.02)
    assert meshing.solid(field(spark, 2, "1000")).count() == 0 and math.isclose(volume(meshing.solid(field(spark, 2, "-1000"))), 2 * 2 * 4)


def test_conforming(spark):
    """Every side of a tetrahedron is shared by two, or lies on the surface or the box: their area is what Euler's relation leaves."""
    ball = meshing.solid(field(spark, 4, "1000 * (sqrt(x * x + y * y + z * z) - 2.7)", -4))
    key = F.transform("nodes", lambda n: F.concat_ws(",", *[n[c] for c in ("x", "y", "z", "dx", "dy", "dz")]))
    rows = [r[0] for r in ball.select(key).collect()]
    sides = {}
    for t in rows:
        for i in range(4):
            side = tuple(sorted(t[:i] + t[i + 1 :]))
            sides[side] = sides.get(side, 0) + 1
    assert max(sides.values()) == 2
    outer = [s for s, n in sides.items() if n == 1]
    # one closed surface: the nodes are cuts, every edge has two triangles, and corners less edges plus sides are 2
    edges = {}
    for s in outer:
        for i in range(3):
            e = tuple(s[:i] + s[i + 1 :])
            edges[e] = edges.get(e, 0) + 1
    assert set(edges.values()) == {2} and len({n for s in outer for n in s}) - len(edges) + len(outer) == 2
    assert not any(n.endswith(",0,0,0") for s in outer for n in s)


def test_two_axes(spark):
    d = field(spark, 3, "1000 * z - 1250").where("y = 0")
    e = meshing.solid(d, ["x", "z"])
    assert math.isclose(volume(e, 0), 3 * 1.25) and e.select(F.size("nodes")).distinct().count() == 1
    assert meshing.solid(d.limit(0), ["x", "z"]).count() == 0


def test_sizes_far_out(spark):
    """Volumes by cell don't depend on where the cells lie."""
    near = field(spark, 4, "1000 * (sqrt(x * x + y * y + z * z) - 2.7)", -4)
    far = near.withColumn("x", (F.col("x") + 1_000_000_000).cast("int"))
    total = lambda d, off: {(r.x - off, r.y, r.z): r.v for r in meshing.sizes(meshing.solid(d)).groupBy("x", "y", "z").agg(F.sum("size").alias("v")).collect()}
    a, b = total(near, 0), total(far, 1_000_000_000)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_parts_are_made_in_blocks(spark):
    """Triangles and segments by the rules, without corners that are sent on, exploded and joined to a table of cases."""
    d = field(spark, 3, "1000 * z - 700 - 300 * x + 900 * (y % 2)", -3).where("abs(phi) <= 1500")
    held = {(r.x, r.y, r.z): r.phi for r in d.collect()}
    for axes, rule in ((AXES, meshing.triangles_of), (["x", "z"], meshing.segments_of)):
        out = meshing.cuts(d, axes)
        for e in (out, meshing.surface(d, axes)):
            plan = e._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "posexplode" not in plan
        n, got = 1 << len(axes), {}
        for r in out.collect():
            got.setdefault((r.x, r.y, r.z), {})[r.part] = list(zip(r.edges, r.t))
        assert len(got) > 20
        for at, parts in got.items():
            corners = [tuple(at[i] + (c >> axes.index(a) & 1 if a in axes else 0) for i, a in enumerate(AXES)) for c in range(n)]
            near = [held[min((k for k in held if k[:2] == c[:2]), key=lambda k: (k[2] > c[2], abs(k[2] - c[2])))] for c in corners]  # noqa: B023
            v = [held.get(c, -1500 if s < 0 else 1500) for c, s in zip(corners, near)]
            want = rule(sum(1 << c for c in range(n) if near[c] >= 0))
            assert [[(a * n + b, v[a] / (v[a] - v[b])) for a, b in p] for p in want] == [parts[k] for k in sorted(parts)]
