"""The surface inside a cell: coefficients, rays, roots and normals against direct evaluation."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from isofield.functions.grid import KEY
from isofield.operators import incell


def value(corners, at):
    """Multilinear interpolation, corner by corner."""
    return sum(v * math.prod(at[b] if c >> b & 1 else 1 - at[b] for b in range(len(at))) for c, v in enumerate(corners))


def test_coefficients_rays_and_normals(spark):
    rng = random.Random(1)
    for n in (2, 3):
        rows = [([rng.uniform(-1, 1) for _ in range(1 << n)], [rng.random() for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)]) for _ in range(30)]
        d = spark.createDataFrame(rows, "c array<double>, o array<double>, d array<double>")
        at = lambda name, k: [F.col(name)[i] for i in range(k)]
        rho = incell.coefficients(at("c", 1 << n))
        got = d.select("*", F.array(*incell.along_ray(rho, at("o", n), at("d", n))).alias("p"), F.array(*incell.normal(rho, at("o", n))).alias("n")).collect()
        for r in got:
            for t in (0.0, 0.3, 1.7):
                assert math.isclose(sum(c * t**k for k, c in enumerate(r["p"])), value(r["c"], [o + t * s for o, s in zip(r["o"], r["d"], strict=True)]), abs_tol=1e-9)
            slope = [(value(r["c"], [o + (b == a) * 1e-6 for b, o in enumerate(r["o"])]) - value(r["c"], r["o"])) * 1e6 for a in range(n)]
            assert np.allclose(np.array(slope) / np.linalg.norm(slope), r["n"], atol=1e-5)
    flat = spark.range(1).select(F.array(*incell.normal([F.lit(0.0)] * 8, [F.lit(0.5)] * 3)).alias("n")).first()["n"]
    assert flat == [0.0, 0.0, 0.0]


def test_roots(spark):
    rng = random.Random(2)
    known = [sorted(rng.uniform(-3, 3) for _ in range(rng.choice((1, 2, 3)))) for _ in range(200)]
    rows = []
    for x in known:
        c = np.poly(x)[::-1] * rng.choice((-2.0, 0.5, 3.0))
        rows.append((x, [float(v) for v in c] + [0.0] * (4 - len(c))))
    d = spark.createDataFrame(rows, "x array<double>, c array<double>")
    for r in d.select("x", incell.roots([F.col("c")[i] for i in range(4)]).alias("r")).collect():
        assert np.allclose(r["x"], r["r"], atol=1e-4)
    special = [([1.0, 0.0, 0.0, 0.0], []), ([0.0, 0.0, 1.0, 0.0], [0.0, 0.0]), ([-4.0, 0.0, 1.0, 0.0], [-2.0, 2.0]), ([1.0, 0.0, 1.0, 0.0], []), ([0.0, 0.0, 0.0, 2.0], [0.0]), ([1.0, 0.0, 0.0, 1.0], [-1.0]), ([0.0, 0.0, 0.0, 0.0], [])]
    got = spark.createDataFrame(special, "c array<double>, x array<double>").select("x", incell.roots([F.col("c")[i] for i in range(4)]).alias("r")).collect()
    assert all(len(r["x"]) == len(r["r"]) and np.allclose(r["x"], r["r"]) for r in got)
    assert spark.range(1).select(incell.roots([F.lit(None).cast("double"), F.lit(1.0)]).alias("r")).first()["r"] is None


def test_first_crossing(spark):
    """(t - 0.2)(t - 0.5)(t - 0.8) rises, falls and rises; turned round it falls, rises and falls."""
    c = [F.lit(float(v)) for v in np.poly([0.2, 0.5, 0.8])[::-1]]
    r = spark.range(1).select(incell.first_crossing(c).alias("a"), incell.first_crossing([-x for x in c]).alias("b"), incell.first_crossing([-x for x in c], 0.3).alias("c"), incell.first_crossing(c, 0.6).alias("d")).first()
    assert math.isclose(r["a"], 0.5) and math.isclose(r["b"], 0.2) and math.isclose(r["c"], 0.8) and r["d"] is None


def test_entries(spark):
    plane = [(0, x, y, z, z * 1000 + x * 200 - 300) for x in range(2) for y in range(2) for z in range(2)]
    d = spark.createDataFrame(plane, "layer int, x int, y int, z int, phi bigint")
    down = ([F.lit(0.5), F.lit(0.5), F.lit(1.0)], [F.lit(0.0), F.lit(0.0), F.lit(-1.0)])
    (r,) = incell.entries(d, *down).collect()
    assert math.isclose(r["t"], 0.8) and np.allclose(r["normal"], np.array([0.2, 0, 1]) / math.sqrt(1.04))
    assert incell.entries(d.where("not (x = 1 and y = 1 and z = 1)"), *down).count() == 0
    assert incell.entries(d.limit(0), *down).count() == 0 and incell.whole_cells(d).columns == [*KEY, "rho"]
