"""Registered queries of the level-set library and the SQL they are held against.

All read the given tables: level sets from lineitem (whole numbers, so that results are exact), hits and schedules from events, a mesh from
the height field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import random
from ..functions.grid import AXES, KEY, Boundary, Grid, quantise
from ..operators import algebra, analytics, incell, meshing
from ..operators.stencil import cells, probed
from ..operators.weno import weno_slopes
from ..sources.heightfield import FLAT_SQL, SQL, carved, flat_level_set, heights, level_set
from ..streaming import streamed_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _layer(points: DataFrame, n: int, to: int = 0) -> DataFrame:
    return points.where(F.col("layer") == n).withColumn("layer", F.lit(to))


COUNTS = "count(*)::BIGINT AS n_points, sum((abs(phi) * 2 <= 1000)::INT)::BIGINT AS n_active, sum(phi)::BIGINT AS sum_phi"

#: Values of layer 0 and layer 2 side by side at every point that either holds, absent ones far by sign.
SIDES = f"""WITH {SQL},
u AS (SELECT x, y, z, max(phi) FILTER (layer = 0) AS a, max(phi) FILTER (layer = 2) AS b FROM ls WHERE layer IN (0, 2) GROUP BY x, y, z),
n AS (SELECT *, coalesce(last_value(a IGNORE NULLS) OVER d, first_value(a IGNORE NULLS) OVER p) AS na,
                coalesce(last_value(b IGNORE NULLS) OVER d, first_value(b IGNORE NULLS) OVER p) AS nb FROM u
      WINDOW d AS (PARTITION BY x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             p AS (PARTITION BY x, y ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT x, y, z, coalesce(a, CASE WHEN na < 0 THEN -1099511627776 ELSE 1099511627776 END) AS pa,
             coalesce(b, CASE WHEN nb < 0 THEN -1099511627776 ELSE 1099511627776 END) AS pb FROM n)"""

#: Every point of a level set ``src`` with its six neighbours' signs.
SIGNS = """q AS (SELECT layer, x AS sx, y AS sy, z AS sz, phi AS own, unnest([x - 1, x + 1, x, x, x, x]) AS x, unnest([y, y, y - 1, y + 1, y, y]) AS y,
             unnest([z, z, z, z, z - 1, z + 1]) AS z FROM {src}),
m AS (SELECT layer, x, y, z, phi, 0 AS k, NULL::INT AS sx, NULL::INT AS sy, NULL::INT AS sz, NULL::BIGINT AS own FROM {src}
      UNION ALL SELECT layer, x, y, z, NULL, 1, sx, sy, sz, own FROM q),
w AS (SELECT *, coalesce(last_value(phi IGNORE NULLS) OVER (PARTITION BY layer, x, y ORDER BY z, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(phi IGNORE NULLS) OVER (PARTITION BY layer, x, y ORDER BY z, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM m),
pr AS (SELECT layer, sx AS x, sy AS y, sz AS z, any_value(own) AS phi FROM w WHERE k = 1 GROUP BY layer, sx, sy, sz HAVING bool_or(coalesce((own < 0) <> (near < 0), false)))"""


@query(f"WITH {SQL} SELECT layer, {COUNTS} FROM ls GROUP BY layer")
def band_summary(spark, sf):
    return algebra.summary(level_set(spark, sf))


def _combined(how: str, value: str):
    @query(f"{SIDES}, r AS (SELECT 0 AS layer, x, y, z, {value} AS phi FROM s WHERE abs({value}) < 1099511627776) SELECT layer, x, y, z, phi FROM r")
    def run(spark, sf):
        ls = level_set(spark, sf)
        return algebra.combine(_layer(ls, 0), _layer(ls, 2), how).select(*KEY, "phi")

    QUERIES[how], ORACLES[how] = QUERIES.pop("run"), ORACLES.pop("run")


_combined("union", "least(pa, pb)")
_combined("intersection", "greatest(pa, pb)")
_combined("difference", "greatest(pa, -pb)")


@query(f"{SIDES}, un AS (SELECT 0 AS layer, x, y, z, least(pa, pb) AS phi FROM s WHERE abs(least(pa, pb)) < 1099511627776), {SIGNS.format(src='un')} SELECT layer, x, y, z, phi FROM pr")
def union_prune(spark, sf):
    ls = level_set(spark, sf)
    return algebra.prune(algebra.combine(_layer(ls, 0), _layer(ls, 2), "union")).select(*KEY, "phi")


@query(f"WITH {SQL} SELECT layer, count(*)::BIGINT AS n_points, sum((abs(phi) * 2 <= 1000)::INT)::BIGINT AS n_active, sum(-phi)::BIGINT AS sum_phi FROM ls GROUP BY layer")
def complement(spark, sf):
    return algebra.summary(algebra.complement(level_set(spark, sf)))


@query(f"WITH {SQL}, {SIGNS.format(src='ls')} SELECT layer, x, y, z, phi FROM pr")
def prune(spark, sf):
    return algebra.prune(level_set(spark, sf)).select(*KEY, "phi")


@query(f"""WITH {SQL}, a0 AS (SELECT * FROM ls WHERE abs(phi) * 2 <= 1000),
q AS (SELECT layer, unnest([x - 1, x + 1, x, x, x, x]) AS x, unnest([y, y, y - 1, y + 1, y, y]) AS y, unnest([z, z, z, z, z - 1, z + 1]) AS z, phi FROM a0),
g AS (SELECT layer, x, y, z, min(phi) + 1000 AS up, max(phi) - 1000 AS down FROM q GROUP BY layer, x, y, z),
n AS (SELECT g.* FROM g ANTI JOIN a0 USING (layer, x, y, z)),
m AS (SELECT layer, x, y, z, phi, 0 AS k, NULL::BIGINT AS up, NULL::BIGINT AS down FROM a0 UNION ALL SELECT layer, x, y, z, NULL, 1, up, down FROM n),
w AS (SELECT *, coalesce(last_value(phi IGNORE NULLS) OVER (PARTITION BY layer, x, y ORDER BY z, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(phi IGNORE NULLS) OVER (PARTITION BY layer, x, y ORDER BY z, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM m),
e AS (SELECT layer, x, y, z, CASE WHEN near >= 0 THEN up ELSE down END AS phi FROM w WHERE k = 1 AND near IS NOT NULL),
r AS (SELECT layer, x, y, z, phi FROM a0 UNION ALL SELECT * FROM e WHERE abs(phi) * 2 <= 3000)
SELECT layer, x, y, z, phi FROM r""")
def expand(spark, sf):
    return algebra.expand(algebra.reduce_width(level_set(spark, sf), 1000), 3000).select(*KEY, "phi")


@query(f"WITH {SQL} SELECT layer, x, y, z, phi FROM ls WHERE abs(phi) * 2 <= 1200")
def reduce_band(spark, sf):
    return algebra.reduce_width(level_set(spark, sf), 1200).select(*KEY, "phi")


@query(f"WITH {SQL} SELECT a.x, a.y, a.z, 2 * a.phi - 3 * b.phi AS phi FROM ls a JOIN ls b USING (x, y, z) WHERE a.layer = 0 AND b.layer = 1")
def linear_combination(spark, sf):
    ls = level_set(spark, sf)
    return algebra.linear_combination(_layer(ls, 0), _layer(ls, 1), 2, -3).select(*AXES, "phi")


@query(f"{SIDES} SELECT x, y, z, (pa < 0) <> (pb < 0) AS other_sign, pa > pb AS above, pa < pb AS below FROM s")
def compare_layers(spark, sf):
    ls = level_set(spark, sf)
    return algebra.compared(_layer(ls, 0), _layer(ls, 2)).drop("layer")


@query(f"""WITH {SQL}, t AS (SELECT x, y, z, phi FROM ls WHERE layer = 2 AND abs(phi) * 2 <= 1000),
j AS (SELECT t.*, max(CASE WHEN b.layer = 1 AND t.phi >= b.phi THEN 1 ELSE 0 END) AS s1, max(CASE WHEN b.layer = 0 AND t.phi >= b.phi THEN 1 ELSE 0 END) AS s0
      FROM t LEFT JOIN ls b ON b.x = t.x AND b.y = t.y AND b.z = t.z AND b.layer < 2 GROUP BY t.x, t.y, t.z, t.phi)
SELECT x, y, z, phi, CASE WHEN s1 = 0 THEN 0 WHEN s0 = 0 THEN 1 ELSE 2 END::INT AS material FROM j""")
def top_material(spark, sf):
    return analytics.top_material(level_set(spark, sf), 3)


#: The level set less a slab between 10 and 14 at odd x, in every layer.
CARVED = f"""WITH {SQL},
sb AS (SELECT layer, x, y, z::INT AS z, greatest(10000 - z * 1000, z * 1000 - 14000) AS phi FROM (SELECT layer, x, y, unnest(range(9, 16)) AS z FROM (SELECT DISTINCT layer, x, y FROM ls WHERE x % 2 = 1)) WHERE abs(greatest(10000 - z * 1000, z * 1000 - 14000)) <= 1500),
u AS (SELECT layer, x, y, z, max(a) AS a, max(b) AS b FROM (SELECT layer, x, y, z, phi AS a, NULL::BIGINT AS b FROM ls UNION ALL SELECT layer, x, y, z, NULL, phi FROM sb) GROUP BY layer, x, y, z),
n AS (SELECT *, coalesce(last_value(a IGNORE NULLS) OVER d, first_value(a IGNORE NULLS) OVER p) AS na,
                coalesce(last_value(b IGNORE NULLS) OVER d, first_value(b IGNORE NULLS) OVER p) AS nb FROM u
      WINDOW d AS (PARTITION BY layer, x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             p AS (PARTITION BY layer, x, y ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT layer, x, y, z, greatest(coalesce(a, CASE WHEN na < 0 THEN -1099511627776 ELSE 1099511627776 END),
             -coalesce(b, CASE WHEN nb < 0 THEN -1099511627776 ELSE 1099511627776 END)) AS phi FROM n),
cv AS (SELECT * FROM s WHERE abs(phi) < 1099511627776)"""


@query(f"""{CARVED}, v AS (SELECT *, coalesce(phi < min(phi) OVER (PARTITION BY layer, x, y ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS visible FROM cv)
SELECT layer, visible, count(*)::BIGINT AS n, sum(z)::BIGINT AS sum_z FROM v WHERE abs(phi) * 2 <= 1000 GROUP BY layer, visible""")
def visibility(spark, sf):
    v = analytics.active(analytics.visible(carved(level_set(spark, sf))))
    return v.groupBy("layer", "visible").agg(F.count("*").alias("n"), F.sum("z").alias("sum_z"))


RUNS = f"""{CARVED},
r0 AS (SELECT layer, x, y, z, CASE WHEN phi < 0 THEN -1 ELSE 1 END AS sgn FROM cv),
r1 AS (SELECT *, CASE WHEN lag(sgn) OVER (PARTITION BY layer, x, y ORDER BY z) = sgn THEN 0 ELSE 1 END AS c FROM r0),
r2 AS (SELECT *, sum(c) OVER (PARTITION BY layer, x, y ORDER BY z) AS run FROM r1),
r3 AS (SELECT layer, x, y, run, any_value(sgn) AS sgn, min(z) AS a FROM r2 GROUP BY layer, x, y, run),
rn AS (SELECT layer, x, y, run::INT AS run, sgn, CASE WHEN lag(run) OVER o IS NULL THEN -1073741824 ELSE a END::INT AS z_from, coalesce(lead(a) OVER o - 1, 1073741824)::INT AS z_to FROM r3
       WINDOW o AS (PARTITION BY layer, x, y ORDER BY run))"""


@query(f"{RUNS} SELECT layer, x, y, run, sgn::INT AS sign, z_from, z_to FROM rn")
def sign_runs(spark, sf):
    return analytics.runs(carved(level_set(spark, sf)))


@query(f"""{RUNS.replace('WITH', 'WITH RECURSIVE', 1)},
p AS (SELECT *, ((layer * 1000000::BIGINT + x) * 1000 + y) * 100 + run AS id FROM rn WHERE sgn > 0),
e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.layer = b.layer AND b.x = a.x + 1 AND b.y = a.y WHERE a.z_from <= b.z_to AND b.z_from <= a.z_to
      UNION ALL SELECT a.id, b.id FROM p a JOIN p b ON a.layer = b.layer AND b.x = a.x AND b.y = a.y + 1 WHERE a.z_from <= b.z_to AND b.z_from <= a.z_to),
l AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(id) AS (SELECT id FROM p WHERE z_to = 1073741824 UNION SELECT l.v FROM reach JOIN l ON l.u = reach.id)
SELECT layer, x, y, run::INT AS run, z_from, z_to, id IN (SELECT id FROM reach) AS connected FROM p""")
def connectivity(spark, sf):
    return analytics.connected(carved(level_set(spark, sf)))


@query(f"""WITH {SQL} SELECT l.layer, l.x, l.y, l.z, (a.phi - b.phi)::BIGINT AS g2x, (c.phi - d.phi)::BIGINT AS g2y, (e.phi - f.phi)::BIGINT AS g2z FROM ls l
LEFT JOIN ls a ON a.layer = l.layer AND a.x = l.x + 1 AND a.y = l.y AND a.z = l.z LEFT JOIN ls b ON b.layer = l.layer AND b.x = l.x - 1 AND b.y = l.y AND b.z = l.z
LEFT JOIN ls c ON c.layer = l.layer AND c.x = l.x AND c.y = l.y + 1 AND c.z = l.z LEFT JOIN ls d ON d.layer = l.layer AND d.x = l.x AND d.y = l.y - 1 AND d.z = l.z
LEFT JOIN ls e ON e.layer = l.layer AND e.x = l.x AND e.y = l.y AND e.z = l.z + 1 LEFT JOIN ls f ON f.layer = l.layer AND f.x = l.x AND f.y = l.y AND f.z = l.z - 1
WHERE abs(l.phi) * 2 <= 1000""")
def gradient(spark, sf):
    return analytics.active(analytics.gradient(level_set(spark, sf))).select(*KEY, "g2x", "g2y", "g2z")


def _axis(a: str) -> str:
    """Slope along an axis in SQL: the mean of both one-sided differences, at an extremum the larger."""
    up, down = f"coalesce({a}1 - phi, phi - {a}0, 0)", f"coalesce(phi - {a}0, {a}1 - phi, 0)"
    return f"CASE WHEN ({up}) * ({down}) < 0 THEN greatest({up}, {down}) ELSE (({up}) + ({down})) / 2 END AS g{a}"


def _most(a: str) -> str:
    return f"CASE WHEN abs(n{a}) > 1e-12 THEN (1 - 0.5::DOUBLE * sqrt(greatest(1 - n{a} * n{a}, 0))) / abs(n{a}) ELSE 'inf'::DOUBLE END"


MICRO = lambda c: F.round(F.col(c) * 1e6).cast("bigint").alias(c)


def normals_sql(src: str) -> str:
    """Unit normals and receptor distances of the active points of ``src`` in SQL: common table expressions that end in ``nr``."""
    return f"""d AS (SELECT layer, x, y, z, phi / 1000.0::DOUBLE AS phi FROM {src}),
n AS (SELECT d.*, a.phi AS x1, b.phi AS x0, c.phi AS y1, e.phi AS y0, f.phi AS z1, g.phi AS z0 FROM d
  LEFT JOIN d a ON a.layer = d.layer AND a.x = d.x + 1 AND a.y = d.y AND a.z = d.z LEFT JOIN d b ON b.layer = d.layer AND b.x = d.x - 1 AND b.y = d.y AND b.z = d.z
  LEFT JOIN d c ON c.layer = d.layer AND c.x = d.x AND c.y = d.y + 1 AND c.z = d.z LEFT JOIN d e ON e.layer = d.layer AND e.x = d.x AND e.y = d.y - 1 AND e.z = d.z
  LEFT JOIN d f ON f.layer = d.layer AND f.x = d.x AND f.y = d.y AND f.z = d.z + 1 LEFT JOIN d g ON g.layer = d.layer AND g.x = d.x AND g.y = d.y AND g.z = d.z - 1
  WHERE abs(d.phi) <= 0.5),
s AS (SELECT *, {_axis('x')}, {_axis('y')}, {_axis('z')} FROM n),
t AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS size FROM s),
u AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE gx / size END AS nx, CASE WHEN size = 0 THEN 0 ELSE gy / size END AS ny, CASE WHEN size = 0 THEN 1 ELSE gz / size END AS nz,
             CASE WHEN size = 0 THEN 0 ELSE -phi / size END AS d0 FROM t),
v AS (SELECT *, least(greatest(d0, -({_most('x')})), {_most('x')}) AS d1 FROM u), w AS (SELECT *, least(greatest(d1, -({_most('y')})), {_most('y')}) AS d2 FROM v),
nr AS (SELECT layer, x, y, z, nx, ny, nz, least(greatest(d2, -({_most('z')})), {_most('z')}) AS dist FROM w)"""


@query(f"""WITH {SQL}, {normals_sql('ls')}
SELECT layer, x, y, z, round(nx * 1e6)::BIGINT AS nx, round(ny * 1e6)::BIGINT AS ny, round(nz * 1e6)::BIGINT AS nz, round(dist * 1e6)::BIGINT AS dist FROM nr""")
def point_normals(spark, sf):
    """Unit normals and receptor distances of active points, in millionths."""
    ls = level_set(spark, sf).withColumn("phi", F.col("phi") / 1000.0)
    n = analytics.normals(ls).where(F.abs("phi") <= 0.5)
    return n.select(*KEY, *map(MICRO, ("nx", "ny", "nz", "dist")))


def _cycle(src: str, out: str, width: int) -> str:
    """One cycle of ``expand`` in SQL, from band ``src`` to band ``out``."""
    near = "PARTITION BY layer, x, y ORDER BY z, k ROWS BETWEEN"
    return f"""{out}q AS (SELECT layer, unnest([x - 1, x + 1, x, x, x, x]) AS x, unnest([y, y, y - 1, y + 1, y, y]) AS y, unnest([z, z, z, z, z - 1, z + 1]) AS z, phi FROM {src}),
{out}g AS (SELECT layer, x, y, z, min(phi) + 1000 AS up, max(phi) - 1000 AS down FROM {out}q GROUP BY layer, x, y, z),
{out}m AS (SELECT layer, x, y, z, phi, 0 AS k, NULL::BIGINT AS up, NULL::BIGINT AS down FROM ls UNION ALL
           SELECT layer, x, y, z, NULL, 1, up, down FROM {out}g ANTI JOIN {src} USING (layer, x, y, z)),
{out}w AS (SELECT *, coalesce(last_value(phi IGNORE NULLS) OVER ({near} UNBOUNDED PRECEDING AND CURRENT ROW), first_value(phi IGNORE NULLS) OVER ({near} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM {out}m),
{out}e AS (SELECT layer, x, y, z, CASE WHEN near >= 0 THEN up ELSE down END AS phi FROM {out}w WHERE k = 1 AND near IS NOT NULL),
{out} AS (SELECT layer, x, y, z, phi FROM {src} UNION ALL SELECT * FROM {out}e WHERE abs(phi) * 2 <= {width})"""


#: Offsets of the 18-point stencil by name.
OFFSETS = {f"{a}{'m' if s < 0 else 'p'}": {a: s} for a in AXES for s in (-1, 1)} | {f"{a}{'m' if s < 0 else 'p'}{b}{'m' if t < 0 else 'p'}": {a: s, b: t} for a, b in analytics.CROSS for s in (-1, 1) for t in (-1, 1)}


@query(f"""WITH {SQL}, {_cycle('ls', 'b1', 5000)}, {_cycle('b1', 'b2', 7000)},
o AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {d.get('x', 0)}, {d.get('y', 0)}, {d.get('z', 0)})" for n, d in OFFSETS.items())}) AS v(n, dx, dy, dz)),
q AS (SELECT p.*, o.n, p.x + dx AS hx, p.y + dy AS hy, p.z + dz AS hz FROM (SELECT * FROM b2 WHERE abs(phi) * 2 <= 1000) p CROSS JOIN o),
j AS (SELECT q.layer, q.x, q.y, q.z, q.phi, q.n, h.phi AS v FROM q JOIN b2 h ON h.layer = q.layer AND h.x = q.hx AND h.y = q.hy AND h.z = q.hz),
r AS (SELECT layer, x, y, z, any_value(phi) / 1000.0::DOUBLE AS phi, {', '.join(f"max(v) FILTER (n = '{n}') / 1000.0::DOUBLE AS {n}" for n in OFFSETS)} FROM j GROUP BY layer, x, y, z HAVING count(*) = 18),
s AS (SELECT *, (xp - xm) / 2 AS sx, (yp - ym) / 2 AS sy, (zp - zm) / 2 AS sz, xp - 2 * phi + xm AS xx, yp - 2 * phi + ym AS yy, zp - 2 * phi + zm AS zz,
        (xpyp - xpym - xmyp + xmym) / 4 AS xy, (xpzp - xpzm - xmzp + xmzm) / 4 AS xz, (ypzp - ypzm - ymzp + ymzm) / 4 AS yz FROM r),
t AS (SELECT *, sx * sx + sy * sy + sz * sz AS total FROM s)
SELECT layer, x, y, z, CASE WHEN total > 0 THEN round((xx * (sy * sy + sz * sz) + yy * (sx * sx + sz * sz) + zz * (sx * sx + sy * sy) - 2 * (sx * sy * xy + sx * sz * xz + sy * sz * yz))
       / (2 * pow(total, 1.5)) * 1e6) END::BIGINT AS curvature FROM t""")
def mean_curvature(spark, sf):
    """Of active points, in millionths, in a band that is wide enough for the eighteen neighbours; null where there is no slope."""
    c = analytics.curvature(level_set(spark, sf), (7000, 1000, 3000))
    return c.select(*KEY, F.when(F.abs("curvature") < 1e12, F.round(F.col("curvature") * 1e6).cast("bigint")).alias("curvature"))


CELLS = f"""WITH {SQL}, k AS (SELECT unnest(range(0, 8)) AS c),
tc AS (SELECT DISTINCT layer, x - (c & 1) AS x, y - (c >> 1 & 1) AS y, z - (c >> 2 & 1) AS z FROM ls, k),
q AS (SELECT layer, x AS cx, y AS cy, z AS cz, c, x + (c & 1) AS x, y + (c >> 1 & 1) AS y, z + (c >> 2 & 1) AS z FROM tc, k),
m AS (SELECT layer, x, y, z, phi, 0 AS k, NULL AS cx, NULL AS cy, NULL AS cz, NULL AS c FROM ls UNION ALL SELECT layer, x, y, z, NULL, 1, cx, cy, cz, c FROM q),
w AS (SELECT *, coalesce(last_value(phi IGNORE NULLS) OVER (PARTITION BY layer, x, y ORDER BY z, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(phi IGNORE NULLS) OVER (PARTITION BY layer, x, y ORDER BY z, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM m),
cl AS (SELECT layer, cx AS x, cy AS y, cz AS z, sum(CASE WHEN near >= 0 THEN 1 << c ELSE 0 END)::INT AS code FROM w WHERE k = 1 GROUP BY layer, cx, cy, cz HAVING count(near) = 8)"""


@query(f"{CELLS} SELECT layer, code, count(*)::BIGINT AS n FROM cl GROUP BY layer, code")
def marching_cases(spark, sf):
    return cells(level_set(spark, sf)).groupBy("layer", "code").agg(F.count("*").alias("n"))


@query(f"{CELLS} SELECT layer, x::INT AS x, y::INT AS y, z::INT AS z, code FROM cl WHERE code NOT IN (0, 255)")
def sign_change_cells(spark, sf):
    return cells(level_set(spark, sf)).where("code not in (0, 255)").select(*KEY, "code")


def _elements(corners: int, shapes: str) -> str:
    """SQL that adds to ``cl`` its corners' values and signs, and from them the elements by ``shapes`` (a list of lists of edges)."""
    return f"""vals AS (SELECT w.layer, cx AS x, cy AS y, cz AS z, list(near >= 0 ORDER BY c) AS up,
         list(coalesce(l.phi, CASE WHEN near < 0 THEN -1500 ELSE 1500 END) ORDER BY c) AS v
       FROM w LEFT JOIN ls l ON l.layer = w.layer AND l.x = w.x AND l.y = w.y AND l.z = w.z WHERE k = 1 GROUP BY w.layer, cx, cy, cz HAVING count(near) = {corners}),
parts AS ({shapes}),
edges AS (SELECT layer, x, y, z, v, list_transform(part, lambda e: [least(e[1], e[2]), greatest(e[1], e[2])]) AS part FROM (SELECT layer, x, y, z, v, unnest(part) AS part FROM parts))"""


def _edge(i: int) -> str:
    a, b = f"part[{i}][1]", f"part[{i}][2]"
    return f"({a} * 8 + {b})::INT AS edge{i}, round(v[{a} + 1]::DOUBLE / (v[{a} + 1] - v[{b} + 1])::DOUBLE * 1e6)::BIGINT AS t{i}"


def _flat(cuts: DataFrame, axes: list[str]) -> DataFrame:
    """Elements by cell with their nodes as edge (8 times the lower corner and the higher one) and t in millionths."""
    cols, n = [], 1 << len(axes)
    for i in range(len(axes)):
        e = F.get("edges", F.lit(i))
        v = F.get("t", F.lit(i)) * 1e6
        # round() of values that aren't negative, without its decimals
        whole = F.floor(v) + F.when(v - F.floor(v) >= 0.5, 1).otherwise(0)
        cols += [(F.shiftright(e, len(axes)) * 8 + e.bitwiseAND(n - 1)).cast("int").alias(f"edge{i + 1}"), whole.cast("bigint").alias(f"t{i + 1}")]
    return cuts.select(*KEY, *cols)


TETRAHEDRA = "[[0, 1, 3, 7], [0, 1, 5, 7], [0, 2, 3, 7], [0, 2, 6, 7], [0, 4, 5, 7], [0, 4, 6, 7]]"


@query(CELLS + ", " + _elements(8, f"""SELECT layer, x, y, z, v, CASE len(u) WHEN 1 THEN [[[u[1], d[1]], [u[1], d[2]], [u[1], d[3]]]] WHEN 3 THEN [[[d[1], u[1]], [d[1], u[2]], [d[1], u[3]]]]
  WHEN 2 THEN [[[u[1], d[1]], [u[1], d[2]], [u[2], d[1]]], [[u[1], d[2]], [u[2], d[1]], [u[2], d[2]]]] END AS part
  FROM (SELECT *, list_filter(t, lambda c: up[c + 1]) AS u, list_filter(t, lambda c: NOT up[c + 1]) AS d FROM (SELECT *, unnest({TETRAHEDRA}) AS t FROM vals)) WHERE len(u) BETWEEN 1 AND 3""") + f""" SELECT layer, x::INT AS x, y::INT AS y, z::INT AS z, {_edge(1)}, {_edge(2)}, {_edge(3)} FROM edges""")
def surface_triangles(spark, sf):
    """All triangles of the surface by cell, with the edges that they cut and where."""
    return _flat(meshing.cuts(level_set(spark, sf), AXES), AXES)


#: As CELLS, for squares in x and z.
SQUARES = CELLS.replace("range(0, 8)", "range(0, 4)").replace("y - (c >> 1 & 1) AS y, z - (c >> 2 & 1) AS z", "y, z - (c >> 1 & 1) AS z").replace("y + (c >> 1 & 1) AS y, z + (c >> 2 & 1) AS z", "y, z + (c >> 1 & 1) AS z").replace("HAVING count(near) = 8", "HAVING count(near) = 4")


@query(SQUARES + ", " + _elements(4, """SELECT layer, x, y, z, v, CASE len(cut) WHEN 2 THEN [cut] ELSE list_transform(list_filter([0, 1, 2, 3], lambda c: up[c + 1]), lambda c: list_filter(cut, lambda e: e[1] = c OR e[2] = c)) END AS part
  FROM (SELECT *, list_filter([[0, 1], [1, 3], [2, 3], [0, 2]], lambda e: up[e[1] + 1] <> up[e[2] + 1]) AS cut FROM vals) WHERE len(cut) > 0""") + f""" SELECT layer, x::INT AS x, y::INT AS y, z::INT AS z, {_edge(1)}, {_edge(2)} FROM edges""")
def surface_segments(spark, sf):
    """All segments of the surface in the planes of x and z, by cell."""
    return _flat(meshing.cuts(level_set(spark, sf), ["x", "z"]), ["x", "z"])


@query(f"""WITH {SQL}, p AS (SELECT x, y, z, max(phi) FILTER (layer = 2) AS phi, list(struct_pack(l := layer, phi := phi) ORDER BY layer DESC) AS held FROM ls GROUP BY x, y, z),
t AS (SELECT *, list_extract(held, 1).phi AS p2, list_extract(held, 2).l AS l1, list_extract(held, 2).phi AS p1, list_extract(held, 3).phi AS p0 FROM p WHERE phi IS NOT NULL AND abs(phi) * 2 <= 1000)
SELECT 3 AS n_layers, count(*)::BIGINT AS n_points, sum(coalesce(p1 - p2, 0))::BIGINT AS upper, sum(coalesce(p0 - p1, 0))::BIGINT AS lower FROM t""")
def layer_thickness(spark, sf):
    """Thickness of what lies between the layers at active points of the top one: the distances at which rates change."""
    ls = level_set(spark, sf).withColumn("rate", F.lit(-1.0))
    top = analytics.layered_rates(ls.withColumn("phi", F.col("phi") / 1000.0)).select("x", "y", "z", "rates")
    gap = lambda i: F.coalesce(F.round((F.get("rates", F.lit(i))["stop"] - F.when(F.lit(i) == 0, F.col("phi")).otherwise(F.get("rates", F.lit(i - 1))["stop"])) * 1000).cast("bigint"), F.lit(0))
    top = top.withColumn("phi", F.lit(None).cast("double"))
    own = ls.where("layer = 2").select("x", "y", "z", (F.col("phi") / 1000.0).alias("__p"))
    t = top.join(own, AXES).withColumn("phi", F.col("__p"))
    return t.agg(F.lit(3).alias("n_layers"), F.count("*").alias("n_points"), F.sum(gap(0)).alias("upper"), F.sum(gap(1)).alias("lower"))


@query("""WITH e AS (SELECT event_type, (event_id % 97)::INT AS t, (event_id % 7 + 1)::INT AS period, user_id FROM events),
r AS (SELECT DISTINCT event_type, t + i * period AS t FROM (SELECT *, unnest(range(0, 5)) AS i FROM e) WHERE t + i * period <= 100)
SELECT event_type, t::INT AS t FROM (SELECT * FROM r UNION SELECT DISTINCT event_type, 0 FROM e UNION SELECT DISTINCT event_type, 100 FROM e)""")
def output_schedule(spark, sf):
    """Output times of each event type as a process: stated times, repeated five times by a period, with start and end, up to 100."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", (F.col("event_id") % 97).cast("int").alias("t"), (F.col("event_id") % 7 + 1).cast("int").alias("period"))
    times = e.distinct().select("event_type", F.explode(F.expr("transform(sequence(0, 4), i -> t + i * period)")).alias("t")).where("t <= 100")
    ends = e.select("event_type").distinct().select("event_type", F.explode(F.array(F.lit(0), F.lit(100))).alias("t"))
    return times.union(ends).distinct()


@query("""WITH k AS (SELECT l_orderkey::BIGINT AS o, l_linenumber AS n, (l_partkey - 3 * l_suppkey)::BIGINT AS i FROM lineitem),
m AS (SELECT *, ((i - 5) % 40 + 40) % 40 AS p, ((i - 5) % 80 + 80) % 80 AS q FROM k)
SELECT o, n, (p + 5)::INT AS periodic, (CASE WHEN q > 40 THEN 80 - q ELSE q END + 5)::INT AS mirrored, q > 40 AS turned, CASE WHEN i BETWEEN 5 AND 45 THEN i END::INT AS open_end FROM m""")
def boundary_mapping(spark, sf):
    k = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") - 3 * F.col("l_suppkey")).alias("i"))
    g = lambda b: Grid({"x": 5}, {"x": 45}, {"x": b})
    return k.select("o", "n", g(Boundary.PERIODIC).wrap("x", "i").alias("periodic"), g(Boundary.REFLECTIVE).wrap("x", "i").alias("mirrored"), g(Boundary.REFLECTIVE).reversed("x", "i").alias("turned"), g(Boundary.INFINITE).wrap("x", "i").alias("open_end"))


def _mesh(spark, sf) -> DataFrame:
    """Triangles over the grid of columns, two a column; material by height. Node id: x * 64 + y."""
    h = heights(spark, sf).where("layer = 2")
    i, right, up, both = (F.expr(f"cast((x + {a}) * 64 + y + {b} as int)") for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)))
    return h.select(F.expr("cast(h div 10000 as int)").alias("material"), F.explode(F.array(F.array(i, right, both), F.array(i, both, up))).alias("nodes"))


MESH = f"""WITH {SQL}, el AS (SELECT x, y, (h // 10000)::INT AS material, unnest([0, 1]) AS half, x * 64 + y AS i FROM hf WHERE layer = 2),
f AS (SELECT material, unnest(CASE half WHEN 0 THEN [i, i, i + 64] ELSE [i, i, i + 1] END) AS a, unnest(CASE half WHEN 0 THEN [i + 64, i + 65, i + 65] ELSE [i + 65, i + 1, i + 65] END) AS b FROM el),
g AS (SELECT a, b, min(material) AS mat_low, max(material) AS mat_high, count(*) AS n FROM f GROUP BY a, b),
fc AS (SELECT a, b, mat_low, CASE WHEN n = 1 THEN (SELECT max(material) + 1 FROM el) ELSE mat_high END::INT AS mat_high FROM g)"""


def _top_mesh(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nodes at the heights of the top layer, in cells, and the triangles between them of which all corners are there."""
    h = heights(spark, sf).where("layer = 2")
    nodes = h.select(F.expr("x * 64 + y").cast("int").alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("h") / 1000.0).alias("z"))
    corners = meshing.cornered(_mesh(spark, sf).withColumn("elem_id", F.monotonically_increasing_id()), nodes)
    return nodes, corners.where(F.size("at") == 3)


TOP = f"""WITH {SQL}, t AS (SELECT x, y, h FROM hf WHERE layer = 2),
tr AS (SELECT a.x AS x1, a.y AS y1, a.h AS h1, b.x AS x2, b.y AS y2, b.h AS h2, c.x AS x3, c.y AS y3, c.h AS h3 FROM t a JOIN t b ON b.x = a.x + 1 AND b.y = a.y JOIN t c ON c.x = a.x + 1 AND c.y = a.y + 1
       UNION ALL SELECT a.x, a.y, a.h, b.x, b.y, b.h, c.x, c.y, c.h FROM t a JOIN t b ON b.x = a.x + 1 AND b.y = a.y + 1 JOIN t c ON c.x = a.x AND c.y = a.y + 1)"""


@query(f"""{TOP} SELECT x1 * 64 + y1 AS node, x2 * 64 + y2 AS second, ((y2 - y1) * (h3 - h1) - (h2 - h1) * (y3 - y1))::BIGINT AS nx, ((h2 - h1) * (x3 - x1) - (x2 - x1) * (h3 - h1))::BIGINT AS ny,
       ((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1))::BIGINT * 1000 AS nz FROM tr""")
def triangle_normals(spark, sf):
    """Normals (twice the area) of the triangles over the top layer, in thousandths."""
    _, t = _top_mesh(spark, sf)
    n = [F.round(c * 1000).cast("bigint").alias(f"n{a}") for a, c in zip(AXES, meshing.triangle_normal(F.col("at")), strict=True)]
    return t.select(F.col("nodes")[0].alias("node"), F.col("nodes")[1].alias("second"), *n)


@query(f"""{TOP}, n AS (SELECT DISTINCT unnest([x1, x2, x3]) AS x, unnest([y1, y2, y3]) AS y, unnest([h1, h2, h3]) AS h FROM tr),
z AS (SELECT DISTINCT x, y, h, unnest([h // 1000, (h + 999) // 1000]) AS z FROM n) SELECT x, y, z::INT AS z, (1000 * z - h)::BIGINT AS phi FROM z""")
def triangle_distances_up(spark, sf):
    """The level set of the triangles over the top layer along z, in thousandths: grid points below and above each column's height."""
    _, t = _top_mesh(spark, sf)
    d = meshing.triangle_distances(t.select(F.lit(0).alias("layer"), "at"), ["z"])
    return d.select("x", "y", "z", F.round(F.col("phi") * 1000).cast("bigint").alias("phi"))


@query(f"{MESH} SELECT a::INT AS node_a, b::INT AS node_b, mat_low, mat_high FROM fc WHERE mat_low <> mat_high")
def material_faces(spark, sf):
    f = meshing.interfaces(_mesh(spark, sf))
    return f.select(F.col("face")[0].alias("node_a"), F.col("face")[1].alias("node_b"), "mat_low", "mat_high")


@query(f"{MESH}, s AS (SELECT unnest(range(mat_low, least(mat_high, 5))) AS material FROM fc WHERE mat_low < least(mat_high, 5)) SELECT material::INT AS material, count(*)::BIGINT AS n_faces FROM s GROUP BY material")
def material_surfaces(spark, sf):
    s = meshing.surfaces_by_material(meshing.interfaces(_mesh(spark, sf)), 5)
    return s.groupBy("material").agg(F.count("*").alias("n_faces"))


@query(f"{MESH}, h AS (SELECT material, a, b FROM f GROUP BY material, a, b HAVING count(*) % 2 = 1) SELECT material, count(*)::BIGINT AS n_faces FROM h GROUP BY material")
def hull_faces(spark, sf):
    e = _mesh(spark, sf)
    faces = e.select("material", F.explode(F.expr("transform(array(array(0, 1), array(0, 2), array(1, 2)), p -> array_sort(array(nodes[p[0]], nodes[p[1]])))")).alias("face"))
    return meshing.hull_surfaces(faces).groupBy("material").agg(F.count("*").alias("n_faces"))


@query(f"WITH {SQL} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM ls")
def bounding_box(spark, sf):
    return meshing.bounding_box(level_set(spark, sf))


TABLE = [(0.0, 0.0), (10.0, 5.0), (20.0, 25.0), (40.0, 15.0)]


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN q <= 0 THEN 0 WHEN q < 10 THEN q * 0.5::DOUBLE WHEN q < 20 THEN 5.0::DOUBLE + (q - 10.0::DOUBLE) * 2.0::DOUBLE
 WHEN q < 40 THEN 25.0::DOUBLE + (q - 20.0::DOUBLE) * -0.5::DOUBLE ELSE 15 END::DOUBLE AS y FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)""")
def interpolate_table(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", analytics.interpolated(F.col("l_quantity"), TABLE).alias("y"))


@query("SELECT user_id AS active_pid, sum(round(value * 100)::BIGINT)::BIGINT AS rate, count(*)::BIGINT AS n_hits FROM events GROUP BY user_id")
def rates_reduce(spark, sf):
    """Hits from events: what each brings, summed by surface point in whole hundredths."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.col("user_id").alias("active_pid")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("rate"), F.count("*").alias("n_hits"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, user_id AS active_pid, sum(round(value * 100)::BIGINT)::BIGINT AS rate, count(*)::BIGINT AS n_hits FROM events GROUP BY 1, 2")
def rates_by_hour(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return streamed_rates(e.select("ts", F.col("user_id").alias("active_pid"), F.round(F.col("value") * 100).cast("bigint").alias("weight")))


@query(f"WITH {SQL} SELECT layer, x, y, z, least(greatest(round((phi / 1500.0::DOUBLE + 1) * 255 / 2), 0), 255)::BIGINT AS code FROM ls")
def quantise_distance(spark, sf):
    return level_set(spark, sf).select(*KEY, quantise("phi", 8, 1500.0).alias("code"))


@query(f"WITH {SQL}, n AS (SELECT a.phi AS p, b.phi AS q FROM ls a JOIN ls b ON a.layer = b.layer AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND a.x BETWEEN b.x - 1 AND b.x + 1) SELECT count(*)::BIGINT AS n FROM n WHERE abs(p - q) * 10 > 11000")
def inconsistent_pairs(spark, sf):
    return algebra.inconsistent(level_set(spark, sf)).agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, {random.state_sql(42, 'l_orderkey', 'l_linenumber')} AS state FROM lineitem")
def counter_random(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", random.state(42, F.col("l_orderkey"), F.col("l_linenumber")).alias("state"))


@query(f"""WITH {SQL}, r AS (SELECT l_orderkey AS ray, l_linenumber AS n, (l_partkey // 20)::INT AS x, l_quantity::INT AS y FROM lineitem),
s AS (SELECT layer, x, y, z FROM ls WHERE abs(phi) * 2 <= 1000),
t AS (SELECT x, y, max(z) AS z, arg_max(layer, z * 4 + layer) AS layer FROM s GROUP BY x, y)
SELECT r.ray, r.n, t.z, t.layer FROM r JOIN t ON t.x = r.x AND t.y = r.y""")
def first_hit_down(spark, sf):
    """Rays straight down, one a line of lineitem: the first active point that each meets, of equal ones that of the higher layer."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rays = li.select(F.col("l_orderkey").alias("ray"), F.col("l_linenumber").alias("n"), F.expr("cast(l_partkey div 20 as int)").alias("x"), F.col("l_quantity").cast("int").alias("y"))
    top = analytics.active(level_set(spark, sf)).groupBy("x", "y").agg(F.max(F.struct("z", "layer")).alias("hit"))
    return rays.join(top, ["x", "y"]).select("ray", "n", "hit.z", "hit.layer")


@query(f"""WITH {SQL}, v AS (SELECT p.layer, p.x, p.y, p.z, b.phi - a.phi AS d1, p.phi - b.phi AS d2, c.phi - p.phi AS d3, d.phi - c.phi AS d4 FROM ls p
  JOIN ls a ON a.layer = p.layer AND a.y = p.y AND a.z = p.z AND a.x = p.x - 2 JOIN ls b ON b.layer = p.layer AND b.y = p.y AND b.z = p.z AND b.x = p.x - 1
  JOIN ls c ON c.layer = p.layer AND c.y = p.y AND c.z = p.z AND c.x = p.x + 1 JOIN ls d ON d.layer = p.layer AND d.y = p.y AND d.z = p.z AND d.x = p.x + 2),
w AS (SELECT layer, x, y, z, d1::DOUBLE AS d1, d2::DOUBLE AS d2, d3::DOUBLE AS d3, d4::DOUBLE AS d4 FROM v),
r AS (SELECT *, (1e-6::DOUBLE + (d1 - d2) * (d1 - d2)) / (1e-6::DOUBLE + (d2 - d3) * (d2 - d3)) AS rb, (1e-6::DOUBLE + (d4 - d3) * (d4 - d3)) / (1e-6::DOUBLE + (d3 - d2) * (d3 - d2)) AS ra FROM w)
SELECT layer, x, y, z, round((d2 + d3 - (d1 - 2.0::DOUBLE * d2 + d3) / (1.0::DOUBLE + 2.0::DOUBLE * rb * rb)) / 2.0::DOUBLE * 1000)::BIGINT AS below,
       round((d3 + d2 - (d4 - 2.0::DOUBLE * d3 + d2) / (1.0::DOUBLE + 2.0::DOUBLE * ra * ra)) / 2.0::DOUBLE * 1000)::BIGINT AS above FROM r""")
def weno_slopes_x(spark, sf):
    """Slopes of third order along x in millionths, where both are known."""
    s = weno_slopes(level_set(spark, sf), 3, ["x"]).where("x_below is not null and x_above is not null")
    return s.select(*KEY, F.round(F.col("x_below") * 1000).cast("bigint").alias("below"), F.round(F.col("x_above") * 1000).cast("bigint").alias("above"))


def _weno_sql(order: int, axis: str) -> str:
    """Rows of the flat field whose line of neighbours along ``axis`` is whole, with their differences, and the slopes in millionths."""
    reach = 2 if order == 3 else 3
    held = ", ".join(f"lag(phi, {i}) OVER o AS m{i}, lead(phi, {i}) OVER o AS q{i}" for i in range(1, reach + 1))
    whole = f"lag({axis}, {reach}) OVER o = {axis} - {reach} AND lead({axis}, {reach}) OVER o = {axis} + {reach} AS whole"
    line = [f"m{i}" for i in range(reach, 0, -1)] + ["phi"] + [f"q{i}" for i in range(1, reach + 1)]
    diffs = ", ".join(f"({b} - {a})::DOUBLE AS d{i + 1}" for i, (a, b) in enumerate(zip(line, line[1:], strict=False)))

    def third(far, near, ahead):
        r = f"((1e-6::DOUBLE + ({far} - {near}) * ({far} - {near})) / (1e-6::DOUBLE + ({near} - {ahead}) * ({near} - {ahead})))"
        return f"({near} + {ahead} - ({far} - 2.0::DOUBLE * {near} + {ahead}) / (1.0::DOUBLE + 2.0::DOUBLE * {r} * {r})) / 2.0::DOUBLE"

    def fifth(a, b, c, d, e):
        def weight(ideal, bend, tilt):
            return f"({ideal}::DOUBLE / (1e-6::DOUBLE + (13.0::DOUBLE / 12.0::DOUBLE * ({bend}) * ({bend}) + ({tilt}) * ({tilt}) / 4.0::DOUBLE)))"

        left, centre, right = f"(2 * {a} - 7 * {b} + 11 * {c}) / 6.0::DOUBLE", f"(-{b} + 5 * {c} + 2 * {d}) / 6.0::DOUBLE", f"(2 * {c} + 5 * {d} - {e}) / 6.0::DOUBLE"
        wl, wc, wr = weight("0.1", f"{a} - 2 * {b} + {c}", f"{a} - 4 * {b} + 3 * {c}"), weight("0.6", f"{b} - 2 * {c} + {d}", f"{b} - {d}"), weight("0.3", f"{c} - 2 * {d} + {e}", f"3 * {c} - 4 * {d} + {e}")
        return f"({wl} * ({left}) + {wc} * ({centre}) + {wr} * ({right})) / ({wl} + {wc} + {wr})"

    rule, n = (third, 3) if order == 3 else (fifth, 5)
    d = [f"d{i}" for i in range(1, n + 2)]
    below, above = rule(*d[:n]), rule(*d[::-1][:n])
    lines = f"l AS (SELECT *, {held}, {whole} FROM fl WINDOW o AS (PARTITION BY {', '.join(k for k in KEY if k != axis)} ORDER BY {axis}))"
    return f"WITH {SQL}, {FLAT_SQL}, {lines}, w AS (SELECT *, {diffs} FROM l WHERE whole) SELECT layer, x, y, z, round(({below}) * 1000)::BIGINT AS below, round(({above}) * 1000)::BIGINT AS above FROM w"


def _flat_slopes(spark, sf, order: int, axis: str) -> DataFrame:
    s = weno_slopes(flat_level_set(spark, sf), order, [axis]).where(f"{axis}_below is not null and {axis}_above is not null")
    return s.select(*KEY, F.round(F.col(f"{axis}_below") * 1000).cast("bigint").alias("below"), F.round(F.col(f"{axis}_above") * 1000).cast("bigint").alias("above"))


@query(_weno_sql(3, "y"))
def weno_slopes_flat(spark, sf):
    """Slopes of third order along y of the flat field, in millionths, where both are known."""
    return _flat_slopes(spark, sf, 3, "y")


@query(_weno_sql(5, "x"))
def weno5_slopes_flat(spark, sf):
    """Slopes of fifth order along x of the flat field, in millionths, where both are known."""
    return _flat_slopes(spark, sf, 5, "x")


@query(f"""WITH {SQL}, asks AS (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS layer, (l_partkey // 20)::INT AS x, l_quantity::INT AS y,
         floor(l_extendedprice / 2000)::INT AS z FROM lineitem)
SELECT k.l_orderkey, k.l_linenumber, k.layer, k.x, k.y, k.z, CASE WHEN coalesce(b.phi, a.phi) < 0 THEN -1 WHEN coalesce(b.phi, a.phi) IS NOT NULL THEN 1 END AS sign, CASE WHEN b.z = k.z THEN b.phi END AS phi
FROM asks k ASOF LEFT JOIN ls b ON k.layer = b.layer AND k.x = b.x AND k.y = b.y AND k.z >= b.z
     ASOF LEFT JOIN ls a ON k.layer = a.layer AND k.x = a.x AND k.y = a.y AND k.z <= a.z""")
def point_lookup(spark, sf):
    """Value and sign of the level set at a point for each lineitem."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    layer = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    asks = li.select(layer.alias("layer"), F.expr("cast(l_partkey div 20 as int)").alias("x"), F.col("l_quantity").cast("int").alias("y"), F.floor(F.col("l_extendedprice") / 2000).cast("int").alias("z"), "l_orderkey", "l_linenumber")
    return probed(level_set(spark, sf), asks).select("l_orderkey", "l_linenumber", *KEY, "sign", "phi")


#: Corners of cells that are wholly held, by bit mask, and their coefficients.
RHO = f"""WITH {SQL}, {FLAT_SQL}, c AS (
SELECT layer, (x - k % 2)::INT AS x, (y - k // 2 % 2)::INT AS y, (z - k // 4)::INT AS z, {", ".join(f"max(phi) FILTER (k = {k}) AS p{k}" for k in range(8))}
FROM (SELECT *, unnest(range(8)) AS k FROM fl) GROUP BY ALL HAVING count(*) = 8),
r AS (SELECT layer, x, y, z, p0 AS r0, p1 - p0 AS r1, p2 - p0 AS r2, p3 - p2 - p1 + p0 AS r3, p4 - p0 AS r4, p5 - p4 - p1 + p0 AS r5, p6 - p4 - p2 + p0 AS r6,
             p7 - p6 - p5 - p3 + p4 + p2 + p1 - p0 AS r7 FROM c)"""


@query(f"{RHO} SELECT * FROM r")
def cell_coefficients(spark, sf):
    """Trilinear coefficients of the flat field in every cell whose corners are all held."""
    c = incell.whole_cells(flat_level_set(spark, sf))
    return c.select(*KEY, *[F.col("rho")[k].cast("bigint").alias(f"r{k}") for k in range(8)])


@query(f"""{RHO}, g AS (SELECT layer, x, y, z, r1 + 0.5::DOUBLE * r3 + 0.5::DOUBLE * r5 + 0.25::DOUBLE * r7 AS gx, r2 + 0.5::DOUBLE * r3 + 0.5::DOUBLE * r6 + 0.25::DOUBLE * r7 AS gy,
        r4 + 0.5::DOUBLE * r5 + 0.5::DOUBLE * r6 + 0.25::DOUBLE * r7 AS gz FROM r)
SELECT layer, x, y, z, round(gx / sqrt(gx * gx + gy * gy + gz * gz) * 1e6)::BIGINT AS nx, round(gy / sqrt(gx * gx + gy * gy + gz * gz) * 1e6)::BIGINT AS ny,
       round(gz / sqrt(gx * gx + gy * gy + gz * gz) * 1e6)::BIGINT AS nz FROM g""")
def cell_normals(spark, sf):
    """Normals at the centres of those cells, in millionths."""
    c = incell.whole_cells(flat_level_set(spark, sf))
    n = incell.normal([F.col("rho")[k].cast("double") for k in range(8)], [F.lit(0.5)] * 3)
    return c.select(*KEY, *[F.round(v * 1e6).cast("bigint").alias(f"n{a}") for a, v in zip(AXES, n, strict=True)])


@query(f"""{RHO}, v AS (SELECT layer, x, y, z, r0 + 0.5::DOUBLE * r1 + 0.5::DOUBLE * r2 + 0.25::DOUBLE * r3 AS c, r4 + 0.5::DOUBLE * r5 + 0.5::DOUBLE * r6 + 0.25::DOUBLE * r7 AS m FROM r)
SELECT layer, x, y, z, round((1 + c / m) * 1e6)::BIGINT AS t FROM v WHERE m > 0 AND c + m > 0 AND c <= 0""")
def cell_entries(spark, sf):
    """Where vertical rays from above through the centres of those cells enter the solid inside them, in millionths of a cell below the top."""
    half, down = [F.lit(0.5), F.lit(0.5), F.lit(1.0)], [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]
    return incell.entries(flat_level_set(spark, sf), half, down).where("t > 0").select(*KEY, F.round(F.col("t") * 1e6).cast("bigint").alias("t"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25)::DOUBLE AS d, round(l_tax * 100 - 4)::DOUBLE AS c, round(l_discount * 100 - 5)::DOUBLE AS b, (l_linenumber - 3)::DOUBLE AS a FROM lineitem),
k AS (SELECT *, CASE WHEN abs(a) > 1e-10 * abs(d) THEN 3 WHEN abs(b) > 1e-10 * abs(d) THEN 2 WHEN abs(c) > 1e-10 * abs(d) THEN 1 ELSE 0 END AS deg FROM p),
m AS (SELECT *, CASE deg WHEN 3 THEN b / a ELSE 0 END AS e, CASE deg WHEN 3 THEN c / a ELSE 0 END AS f, CASE deg WHEN 3 THEN d / a ELSE 0 END AS g, c * c - 4 * b * d AS disc FROM k),
n AS (SELECT *, f - e * e / 3.0::DOUBLE AS p, 2 * e * e * e / 27.0::DOUBLE - e * f / 3.0::DOUBLE + g AS q FROM m),
o AS (SELECT *, q * q / 4 + p * p * p / 27.0::DOUBLE AS under FROM n),
s AS (SELECT *, CASE WHEN deg = 3 AND under < 0 THEN 2 * sqrt(-p / 3) ELSE 0 END AS rad,
        CASE WHEN deg = 3 AND under < 0 THEN acos(greatest(-1, least(1, 3 * q / (p * 2 * sqrt(-p / 3))))) / 3 ELSE 0 END AS ang,
        CASE WHEN deg = 3 AND under >= 0 THEN (CASE WHEN q > 0 THEN -1 ELSE 1 END) * cbrt(abs(q) / 2 + sqrt(under)) ELSE 0 END AS u,
        CASE WHEN deg = 2 AND disc >= 0 THEN -0.5::DOUBLE * (c + (CASE WHEN c < 0 THEN -1 ELSE 1 END) * sqrt(disc)) END AS w FROM o),
t AS (SELECT *, CASE WHEN deg = 3 AND under < 0 THEN list_sort([rad * cos(ang) - e / 3, rad * cos(ang - 2 * pi() / 3) - e / 3, rad * cos(ang - 4 * pi() / 3) - e / 3])
        WHEN deg = 3 THEN [CASE WHEN u = 0 THEN -e / 3 ELSE u - p / (3 * u) - e / 3 END]
        WHEN deg = 2 AND disc >= 0 THEN (CASE WHEN w = 0 THEN [0.0::DOUBLE, 0.0::DOUBLE] ELSE list_sort([w / b, d / w]) END)
        WHEN deg = 1 THEN [-d / c] ELSE []::DOUBLE[] END AS x FROM s)
SELECT l_orderkey, l_linenumber, len(x)::INT AS n_roots, round(x[1] * 1e5)::BIGINT AS r1, round(x[2] * 1e5)::BIGINT AS r2, round(x[3] * 1e5)::BIGINT AS r3 FROM t""")
def polynomial_roots(spark, sf):
    """Real roots, in hundred-thousandths, of a cubic for each lineitem; some of them are of a lower degree."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    c = [F.col("l_quantity") - 25, F.round(F.col("l_tax") * 100 - 4), F.round(F.col("l_discount") * 100 - 5), F.col("l_linenumber") - 3]
    x = li.select("l_orderkey", "l_linenumber", incell.roots([v.cast("double") for v in c]).alias("x"))
    return x.select("l_orderkey", "l_linenumber", F.size("x").alias("n_roots"), *[F.round(F.get("x", F.lit(i)) * 1e5).cast("bigint").alias(f"r{i + 1}") for i in range(3)])


#: Values of the six tetrahedra of a cell, one list for each order of the axes from corner 0 to corner 7.
CORNER_VALUES = "[" + ", ".join(f"[p0, p{a}, p{a + b}, p7]" for a, b in ((1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2))) + "]"


@query(f"""{RHO}, t AS (SELECT layer, x, y, z, list_sort(unnest({CORNER_VALUES})) AS f FROM c),
v AS (SELECT layer, x, y, z, len(list_filter(f, lambda p: p < 0)) AS k, f[1]::DOUBLE AS a, f[2]::DOUBLE AS b, f[3]::DOUBLE AS c, f[4]::DOUBLE AS d FROM t),
s AS (SELECT layer, x, y, z, CASE k WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 1 THEN a / (a - b) * (a / (a - c)) * (a / (a - d)) WHEN 3 THEN 1 - d / (d - a) * (d / (d - b)) * (d / (d - c))
        ELSE b / (b - c) * (b / (b - d)) + a / (a - c) * (1 - b / (b - c)) * (b / (b - d)) + a / (a - c) * (a / (a - d)) * (1 - b / (b - d)) END AS share FROM v)
SELECT layer, x, y, z, round(sum(share) / 6 * 1e6)::BIGINT AS volume FROM s GROUP BY layer, x, y, z HAVING sum(share) > 0""")
def solid_volumes(spark, sf):
    """Volume inside the flat field in every cell whose corners are all held, in millionths, from its tetrahedra."""
    points = flat_level_set(spark, sf)
    parts = F.array_sort(F.collect_list(F.struct("part", "size")))  # a few dozen a cell, added in order
    v = meshing.sizes(meshing.solid(points)).groupBy(*KEY).agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["size"]).alias("v"))
    return v.join(incell.whole_cells(points).select(*KEY), KEY, "left_semi").where("v > 0").select(*KEY, F.round(F.col("v") * 1e6).cast("bigint").alias("volume"))


from . import geometry  # noqa: E402, F401  (registers its queries)
