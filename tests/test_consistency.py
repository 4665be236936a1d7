"""Planted faults of all four kinds, and all of them against plain Python."""

import random

from isofield.operators.consistency import END, faults


def plain(held):
    """Every fault by looking at each place between the lowest and the highest row of all."""
    columns = {}
    for (layer, x, y, z), v in held.items():
        columns.setdefault((layer, x, y), []).append((z, v))
    for c in columns.values():
        c.sort()

    def sign(c, z):
        near = [v for q, v in columns[c] if q <= z][-1:] or [columns[c][0][1]]
        return -1 if near[0] < 0 else 1

    def state(v):
        n = (2 * abs(v) - 1000 + 1999) // 2000
        return max(n, 0) * (-1 if v < 0 else 1)

    out = set()
    for (layer, x, y, z), v in held.items():
        for i, a in enumerate("xyz"):
            for s in (-1, 1):
                p = [x, y, z]
                p[i] += s
                c = (layer, p[0], p[1])
                if c not in columns:
                    continue
                other = held.get((layer, *p))
                if other is not None:
                    if abs(state(v) - state(other)) > 1:
                        out.add((layer, x, y, z, "values", a, s))
                elif (sign(c, p[2]) > 0 and v < -500) or (sign(c, p[2]) < 0 and v > 500):
                    out.add((layer, x, y, z, "negative" if v < 0 else "positive", a, s))

    def gaps(c):
        zs = [z for z, _ in columns[c]]
        found = [(-END, zs[0] - 1, sign(c, zs[0]))]
        return found + [(z + 1, w - 1, sign(c, z)) for z, w in zip(zs, [*zs[1:], END + 1]) if w > z + 1]

    for layer, x, y in columns:
        for a, other in (("x", (layer, x + 1, y)), ("y", (layer, x, y + 1))):
            for f, t, s in gaps((layer, x, y)):
                for g, u, r in gaps(other) if other in columns else ():
                    if s != r and max(f, g) <= min(t, u):
                        out.add((layer, x, y, max(f, g), "runs", a, 1))
    return out


def test_planted_and_random(spark):
    flat = {(0, x, y, z): 1000 * z - 300 for x in range(40) for y in range(3) for z in (-1, 0, 1)}
    assert plain(flat) == set()
    frame = lambda held: spark.createDataFrame([(*k, v) for k, v in held.items()], "layer int, x int, y int, z int, phi bigint").repartition(3)
    assert faults(frame(flat)).count() == 0
    for change, kind in (({(0, 5, 1, 0): 1400}, "values"), ({(0, 31, 1, z): None for z in (-1, 0, 1)} | {(0, 31, 1, -30): 900}, "negative"), ({(0, 8, 0, z): None for z in (-1, 0, 1)} | {(0, 8, 0, 30): -900}, "positive"), ({(0, 20, 2, z): None for z in (-1, 0, 1)} | {(0, 20, 2, 30): -100, (0, 20, 2, 31): 900}, "runs")):
        held = {k: v for k, v in (flat | change).items() if v is not None}
        got = {tuple(r) for r in faults(frame(held)).collect()}
        assert got == plain(held) and kind in {r[4] for r in got}
    r = random.Random(4)
    held = {(m, x, y, z): r.randint(-2600, 2600) for m in (0, 2) for x in range(-3, 37) for y in range(5) for z in range(-6, 6) if r.random() < 0.3}
    got = [tuple(x) for x in faults(frame(held)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(held) and {x[4] for x in got} == {"values", "negative", "positive", "runs"}
    assert faults(frame(held).limit(0)).count() == 0
