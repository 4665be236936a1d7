"""Volumes of all materials from stacked level sets: conforming simplices near the surfaces, merged boxes between them.

Layers contain those below them, so material m is what layer m holds and layer m - 1 doesn't. A cell in which some layer changes its sign is cut into
simplices, and these are clipped by each layer in turn, from the top one down, at nodes that neighbouring pieces share; neighbouring materials so
meet in the same faces. Between such cells a column of cells has one material, and stays one box however high it is.

One shuffle deals columns of all layers to blocks (see ``blocks``), where array work finds the cells and boxes; clipping is array work on batches of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import AXES
from . import meshing
from .blocks import Block, placed, spread

#: Columns of a block along x and y; few, as it holds all layers.
SIZE = 16
#: Cells that are clipped at once.
CLIPPED = 4096
#: A value at a cut that is this small beside those that it comes from is 0.
NOISE = 1e-12
#: Nodes that agree to so many places are one.
DIGITS = 9

_PIECES = T.StructType([*[T.StructField(a, T.IntegerType()) for a in AXES], T.StructField("height", T.IntegerType()), T.StructField("material", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

_PIECES_NONE = pa.table({"x": pa.array([], pa.int32()), "y": pa.array([], pa.int32()), "z": pa.array([], pa.int32()), "height": pa.array([], pa.int32()), "material": pa.array([], pa.int32()), "v": pa.array([], pa.list_(pa.float64()))})


def pieces_of(code: int, n: int) -> list[tuple[bool, list[list[int]]]]:
    """(inside, nodes) of the parts of a simplex of ``n`` + 1 nodes whose node i is outside where bit i of ``code`` is set; a node is a pair of old ones, equal or cut.

    With inner nodes a0, a1, ... and outer ones b0, b1, ... in order, an inner part has a0 to aj and the cuts of a staircase from (aj, b0) to the
    last pair, an outer one the cuts of a staircase from the first pair to (last a, bj), then bj to the last. Nodes stay in an order that neighbours share.
    """
    ins, outs = [i for i in range(n + 1) if not code >> i & 1], [i for i in range(n + 1) if code >> i & 1]
    if not ins or not outs:
        return [(bool(ins), [[i, i] for i in range(n + 1)])]

    def stairs(i: int, o: int, right: int, up: int):
        for steps in combinations(range(right + up), right):
            at, path = [i, o], [sorted((ins[i], outs[o]))]
            for s in range(right + up):
                at[0 if s in steps else 1] += 1
                path.append(sorted((ins[at[0]], outs[at[1]])))
            yield path

    same = lambda nodes: [[i, i] for i in nodes]
    found = [(True, same(ins[: j + 1]) + path) for j in range(len(ins)) for path in stairs(j, 0, len(ins) - 1 - j, len(outs) - 1)]
    return found + [(False, path + same(outs[j:])) for j in range(len(outs)) for path in stairs(0, 0, len(ins) - 1, j)]


def _block(table: pa.Table, axes: list[str], layers: list[int], far: float, low: int | None, high: int | None) -> pa.Table:
    """Cells to clip (v: the layers' values at the corners, layer by layer) and boxes (a material, no v) of one block's columns."""
    n = 1 << len(axes)
    corner = np.array([[c >> axes.index(a) & 1 if a in axes else 0 for c in range(n)] for a in AXES])
    foot = corner[:2, : n // 2]  # the corner columns of a cell column
    home = [table[c][0].as_py() for c in ("__bx", "__by")]
    blocks, columns = [], None
    of = lambda x, y: (x - home[0] * SIZE + 1) * (SIZE + 3) + y - home[1] * SIZE + 1
    for layer in layers:
        b = Block(table.filter(pc.equal(table["layer"], layer)), 1)
        blocks.append(b)
        here = np.unique(of(b.at[0], b.at[1]))
        columns = here if columns is None else np.intersect1d(columns, here)
    # cell columns whose corner columns are in every layer, lowest corner in the block
    x, y = columns // (SIZE + 3) - 1 + home[0] * SIZE, columns % (SIZE + 3) - 1 + home[1] * SIZE
    own = (x // SIZE == home[0]) & (y // SIZE == home[1])
    for dx, dy in foot.T:
        own &= np.isin(of(x + dx, y + dy), columns)
    x, y = x[own], y[own]
    cell = of(x, y)
    if not len(cell):
        return _PIECES_NONE
    mixed = [np.zeros((2, 0), np.int64)]
    start = []
    for b in blocks:
        # where a column's sign changes: at the row that has another sign than the one below
        column, inside = of(b.at[0], b.at[1]), b.phi < 0
        first = np.append(True, column[1:] != column[:-1])
        flip = np.flatnonzero(~first & np.append(False, inside[1:] != inside[:-1]))
        base = np.zeros(len(cell), np.int64)
        events = []
        for bit, (dx, dy) in enumerate(foot.T):
            rows = np.flatnonzero(first)
            base |= inside[rows[np.searchsorted(column[rows], of(x + dx, y + dy))]].astype(np.int64) << bit
            at = of(b.at[0, flip] - dx, b.at[1, flip] - dy)
            k = np.minimum(np.searchsorted(cell, at), max(len(cell) - 1, 0))
            known = cell[k] == at if len(cell) else np.zeros(len(at), bool)
            events.append(np.stack([k[known], b.at[2, flip[known]], np.full(known.sum(), 1 << bit)]))
        start.append(base)
        k, z, toggled = np.concatenate(events, axis=1)
        order = np.lexsort((z, k))
        k, z, toggled = k[order], z[order], toggled[order]
        total = np.bitwise_xor.accumulate(toggled) if len(k) else toggled
        head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        before = np.repeat((total ^ toggled)[head], np.diff(np.append(np.flatnonzero(head), len(k)))) if len(k) else total
        mask = base[k] ^ total ^ before
        # cells at a change, and those up to the next change where corner columns disagree
        ahead = np.append((k[1:] == k[:-1]), False) if len(k) else np.zeros(0, bool)
        until = np.where(ahead, np.append(z[1:], 0), z) if len(k) else z
        length = np.where((mask != 0) & (mask != (1 << (n // 2)) - 1), np.maximum(until - 1 - z, 0), 0)
        more = np.repeat(np.arange(len(k)), length)
        step = np.arange(len(more)) - np.repeat(np.cumsum(length) - length, length)
        mixed += [np.stack([k, z - 1]), np.stack([k[more], z[more] + step])]
    k, z = np.unique(np.concatenate(mixed, axis=1), axis=1)
    at = (np.stack([x[k], y[k], z])[:, :, None] + corner[:, None, :]).reshape(3, -1)
    v = np.zeros((len(k), len(layers), n))
    for i, b in enumerate(blocks):
        row = b.find(at)
        v[:, i, :] = np.where(row >= 0, b.phi[np.maximum(row, 0)].astype(float), far * b.sign(at)).reshape(-1, n)

    def material(negative: np.ndarray) -> np.ndarray:
        """The lowest layer that holds all corners of a side, as its position; -1 outside, or where the corners disagree in some layer."""
        whole = negative.all(axis=2)
        agreed = (whole | ~negative.any(axis=2)).all(axis=1)
        return np.where(agreed & whole.any(axis=1), whole.argmax(axis=1), -1)

    above, under = material(v[:, :, n // 2 :] < 0), material(v[:, :, : n // 2] < 0)
    head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    last = np.append(k[1:] != k[:-1], True) if len(k) else np.zeros(0, bool)
    inner = np.flatnonzero(~last)
    boxes = [(k[inner], z[inner] + 1, z[inner + 1] - z[inner] - 1, above[inner])]
    alone = np.setdiff1d(np.arange(len(cell)), k)
    held = material(np.stack([s[alone, None] >> np.arange(n // 2) & 1 for s in start], axis=1) == 1)
    if low is not None:
        boxes.append((k[head], np.full(head.sum(), low), z[head] - low, under[head]))
        if high is not None:
            boxes.append((alone, np.full(len(alone), low), np.full(len(alone), high - low), held))
    if high is not None:
        boxes.append((k[last], z[last] + 1, high - z[last] - 1, above[last]))
    bk, bz, bh, bm = (np.concatenate(c) for c in zip(*boxes, strict=True))
    good = (bh > 0) & (bm >= 0)
    bk, bz, bh, bm = bk[good], bz[good], bh[good], bm[good]
    names = np.array([*layers, 0])
    ints = lambda a, b: pa.array(np.concatenate([a, b]).astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.arange(len(k) + 1) * v[0].size if len(k) else [0], np.full(len(bk), v.size)]).astype(np.int32)), pa.array(v.reshape(-1)))
    whole = np.ones(len(k), np.int64)
    return pa.Table.from_arrays([ints(x[k], x[bk]), ints(y[k], y[bk]), ints(z, bz), ints(whole, bh), pa.array(np.concatenate([whole * -1, names[bm]]).astype(np.int32)), lists], names=_PIECES.names)


def layers_of(points: DataFrame) -> list[int]:
    return sorted(r[0] for r in points.select("layer").distinct().collect())


def pieces(points: DataFrame, axes: list[str] = AXES, far: float = 1500, low: int | None = None, high: int | None = None, layers: list[int] | None = None) -> DataFrame:
    """(x, y, z, height, material, v): cells in which a layer changes its sign (material -1; v: values of all layers at the corners, a layer after the other,
    absent ones ``far`` by their sign) and boxes of one material between them (v empty).

    Columns of cells reach from ``low`` to ``high`` (grid indices); without them, boxes that have no end there are left out. A cell column is filled if all
    of its corner columns have rows in every layer. One shuffle by block; the layers' numbers, a handful, come to the driver, unless they are given.
    """
    layers = layers_of(points) if layers is None else layers
    own = points.select("layer", *[F.col(a).cast("int").alias(a) for a in AXES], F.col("phi").cast("double").alias("phi")).dropna()
    cell = lambda a, s: F.expr(f"floor(({a} - {s}) / {SIZE})").cast("int")
    dealt = own.withColumn("__b", F.explode(F.array_distinct(F.array(*[F.struct(cell("x", s).alias("x"), cell("y", t).alias("y")) for s in (0, 1) for t in (0, 1)]))))
    dealt = dealt.withColumn("__bx", F.col("__b.x")).withColumn("__by", F.col("__b.y")).drop("__b")

    def run(table: pa.Table) -> pa.Table:
        return _block(placed(table, np.ones(len(table), bool)), axes, layers, far, low, high)

    return spread(dealt, "__bx", "__by").groupBy("__bx", "__by").applyInArrow(run, _PIECES)


def _paths(axes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The simplices of a cell, as corner numbers along paths from the lowest corner to the highest; and where the corners stand."""
    corner = np.array([[c >> axes.index(a) & 1 if a in axes else 0 for a in AXES] for c in range(1 << len(axes))], float)
    return np.array([[sum(order[:i]) for i in range(len(axes) + 1)] for order in permutations([1 << i for i in range(len(axes))])]), corner


def _clipped(v: np.ndarray, axes: list[str], layers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of cells with the layers' values ``v`` (cell, layer, corner) at their corners: the cell's row, the material and the nodes from the cell's lowest corner."""
    d, n = len(axes), len(layers)
    paths, corner = _paths(axes)
    cell = np.repeat(np.arange(len(v)), len(paths))
    at = np.tile(corner[paths], (len(v), 1, 1))
    v = np.moveaxis(v[:, :, paths], 1, 3).reshape(-1, d + 1, n)
    done = []
    for i in range(n - 1, -1, -1):
        code = ((v[:, :, i] >= 0).astype(np.int64) << np.arange(d + 1)).sum(axis=1)
        left = []
        for c in np.unique(code):
            rows = np.flatnonzero(code == c)
            for inside, pairs in pieces_of(int(c), d):
                # outside the top layer there is no material; outside another one, that of the layer above it
                if not inside and i == n - 1:
                    continue
                a, b = np.array(pairs).T
                p, pv = at[rows][:, a], v[rows][:, a]
                if (a != b).any():
                    q, qv = at[rows][:, b], v[rows][:, b]
                    x, y = pv[:, :, i], qv[:, :, i]
                    t = np.divide(x, x - y, out=np.zeros_like(x), where=x != y)[:, :, None]
                    # what layers have in common stays common: a value that cancels is 0, and a cut at a node is the node
                    value = pv + t * (qv - pv)
                    value[np.abs(value) <= NOISE * (np.abs(pv) + np.abs(qv))] = 0.0
                    first = ((a == b) | (x == 0))[:, :, None]
                    second = (y == 0)[:, :, None]
                    p, pv = np.where(first, p, np.where(second, q, p + t * (q - p))), np.where(first, pv, np.where(second, qv, value))
                (left if inside else done).append((cell[rows], p, pv) if inside else (cell[rows], np.full(len(rows), layers[i + 1]), p))
        cell, at, v = (np.concatenate(c) for c in zip(*left, strict=True)) if left else (cell[:0], at[:0], v[:0])
    done.append((cell, np.full(len(cell), layers[0] if layers else 0), at))
    cell, material, at = (np.concatenate(c) for c in zip(*done, strict=True))
    digits = np.round(at, DIGITS)
    apart = np.ones(len(at), bool)
    for i, j in combinations(range(d + 1), 2):
        apart &= (digits[:, i] != digits[:, j]).any(axis=1)
    apart &= _extents(at, axes) > 0
    return cell[apart], material[apart], at[apart]


def _extents(at: np.ndarray, axes: list[str]) -> np.ndarray:
    """``extent`` of nodes (element, node, axis)."""
    sides = at[:, 1:, [AXES.index(a) for a in axes]] - at[:, :1, [AXES.index(a) for a in axes]]
    if len(axes) == 2:
        return np.abs(sides[:, 0, 0] * sides[:, 1, 1] - sides[:, 0, 1] * sides[:, 1, 0]) / 2.0
    return np.abs((np.cross(sides[:, 0], sides[:, 1]) * sides[:, 2]).sum(axis=1)) / 6.0


def _elements(batches: Iterator[pa.RecordBatch], axes: list[str], layers: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """From batches of ``pieces``, some thousand at a time: these rows and, of their elements, the row, the material and the nodes from the row's lowest corner."""
    paths, corner = _paths(axes)
    for whole in batches:
        for start in range(0, len(whole), CLIPPED):
            batch = whole.slice(start, CLIPPED)
            material = batch["material"].to_numpy()
            cut, box = np.flatnonzero(material < 0), np.flatnonzero(material >= 0)
            v = batch["v"].take(pa.array(cut)).flatten().to_numpy().reshape(len(cut), len(layers), 1 << len(axes))
            cell, kind, at = _clipped(v, axes, layers)
            tall = np.tile(corner[paths], (len(box), 1, 1))
            tall[:, :, 2] *= np.repeat(batch["height"].to_numpy()[box], len(paths))[:, None]
            yield batch, np.append(np.repeat(box, len(paths)), cut[cell]), np.append(np.repeat(material[box], len(paths)), kind), np.concatenate([tall, at])


def filled(points: DataFrame, axes: list[str] = AXES, far: float = 1500, low: int | None = None, high: int | None = None, split: bool = False) -> DataFrame:
    """(material, x, y, z, height, nodes): triangles (two axes) or tetrahedra (three) of every material; nodes: structs of x, y, z in cells.

    A material has the number of its layer. Elements without extent are left out. ``split``: boxes are cut into cells at last, for a mesh that conforms everywhere;
    else a box is six tetrahedra of its whole height. Arguments as for ``pieces``. Clipping is narrow.
    """
    layers = layers_of(points)
    found = pieces(points, axes, far, low, high, layers)
    if split:
        found = found.withColumn("z", F.explode(F.sequence("z", F.col("z") + F.col("height") - 1))).withColumn("height", F.lit(1))
    names = ["material", *AXES, "height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, material, at in _elements(batches, axes, layers):
            held = {c: batch[c].take(pa.array(row)) for c in (*AXES, "height")} | {"material": pa.array(material.astype(np.int32))}
            place = pa.StructArray.from_arrays([pa.array((at[:, :, i] + batch[a].to_numpy()[row][:, None]).reshape(-1)) for i, a in enumerate(AXES)], names=list(AXES))
            nodes = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * at.shape[1]), place)
            yield pa.RecordBatch.from_arrays([*(held[c] for c in names), nodes], names=[*names, "nodes"])

    return found.mapInArrow(run, ", ".join(f"{c} int" for c in names) + ", nodes array<struct<x:double,y:double,z:double>>")


def volumes(points: DataFrame, axes: list[str] = AXES, far: float = 1500, low: int | None = None, high: int | None = None) -> DataFrame:
    """(x, y, material, extent): area or volume, in cells, of the elements of ``filled`` in each column of cells, summed where they are made. Arguments as for ``pieces``.

    Sides are taken within a cell, so digits don't depend on the place.
    """
    layers = layers_of(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, material, at in _elements(batches, axes, layers):
            t = pa.table({"x": batch["x"].take(pa.array(row)), "y": batch["y"].take(pa.array(row)), "material": pa.array(material.astype(np.int32)), "extent": pa.array(_extents(at, axes))})
            yield from t.group_by(["x", "y", "material"]).aggregate([("extent", "sum")]).select(["x", "y", "material", "extent_sum"]).rename_columns(["x", "y", "material", "extent"]).to_batches()

    found = pieces(points, axes, far, low, high, layers).mapInArrow(run, "x int, y int, material int, extent double")
    return found.groupBy("x", "y", "material").agg(F.sum("extent").alias("extent"))


def extent(nodes: Column, axes: list[str] = AXES) -> Column:
    """Area or volume, in cells, of an element (array of x, y, z)."""
    if len(axes) == 3:
        return F.abs(meshing.signed_volume(nodes))
    a, b = axes
    u, v = ([nodes[k][c] - nodes[0][c] for c in (a, b)] for k in (1, 2))
    return F.abs(u[0] * v[1] - u[1] * v[0]) / 2.0


def hulls(elements: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(material, face): the outer faces (arrays of x, y, z, sorted, to ``digits`` places) of each material in elements from ``filled`` with ``split``; inner ones
    occur twice and cancel. One aggregation."""
    snapped = F.transform("nodes", lambda p: F.struct(*[F.round(p[a], digits).alias(a) for a in AXES]))
    e = elements.select("material", snapped.alias("nodes"))
    faces = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda k: F.array_sort(F.filter("nodes", lambda p, i: i != k)))
    return e.select("material", F.explode(faces).alias("face")).groupBy("material", "face").agg(F.count("*").alias("n")).where("n % 2 = 1").select("material", "face")
