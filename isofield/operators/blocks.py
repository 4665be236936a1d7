"""Stencils of any reach by blocks with borders: one shuffle, then array work.

Points are dealt to blocks of columns; a point near a border also goes to the neighbouring blocks that look at it. Within a block, which
holds its columns whole, neighbours are places in a sorted array. A block has ``SIZE`` by ``SIZE`` columns, so what a task holds is bounded by the
height of the band, however many points there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import AXES, KEY, Boundary, Grid

#: Columns of a block along x and y; more than twice any reach.
SIZE = 32


class Block:
    """A block's rows: ``table`` sorted by place, where each stands (x, y, z) and phi; ``own``: places in the table of the block's own rows."""

    def __init__(self, table: pa.Table, reach: int) -> None:
        at = np.stack([table[f"__i{a}"].to_numpy() for a in AXES]).astype(np.int64) if len(table) else np.zeros((3, 0), np.int64)
        order = np.lexsort((at[2], at[1], at[0]))
        self.table, at = table.take(pa.array(order)), at[:, order]
        # neighbours within the reach never meet another column's keys
        self.low = at.min(axis=1) - reach - 1 if len(order) else np.zeros(3, np.int64)
        self.width = (at.max(axis=1) - self.low + reach + 2) if len(order) else np.ones(3, np.int64)
        own = self.table["__own"].to_numpy(zero_copy_only=False).astype(bool)
        held = self.table["__held"].to_numpy(zero_copy_only=False).astype(bool)
        self.own, self.at = np.flatnonzero(own), at
        self.row = np.flatnonzero(held)
        self.key = self._key(at[:, self.row])
        phi = self.table["phi"].combine_chunks()
        self.kind = phi.type
        self.phi = phi.to_numpy(zero_copy_only=False)

    def _key(self, at: np.ndarray) -> np.ndarray:
        x, y, z = at - self.low[:, None]
        return (x * self.width[1] + y) * self.width[2] + z

    def find(self, at: np.ndarray) -> np.ndarray:
        """The table's row at each of the places ``at`` (three rows of indices); -1 where there is none."""
        if not len(self.row):
            return np.full(at.shape[1], -1)
        k = self._key(at)
        p = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[p] == k, self.row[p], -1)

    def sign(self, at: np.ndarray) -> np.ndarray:
        """-1 or 1 as the nearest row at or below each place in its column, else above; 0 where the column has no row."""
        if not len(self.row):
            return np.zeros(at.shape[1], np.int64)
        k = self._key(at)
        column, of_key = k // self.width[2], self.key // self.width[2]
        below = np.searchsorted(self.key, k, side="right") - 1
        above = np.minimum(below + 1, len(self.key) - 1)
        under, over = (below >= 0) & (of_key[np.maximum(below, 0)] == column), of_key[above] == column
        near = np.where(under, below, above)
        return np.where(under | over, np.where(self.phi[self.row[near]] < 0, -1, 1), 0)

    def place(self, key: np.ndarray) -> np.ndarray:
        """The places (three rows of indices) that ``_key`` gave."""
        column, z = np.divmod(key, self.width[2])
        return np.stack([*np.divmod(column, self.width[1]), z]) + self.low[:, None]

    def widened(self, width, unit, start) -> tuple[np.ndarray, np.ndarray]:
        """(key, phi), sorted by key, of the band made ``width`` wide; see ``algebra.expand``. Right at places from which the block holds all columns within as many steps as there are cycles."""
        own = self.phi[self.row]
        kept = np.abs(own) * 2 <= start
        key, phi, now = self.key[kept], own[kept], start
        while now < width and len(key):
            now = min(now + 2 * unit, width)
            near = np.concatenate([key + s * step for step in (self.width[1] * self.width[2], self.width[2], 1) for s in (-1, 1)])
            order = np.argsort(near)
            near, value = near[order], np.tile(phi, 6)[order]
            head = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
            up, down, near = np.minimum.reduceat(value, head) + unit, np.maximum.reduceat(value, head) - unit, near[head]
            sign = self.sign(self.place(near))
            value = np.where(sign > 0, up, down).astype(phi.dtype)
            new = (sign != 0) & (np.abs(value) * 2 <= now) & ~np.isin(near, key)
            key, phi = np.append(key, near[new]), np.append(phi, value[new])
            order = np.argsort(key, kind="stable")
            key, phi = key[order], phi[order]
        return key, phi

    def values(self, rows: np.ndarray) -> pa.Array:
        """phi of table rows as an Arrow array, null for -1."""
        return pa.array(self.phi[np.maximum(rows, 0)] if len(self.phi) else np.zeros(len(rows), self.phi.dtype), self.kind, mask=rows < 0)

    def rows(self, places: np.ndarray, columns: list[str]) -> list[pa.Array]:
        return [c.combine_chunks() for c in self.table.select(columns).take(pa.array(places)).columns]


def _entries(points: DataFrame, reach: int, grid: Grid | None) -> DataFrame:
    """``points`` with where each stands (__ix, __iy, __iz): itself (__own) and, with a grid, its images beyond the bounds; __held: whether it is looked up there."""
    rows = points.withColumn("__held", F.lit(True)).withColumn("__own", F.lit(True))
    for a in AXES:
        x = F.col(a)
        if grid is None or a == grid.open_axis or a not in grid.low:
            rows = rows.withColumn(f"__i{a}", x)
            continue
        low, high = grid.low[a], grid.high[a]
        other = {Boundary.PERIODIC: [x + (high - low), x - (high - low)]}.get(grid.of(a), [2 * low - x, 2 * high - x] if grid.of(a).mirrors else [])
        images = [F.struct(i.cast("int").alias("i"), F.lit(True).alias("held"), F.lit(False).alias("own")) for i in other]
        here = F.struct(x.cast("int").alias("i"), F.coalesce(grid.wrap(a, x) == x, F.lit(False)).alias("held"), F.lit(True).alias("own"))
        seen = F.filter(F.array(*images), lambda e: (e["i"] != F.col(a)) & e["i"].between(low - reach, high + reach) & (grid.wrap(a, e["i"]) == F.col(a))) if images else F.array().cast("array<struct<i:int,held:boolean,own:boolean>>")  # noqa: B023
        rows = rows.withColumn("__e", F.explode(F.concat(F.array(here), F.array_distinct(seen))))
        rows = rows.withColumn(f"__i{a}", F.col("__e.i")).withColumn("__held", F.col("__held") & F.col("__e.held")).withColumn("__own", F.col("__own") & F.col("__e.own")).drop("__e")
    return rows.where("__held or __own") if grid is not None else rows


def by_block(points: DataFrame, reach: int, work: Callable[[Block], pa.Table], schema: T.StructType, grid: Grid | None = None, size: int = SIZE) -> DataFrame:
    """``work`` of every block, whose table has the columns of ``points``; ``schema``: of what it returns. One shuffle, by block.

    Points lie inside the domain of ``grid``, if there is one. Rows with a null index or phi are left out.
    """
    if 2 * reach >= size:
        raise ValueError("a block must be wider than twice the reach")
    cell = lambda a, s: F.expr(f"floor((__i{a} + {s}) / {size})").cast("int")
    blocks = F.array_distinct(F.array(*[F.struct(cell("x", s).alias("x"), cell("y", t).alias("y")) for s in (-reach, reach) for t in (-reach, reach)]))
    rows, kept = points.dropna(subset=[*KEY, "phi"]), points.columns
    rows = _entries(rows, reach, grid) if grid is not None else rows.withColumns({f"__i{a}": F.col(a) for a in AXES})
    dealt = rows.withColumn("__b", F.explode(blocks)).withColumn("__bx", F.col("__b.x")).withColumn("__by", F.col("__b.y"))
    if grid is None:
        # what a task can tell by itself isn't shuffled
        dealt = dealt.select(*kept, "__bx", "__by")
    else:
        dealt = dealt.withColumn("__own", F.col("__own") & (F.col("__bx") == cell("x", 0)) & (F.col("__by") == cell("y", 0))).drop("__b")

    def run(table: pa.Table) -> pa.Table:
        if grid is None:
            table = placed(table, np.logical_and(*(table[a].to_numpy() // size == table[f"__b{a}"].to_numpy() for a in "xy")))
        return work(Block(table, reach))

    return spread(dealt, "layer", "__bx", "__by").groupBy("layer", "__bx", "__by").applyInArrow(run, schema)


def placed(table: pa.Table, own: np.ndarray) -> pa.Table:
    """A block's rows with the columns that ``Block`` asks for, where all stand at their own indices and are looked up there."""
    for name, c in (*((f"__i{a}", table[a]) for a in AXES), ("__own", pa.array(own)), ("__held", pa.array(np.ones(len(table), bool)))):
        table = table.append_column(name, c)
    return table


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many partitions as the session shuffles to: small rows make much work here, which merged partitions would keep together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def offset_values(points: DataFrame, offsets: dict[str, tuple[int, int, int]], grid: Grid | None = None) -> DataFrame:
    """``points``, all columns, with a column for each offset: phi of the point there, null if absent."""
    reach = max((abs(s) for o in offsets.values() for s in o), default=0)
    kept, kind = points.columns, points.schema["phi"].dataType
    schema = T.StructType([*points.schema.fields, *[T.StructField(n, kind) for n in offsets]])

    def work(b: Block) -> pa.Table:
        at = b.at[:, b.own]
        found = [b.values(b.find(at + np.array(o)[:, None])) for o in offsets.values()]
        return pa.Table.from_arrays([*b.rows(b.own, kept), *found], names=[*kept, *offsets])

    return by_block(points, reach, work, schema, grid)


def cycles(width, unit, start) -> int:
    """How many cycles widen a band from ``start`` to ``width``."""
    n = 0
    while start < width:
        start, n = min(start + 2 * unit, width), n + 1
    return n


def widened(points: DataFrame, width, unit, start, offsets: dict[str, tuple[int, int, int]] | None = None, within=None) -> DataFrame:
    """(layer, x, y, z, phi) of the band made ``width`` wide (see ``algebra.expand``) with a column for each offset: phi of the wide band there, null if absent;
    ``within``: of points up to so far from the surface only. One shuffle for all cycles and the offsets: blocks have borders as wide as all of them together."""
    own, offsets = points.select(*KEY, "phi"), offsets or {}
    schema = T.StructType([*own.schema.fields, *[T.StructField(n, own.schema["phi"].dataType) for n in offsets]])
    reach = max(1, cycles(width, unit, start) + max((abs(s) for o in offsets.values() for s in o), default=0))
    size = max(SIZE, 4 * reach)

    def work(b: Block) -> pa.Table:
        key, phi = b.widened(width, unit, start)
        at = b.place(key)
        home = (at[0] // size == b.table["__bx"][0].as_py()) & (at[1] // size == b.table["__by"][0].as_py())
        if within is not None:
            home &= np.abs(phi) <= within
        at, found = at[:, home], []
        for o in offsets.values():
            k = b._key(at + np.array(o)[:, None])
            p = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
            there = key[p] == k if len(key) else np.zeros(0, bool)
            found.append(pa.array(phi[p] if len(key) else phi, b.kind, mask=~there))
        layer = pa.array(np.full(at.shape[1], b.table["layer"][0].as_py()), b.table["layer"].type)
        return pa.Table.from_arrays([layer, *(pa.array(v).cast(b.table[a].type) for a, v in zip(AXES, at, strict=True)), pa.array(phi[home], b.kind), *found], names=schema.names)

    return by_block(own, reach, work, schema, None, size)


def pruned(points: DataFrame) -> DataFrame:
    """(layer, x, y, z, phi) of points of which an axis neighbour has the other sign."""
    own = points.select(*KEY, "phi")

    def work(b: Block) -> pa.Table:
        at = b.at[:, b.own]
        inside = b.phi[b.own] < 0 if len(b.own) else np.zeros(0, bool)
        other = np.zeros(len(b.own), bool)
        for i in range(3):
            for s in (-1, 1):
                step = np.zeros((3, 1), np.int64)
                step[i] = s
                sign = b.sign(at + step)
                other |= (sign != 0) & ((sign < 0) != inside)
        return pa.Table.from_arrays(b.rows(b.own[other], [*KEY, "phi"]), names=[*KEY, "phi"])

    return by_block(own, 1, work, own.schema)


def _cells(b: Block, axes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block that a row touches and whose corners all have a sign: lowest corners, signs by cell and corner, and rows of the corners (-1 if absent)."""
    n = 1 << len(axes)
    shift = np.array([[c >> axes.index(a) & 1 if a in axes else 0 for c in range(n)] for a in AXES])
    # cells whose lowest corner is one of the block's own columns
    home = [b.table[c][0].as_py() if len(b.table) else 0 for c in ("__bx", "__by")]
    low = (b.at[:, :, None] - shift[:, None, :]).reshape(3, -1)
    low = low[:, (low[0] // SIZE == home[0]) & (low[1] // SIZE == home[1])]
    low = b.place(np.unique(b._key(low)))
    at = (low[:, :, None] + shift[:, None, :]).reshape(3, -1)
    sign = b.sign(at).reshape(-1, n)
    known = (sign != 0).all(axis=1)
    return low[:, known], sign[known], b.find(at.reshape(3, -1, n)[:, known].reshape(3, -1)).reshape(-1, n)


def cell_parts(points: DataFrame, axes: list[str], parts: dict[int, list[list[list[int]]]], far: float) -> DataFrame:
    """(layer, x, y, z, part, edges, t): the parts that ``parts`` has for the case of each cell, made where the cell is. A node of a part is a pair of corners,
    in edges as corners' number times the first and the second, and t: where on the edge phi is 0, 0 at a corner. A corner that no row holds counts ``far`` by its sign."""
    n, own = 1 << len(axes), points.select("layer", *[F.col(a).cast("int").alias(a) for a in AXES], "phi")
    schema = T.StructType([*[own.schema[k] for k in KEY], T.StructField("part", T.IntegerType()), T.StructField("edges", T.ArrayType(T.IntegerType())), T.StructField("t", T.ArrayType(T.DoubleType()))])
    bits = 1 << np.arange(n)
    many = np.array([len(parts.get(code, ())) for code in range(1 << n)])
    first = np.cumsum(many) - many
    pairs = np.array([p for code in range(1 << n) for p in parts.get(code, ())])

    def work(b: Block) -> pa.Table:
        low, sign, held = _cells(b, axes)
        code = (sign > 0) @ bits
        cell = np.repeat(np.arange(len(code)), many[code])
        part = np.arange(len(cell)) - np.repeat(np.cumsum(many[code]) - many[code], many[code])
        v = np.where(held >= 0, b.phi[np.maximum(held, 0)].astype(float), far * sign)
        edge = pairs[first[code[cell]] + part]
        p, q = v[cell[:, None], edge[:, :, 0]], v[cell[:, None], edge[:, :, 1]]
        same = edge[:, :, 0] == edge[:, :, 1]
        t = np.where(same, 0.0, np.divide(p, p - q, out=np.zeros_like(p), where=~same))
        ends = pa.array(np.arange(len(cell) + 1, dtype=np.int32) * pairs.shape[1])
        lists = [pa.ListArray.from_arrays(ends, pa.array(c.reshape(-1))) for c in ((edge[:, :, 0] * n + edge[:, :, 1]).astype(np.int32), t)]
        layer = pa.array(np.full(len(cell), b.table["layer"][0].as_py() if len(b.table) else 0), pa.int32())
        return pa.Table.from_arrays([layer, *(pa.array(a[cell].astype(np.int32)) for a in low), pa.array(part.astype(np.int32)), *lists], names=schema.names)

    return by_block(own, 1, work, schema)


def cell_corners(points: DataFrame, axes: list[str]) -> DataFrame:
    """(layer, x, y, z, code, corners) of the cells that a row touches and whose corners all have a sign; see ``stencil.cells``."""
    n, own = 1 << len(axes), points.select("layer", *[F.col(a).cast("int").alias(a) for a in AXES], "phi")
    corner = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("phi", own.schema["phi"].dataType), T.StructField("sign", T.IntegerType())])
    schema = T.StructType([*[own.schema[k] for k in KEY], T.StructField("code", T.IntegerType()), T.StructField("corners", T.ArrayType(corner))])
    bits = 1 << np.arange(n)

    def work(b: Block) -> pa.Table:
        low, sign, held = _cells(b, axes)
        held = held.reshape(-1)
        each = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(sign))), b.values(held), pa.array(sign.reshape(-1).astype(np.int32))], names=["c", "phi", "sign"])
        corners = pa.ListArray.from_arrays(pa.array(np.arange(len(sign) + 1, dtype=np.int32) * n), each)
        layer = pa.array(np.full(len(sign), b.table["layer"][0].as_py() if len(b.table) else 0), pa.int32())
        return pa.Table.from_arrays([layer, *(pa.array(v.astype(np.int32)) for v in low), pa.array(((sign > 0) @ bits).astype(np.int32)), corners], names=[*KEY, "code", "corners"])

    return by_block(own, 1, work, schema)
