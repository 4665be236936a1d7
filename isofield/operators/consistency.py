"""Whether a level set is one: faults between neighbours, held or not, by blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import AXES
from .blocks import Block, by_block

#: What counts as the end of a column, as in ``analytics.runs``.
END = 1 << 30
FAULTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("layer", *AXES)] + [T.StructField("fault", T.StringType()), T.StructField("axis", T.StringType()), T.StructField("step", T.IntegerType())])


def _gaps(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of each column that no row holds, in order: (x, y, from, to) and their signs."""
    x, y, z = b.at
    inside = np.where(b.phi < 0, -1, 1)
    first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    last = np.append(first[1:], True)
    ahead = np.where(last, END + 1, np.append(z[1:], 0))
    above, low = np.flatnonzero(ahead > z + 1), np.flatnonzero(first)
    at = np.concatenate([np.stack([x[low], y[low], np.full(len(low), -END), z[low] - 1]), np.stack([x[above], y[above], z[above] + 1, ahead[above] - 1])], axis=1)
    order = np.lexsort((at[2], at[1], at[0]))
    return at[:, order], np.concatenate([inside[low], inside[above]])[order]


def faults(points: DataFrame, unit=1000) -> DataFrame:
    """(layer, x, y, z, fault, axis, step): every neighbourhood that no level set has.

    values: two held neighbours whose distances, rounded to whole cells (halves towards 0), differ by more than one; told at both. negative: a
    point deeper than half a cell beside one that no row holds and that is outside; positive: the reverse. runs: stretches of two columns side by side, which no row
    holds, of opposite signs; told at the first place at which they meet (-2**30: the columns' end), for the column with the lower index.
    Columns without rows have no sign and no faults. One shuffle by block; stretches meet by their order in their columns, not by pairs.
    """
    own = points.select("layer", *AXES, "phi")

    def work(b: Block) -> pa.Table:
        out = []
        if len(b.own):
            at, phi = b.at[:, b.own], b.phi[b.own].astype(float) / unit
            state = lambda v: np.sign(v) * np.maximum(np.ceil(np.abs(v) - 0.5), 0)
            for i, a in enumerate(AXES):
                for s in (-1, 1):
                    step = np.zeros((3, 1), np.int64)
                    step[i] = s
                    row, sign = b.find(at + step), b.sign(at + step)
                    other = np.where(row >= 0, b.phi[np.maximum(row, 0)].astype(float) / unit, 0.0)
                    for name, bad in (("values", (row >= 0) & (np.abs(state(phi) - state(other)) > 1)), ("negative", (row < 0) & (sign > 0) & (phi < -0.5)), ("positive", (row < 0) & (sign < 0) & (phi > 0.5))):
                        out.append((at[:, bad], name, a, s))
            gap, sign = _gaps(b)
            mine = np.unique(b.at[:2, b.own], axis=1)
            wide = int(gap[1].max() - gap[1].min() + 3)
            column = lambda x, y: (x - gap[0].min()) * wide + y - gap[1].min() + 1
            # ends of stretches as one rising sequence over all columns
            key = lambda c, z: c * (4 * END) + z + 2 * END
            of = column(gap[0], gap[1])
            start, end = key(of, gap[2]), key(of, gap[3])
            held = np.isin(of, column(mine[0], mine[1]))
            for i, a in enumerate(AXES[:2]):
                k = np.flatnonzero(held)
                beside = column(gap[0, k] + (i == 0), gap[1, k] + (i == 1))
                low, high = np.searchsorted(end, key(beside, gap[2, k])), np.searchsorted(start, key(beside, gap[3, k]), side="right")
                n = np.maximum(high - low, 0)
                p = np.repeat(k, n)
                q = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                bad = (of[q] == np.repeat(beside, n)) & (sign[p] != sign[q])
                p, q = p[bad], q[bad]
                out.append((np.stack([gap[0, p], gap[1, p], np.maximum(gap[2, p], gap[2, q])]), "runs", a, 1))
        layer = b.table["layer"][0].as_py() if len(b.table) else 0
        at = np.concatenate([o[0] for o in out], axis=1) if out else np.zeros((3, 0), np.int64)
        n = [o[0].shape[1] for o in out]
        text = lambda j: pa.array(np.repeat(np.array([o[j] for o in out], object), n), pa.string()) if out else pa.array([], pa.string())
        step = np.repeat(np.array([o[3] for o in out], np.int32), n) if out else np.zeros(0, np.int32)
        return pa.Table.from_arrays([pa.array(np.full(at.shape[1], layer, np.int32)), *(pa.array(v.astype(np.int32)) for v in at), text(1), text(2), pa.array(step)], names=FAULTS.names)

    return by_block(own.withColumn("layer", F.col("layer").cast("int")), 1, work, FAULTS)
