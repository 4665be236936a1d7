"""Nearest neighbours by inner product with an LSH forest (hash-prefix forest).

Vectors are dealt into blocks of at most ``BLOCK`` rows, queries into blocks of ``QUERIES``. Within a block the mean vector is taken off, which adds the same to all
inner products of a query, and vectors are laid in strata of nearly equal length, the longest first. A stratum has its own forest, in
which each vector has one more component that makes all of them as long as the longest, so that the angle to a query follows the inner product. For
each of ``TREES`` trees there is the sorted array of 32-bit hash strings (signs of random projections). A query descends in every
tree to the longest prefix that some row shares; then all trees ascend together, one bit at a time, until the candidates, counted
over the trees, are at least ``VISITED`` times the stratum's distinct vectors. A stratum whose longest vector can't reach the nearest found so far is skipped, which loses
nothing. Inner products are taken of a query with its candidates only; the best of each block go on, a fixed number a query and block, and are merged.

Queries go to every block, which is the stated query set against all rows. No group is larger than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TREES, DEPTH = 96, 32
BLOCK, QUERIES = 8192, 4096
#: Candidates that a query visits in a stratum, counted once for each tree that brings them: this share of its vectors, no fewer than ``FEWEST``, and its part
#: of ``LEAST`` in a small block. With it recall at 20 is over 0.9 even on vectors without structure, of any lengths, or with a direction in common.
VISITED, LEAST, FEWEST = 0.45, 3_000, 800
#: A stratum's vectors are at least this part as long as its longest; shorter ones join a stratum of fewer than ``FEW``.
ALIKE, FEW = 0.8, 64
NEAREST = 20


@lru_cache(maxsize=4)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(20240229 + dim).standard_normal((dim, TREES * DEPTH))


def hashes(v: np.ndarray) -> np.ndarray:
    """Hash strings of the rows, one uint32 a tree; the first projection is the highest bit. A row's length doesn't matter."""
    top = np.abs(v).max(axis=1, keepdims=True)
    planes, weight = _planes(v.shape[1]), np.uint64(1) << np.arange(DEPTH - 1, -1, -1, dtype=np.uint64)
    out = [((part / scale @ planes > 0).reshape(len(part), TREES, DEPTH) * weight).sum(axis=2) for part, scale in ((v[a : a + 1024], top[a : a + 1024]) for a in range(0, len(v), 1024))]
    return np.concatenate(out)


def ascended(tree: list[tuple[np.ndarray, np.ndarray]], h: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """First and end place in every tree's sorted array (rows: queries, columns: trees) of the rows that each query visits.

    ``tree``: sorted hash strings and their rows; ``h``: the queries' strings.
    """
    q = len(h)
    low, high = np.zeros((q, TREES), np.int64), np.zeros((q, TREES), np.int64)
    open_ = np.arange(q)
    for depth in range(DEPTH, -1, -1):  # trees ascend together
        shift = np.uint64(DEPTH - depth)
        for t, (strings, _) in enumerate(tree):
            first = (h[open_, t] >> shift) << shift
            low[open_, t] = np.searchsorted(strings, first)
            high[open_, t] = np.searchsorted(strings, first + (np.uint64(1) << shift))
        open_ = open_[(high[open_] - low[open_]).sum(axis=1) < wanted]
        if not len(open_):
            break
    return low, high


def candidates(tree: list[tuple[np.ndarray, np.ndarray]], h: np.ndarray, wanted: float) -> Iterator[np.ndarray]:
    """For every query the numbers of the rows it visits, in order."""
    low, high = ascended(tree, h, wanted)
    mask = np.zeros(len(tree[0][0]), bool)
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        mask[:] = False
        for (_, rows), x, y in zip(tree, a, b, strict=True):
            mask[rows[x:y]] = True
        yield np.flatnonzero(mask)


def strata(length: np.ndarray) -> Iterator[np.ndarray]:
    """Vectors by falling length, in parts of nearly equal ones."""
    order = np.argsort(-length, kind="stable")
    falling, a = -length[order], 0
    while a < len(order):
        alike = int(np.searchsorted(falling, falling[a] * ALIKE, side="right"))
        b = min(max(alike, a + FEW), len(order))
        yield order[a:b]
        a = b


def visited(u: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the numbers of the vectors ``u`` that it visits; ``k``: how many best ones a stratum has to beat."""
    x = u / np.abs(u).max()
    x = x - x.mean(axis=0)
    length = np.linalg.norm(x, axis=1)
    q = q / np.abs(q).max(axis=1, keepdims=True)
    asked, q_length = hashes(np.hstack([q, np.zeros((len(q), 1))])), np.linalg.norm(q, axis=1)
    # twice what rounding can move a product
    slack = 4 * u.shape[1] * np.finfo(float).eps * q_length * length.max()
    best = np.full((len(q), k), -np.inf)
    seen: list[list[np.ndarray]] = [[] for _ in q]
    for own in strata(length):
        longest = length[own].max()
        live = np.flatnonzero(q_length * longest >= best[:, 0] - slack)
        if not len(live):
            break
        h = hashes(np.hstack([x[own], np.sqrt(np.maximum(0.0, longest * longest - length[own] ** 2))[:, None]]))
        tree = [(h[o, t], o) for t, o in enumerate(np.argsort(h, axis=0, kind="stable").T)]
        for i, found in zip(live.tolist(), candidates(tree, asked[live], min(TREES * len(own), max(VISITED * len(own), LEAST * len(own) / len(u), FEWEST, 4 * k))), strict=True):
            found = own[found]
            seen[i].append(found)
            # in order, so that the first is the worst of the best
            best[i] = np.sort(np.partition(np.concatenate([best[i], x[found] @ q[i]]), -k)[-k:])
    return [np.concatenate(s) if s else np.zeros(0, np.int64) for s in seen]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added in order, so that equal vectors give equal scores everywhere."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


_FOUND = "ask bigint, query_id bigint, vec_id bigint, score double"


def search_block(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of a block for each query of a block of queries; only vectors of equal length are compared.

    Both: row (names a row), vec_id, embedding.
    """
    found: list[tuple[np.ndarray, ...]] = []
    width, asked_width = rows["embedding"].map(len).to_numpy(), asked["embedding"].map(len).to_numpy()
    for dim in np.unique(width):
        own, ask = rows[width == dim], asked[asked_width == dim]
        if not len(ask):
            continue
        v, ids, names = np.ascontiguousarray(np.stack(own["embedding"].to_numpy()).astype(float)), own["vec_id"].to_numpy(), own["row"].to_numpy()
        q, q_ids, q_names = np.stack(ask["embedding"].to_numpy()).astype(float), ask["vec_id"].to_numpy(), ask["row"].to_numpy()
        # equal vectors are one entry of the forest, however many; of its rows the k + 1 with the smallest ids can be among the nearest
        _, first, entry = np.unique(v.view(np.dtype((np.void, v.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, entry))
        order = order[np.arange(len(order)) - np.searchsorted(entry[order], entry[order]) <= k]
        bounds = np.searchsorted(entry[order], np.arange(len(first) + 1))
        u = v[first]
        with np.errstate(over="ignore", invalid="ignore"):
            # twice what rounding can move a sum of so many products of so long vectors
            slack = 4 * dim * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(u, axis=1).max()
            for i, seen in enumerate(visited(u, q, k + 1)):
                if len(seen) > k + 1:  # one entry may hold the query's own row alone
                    near = u[seen] @ q[i]
                    seen = seen[~(near < np.partition(near, len(near) - k - 1)[len(near) - k - 1] - slack[i])]
                at = np.concatenate([order[bounds[e] : bounds[e + 1]] for e in seen])
                at = at[names[at] != q_names[i]]
                exact = products(v[at], np.broadcast_to(q[i], (len(at), dim)))
                best = np.lexsort((ids[at], -exact))[:k]
                found.append((np.full(len(best), q_names[i]), np.full(len(best), q_ids[i]), ids[at][best], exact[best]))
    columns = [c.split()[0] for c in _FOUND.split(", ")]
    if not found:
        return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in columns})
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that can take part: not null, not empty, finite and not zero."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row whose vec_id is divisible by ``every``.

    score is the inner product in double precision; ties go to the smaller vec_id; a query's own row is no candidate. Rows
    whose id or vector is null, empty or zero or holds null or non-finite components take no part; vectors of
    different lengths aren't compared. Rows that repeat a vec_id are rows like others: each is a candidate, even of the other, and each
    is a query with ranks of its own where the id is divisible. Fewer than ``k`` candidates: all.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    n_blocks, n_asks = max(1, -(-total * 5 // (BLOCK * 4))), max(1, -(-total // every // QUERIES))
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks))
    data = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))).alias("ask"), "row", "vec_id", "embedding")
    asks = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_asks)).cast("int").alias("ask"), "row", "vec_id", "embedding")

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, k)

    found = data.groupBy("block", "ask").cogroup(asks.groupBy("block", "ask")).applyInPandas(one, _FOUND)
    w = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
