"""The forest at a size where it leaves rows out, and awkward vectors."""

import numpy as np
import pytest

from isofield.llm import op6_forest as forest


def exact(ids, v, every=20, k=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = forest.products(v, np.broadcast_to(v[i], v.shape))
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = s[best]
    return out


def test_recall_and_share_at_fifty_thousand(spark):
    """Vectors without any structure, the hardest case: recall at 20 is 0.9 at least, of less than half of the rows."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((50_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    own, q = v[:8000], v[8000:8200]
    h = forest.hashes(own)
    tree = [(h[o, t], o) for t, o in enumerate(np.argsort(h, axis=0, kind="stable").T)]
    share = np.mean([len(at) / len(own) for at in forest.candidates(tree, forest.hashes(q), forest.VISITED * len(own))])
    assert share < 0.5
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist()) if i % 7 or i % 20 == 0], "vec_id bigint, embedding array<double>")
    ids = np.array([i for i in range(len(v)) if i % 7 or i % 20 == 0])
    s = v[ids[ids % 20 == 0]] @ v[ids].T
    s[np.arange(len(s)), np.flatnonzero(ids % 20 == 0)] = -9
    twentieth = np.partition(s, s.shape[1] - 20, axis=1)[:, -20]
    got = forest.nearest(d).toPandas().sort_values(["query_id", "rank"])
    assert len(got) == 20 * len(twentieth)
    assert (got["score"].to_numpy().reshape(-1, 20) >= twentieth[:, None] - 1e-12).mean() > 0.9


def test_one_vector_held_by_a_third_of_all_rows(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((3000, 16))
    v[::3] = v[0]
    ids = np.arange(3000)
    got = forest.nearest(spark.createDataFrame([(int(i), x) for i, x in zip(ids, v.tolist(), strict=True)], "vec_id bigint, embedding array<double>")).toPandas()
    want = exact(ids, v)
    hit = n = 0
    for i, own in got.sort_values("rank").groupby("query_id"):
        hit += (own["score"].to_numpy() >= want[i][-1] - 1e-12).sum()
        n += 20
        if i % 3 == 0:
            assert own["vec_id"].tolist() == [j for j in range(0, 63, 3) if j != i][:20]
    assert hit / n > 0.9 and n == 150 * 20


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [2.0, 0.0]), (3, [0.5, 0.5])]
    got = sorted(tuple(r) for r in forest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(20, 1, 20, 2.0), (20, 1, 20, 2.0), (20, 2, 3, 0.5), (20, 2, 3, 1.0)]


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e150])
def test_lengths(spark, scale):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((300, 8)) * scale
    ids = np.arange(300)
    got = forest.nearest(spark.createDataFrame([(int(i), x) for i, x in zip(ids, v.tolist(), strict=True)], "vec_id bigint, embedding array<double>")).toPandas()
    for i, s in exact(ids, v).items():
        assert got[got["query_id"] == i].sort_values("rank")["score"].tolist() == s.tolist()


def test_empty(spark):
    assert forest.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
