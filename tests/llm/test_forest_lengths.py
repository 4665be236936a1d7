"""Recall by inner product on vectors of unequal length, with a direction in common, in clusters; at the size of a block."""

import numpy as np
import pandas as pd
import pytest

from isofield.llm import op6_forest as forest

N, DIM = 8192, 64


def vectors(kind):
    r = np.random.default_rng(12)
    v = r.standard_normal((N, DIM))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    if kind.startswith("lognormal"):
        return u * r.lognormal(0, float(kind.split()[1]), (N, 1))
    if kind == "clusters":
        return r.standard_normal((50, DIM))[r.integers(0, 50, N)] * 3 + v
    return {"unit": u, "raw": v, "shifted": v + 2, "one long": np.vstack([u[:-1], 1000 * u[-1:]])}[kind]


@pytest.mark.parametrize("kind", ["unit", "raw", "lognormal 0.5", "lognormal 1", "shifted", "clusters", "one long"])
def test_recall_and_share(kind):
    v = vectors(kind)
    frame = pd.DataFrame({"row": np.arange(N), "vec_id": np.arange(N), "embedding": list(v)})
    asked = frame[frame["vec_id"] % 40 == 0]
    got = forest.search_block(frame, asked, 20).sort_values(["query_id", "score"], ascending=[True, False])
    s = v[::40] @ v.T
    s[np.arange(len(s)), np.arange(0, N, 40)] = -np.inf
    twentieth = np.partition(s, N - 20, axis=1)[:, -20]
    score = got["score"].to_numpy().reshape(-1, 20)
    assert len(score) == len(s) and (score >= twentieth[:, None] - 1e-9 * np.abs(twentieth[:, None])).mean() > 0.9
    share = np.mean([len(x) / N for x in forest.visited(v, v[::40], 21)])
    assert share < 0.6


def test_strata():
    r = np.random.default_rng(3)
    for length in (np.zeros(300), np.ones(5000), r.lognormal(0, 3, 4000), np.array([1.0]), np.zeros(0), np.array([5.0, 0.0, 0.0])):
        parts = list(forest.strata(length))
        assert sorted(np.concatenate(parts).tolist() if parts else []) == list(range(len(length)))
        ends = [(length[p].max(), length[p].min(), len(p)) for p in parts]
        assert all(b[0] <= a[1] for a, b in zip(ends, ends[1:]))
        assert all(low >= forest.ALIKE * high or n <= forest.FEW for high, low, n in ends)


def test_extreme_and_equal_vectors():
    """No warning turns into a wrong result: one place for all, numbers at both ends of the range, dimensions of one."""
    for v in (np.ones((500, 3)), np.full((40, 2), 1e300), np.arange(1.0, 301)[:, None] * 1e-300, np.array([[1e308, -1e308], [1.0, 1.0], [-1e-308, 0.0]])):
        frame = pd.DataFrame({"row": np.arange(len(v)), "vec_id": np.arange(len(v)), "embedding": list(v)})
        got = forest.search_block(frame, frame[:2], 5)
        assert sorted(got["query_id"].value_counts().tolist()) == [min(5, len(v) - 1)] * 2
