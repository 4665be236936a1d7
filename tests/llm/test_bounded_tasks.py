"""What a task holds at once is bounded by bytes and by members of sets, not only by rows; nothing is left out."""

import numpy as np
import pyarrow as pa
import pytest

from isofield.llm import op4_hyperminhash as near
from isofield.llm import op7_decontamination as leaks
from isofield.llm import op9_training_order as order
from isofield.llm.common import pieces


def test_pieces_hold_every_row():
    texts = ["", None, "x" * 30, "y" * 5, None, "z" * 9, "é" * 8, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["id", "text"])
    got = [b.column(1).to_pylist() for b in pieces([batch, batch.slice(0, 0), batch.slice(5)], 1, 10)]
    assert sum(got, []) == texts + texts[5:]
    assert all(sum(len((t or "").encode()) for t in p[:-1]) < 10 for p in got if any(p))


def taken(monkeypatch, make):
    """The functions that ``make`` hands to mapInArrow."""
    from pyspark.sql.classic.dataframe import DataFrame

    found, f = [], DataFrame.mapInArrow
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", lambda self, run, *a, **b: (found.append(run), f(self, run, *a, **b))[1])
        make()
    return found


def test_batches_of_long_texts_are_taken_in_pieces(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("i", "q r")], "item_id string, text string")
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60_000)) for _ in range(40)]  # 14 MB
    ids, text = pa.array(range(40)), pa.array([t.encode() for t in texts], pa.binary())
    sketch = taken(monkeypatch, lambda: near.sketches(d, 4))[-1]
    tokens = taken(monkeypatch, lambda: order._placed(d, order.VOCABULARY))[-1]
    clean = taken(monkeypatch, lambda: leaks.decontaminated(d, bench))[-1]
    for run, batch in ((sketch, [ids, ids, text]), (tokens, [ids, ids, pa.array(texts)]), (clean, [ids, text, pa.array([False] * 40)])):
        out = list(run(iter([pa.RecordBatch.from_arrays(batch, ["a", "b", "c"])])))
        assert [x for b in out for x in b.column(0).to_pylist()] == list(range(40))
        assert max(b.num_rows for b in out) < 20


@pytest.mark.parametrize("members", [300, 1_000_000])
def test_blocks_of_large_sets(spark, monkeypatch, members):
    """Texts around a hub that it leaves apart are compared in blocks whose sets together are bounded; groups are those of brute force."""
    monkeypatch.setattr(near, "MEMBERS", members, raising=False)
    kept, store = {}, near.stored
    monkeypatch.setattr(near, "stored", lambda df, name, *a: kept.setdefault(name, store(df, name, *a)))
    rng, texts = np.random.default_rng(10), []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(40)]
        for _ in range(16):
            w = list(base)
            for i in rng.choice(40, rng.integers(0, 4), replace=False):
                w[i] = f"x{rng.integers(1000)}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(37)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(d, 4).collect()} == {i: find(i) for i in range(len(texts))}
    most = kept["likely"].where("not ask").groupBy("hub", "mb", "ob").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0]
    rows = kept["around-hubs"].groupBy("hub").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0]
    assert 0 < most <= rows and (members > rows or most <= 1.5 * members)
