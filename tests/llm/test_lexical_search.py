"""Ranked search: against SQL on awkward rows and random ones, whatever counts as short and however wide a window or shard is."""

import random

import numpy as np
import pytest

from isofield.llm import op11_lexical_search as op


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]
    rows = [(i if i % 50 else None, " ".join(r.choices(words, odds, k=r.randint(1, 40))), 1) for i in range(900)]
    rows += [(7, "Same same W1", 1), (7, "Same same W1", 1), (5000, "", 1), (5001, None, 1), (5002, " .,;- \t", 1), (5003, "W3 " * 50_000 + "été", 1)]
    items = [(str(i), " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(30)] + [("x", "same same w1 w1 ÉTÉ été"), ("x", "nowhere"), ("none", None), (None, "w3 w3 w3"), ("x", "same same w1 w1 ÉTÉ été")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").repartition(3)
    return docs, spark.createDataFrame(items, "item_id string, text string").selectExpr("item_id", "text", "7 AS doc_id")


@pytest.mark.parametrize("short, window, docs, block", [(32, 512, 1 << 14, 8 << 20), (4, 16, 1 << 14, 8 << 20), (1, 7, 50, 100), (10**9, 3, 300, 8 << 20)])
def test_against_sql(corpus, duck, same, monkeypatch, short, window, docs, block):
    for name, value in (("SHORT", short), ("WINDOW", window), ("SHARD_DOCS", docs), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(op, name, value)
    d, items = corpus
    same(op.search(d, items).toPandas(), duck(op.ORACLE, documents=d.toArrow(), benchmark=items.toArrow()))


def test_fixture_rows(docs, duck, same):
    items = docs.selectExpr("doc_id AS item_id", "text")
    same(op.search(docs, items).toPandas(), duck(op.ORACLE, documents=docs.toArrow(), benchmark=items.toArrow()))


def test_empty_tables(docs):
    items = docs.selectExpr("doc_id AS item_id", "text")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.where("text is null"))):
        assert op.search(d, i).count() == 0


def test_skipping_keeps_the_best():
    """One shard by itself, with scores that often tie, against a sum over all lists."""
    r = np.random.default_rng(2)
    for _ in range(300):
        n, t = int(r.integers(1, 90)), int(r.integers(1, 9))
        held = [np.flatnonzero(r.random(n) < r.random()) for _ in range(t)]
        held = [h if len(h) else np.array([0]) for h in held]
        tf = [r.integers(1, 3, len(h)) for h in held]
        row = {"doc_ids": np.arange(n), "sizes": r.integers(1, 4, n), "terms": np.arange(t), "lengths": np.array([len(h) for h in held]), "docs": np.concatenate(held), "tf": np.concatenate(tf), "n_null": 0}
        weights = r.integers(0, 4, t)
        lists = op.Lists(row, weights, n, int(row["sizes"].sum()), int(r.choice([1, 2, 5, 40])), int(r.choice([1, 4, 16, 512])))
        times, k = r.integers(1, 3, t), int(r.integers(1, 12))
        score = np.zeros(n, np.int64)
        for a, h, q in zip(lists.start, held, times):
            score[h] += q * lists.gain[a : a + len(h)]
        want = [int(i) for i in np.lexsort((np.arange(n), -score)) if score[i] > 0][:k]
        docs, top = lists.best(np.arange(t), times, k)
        assert docs.tolist() == want and top.tolist() == score[want].tolist()
