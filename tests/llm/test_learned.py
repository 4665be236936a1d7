"""Operators without SQL: brute force, exact round trips, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isofield.llm import op2_toxicity as tox
from isofield.llm import op3_extraction as html
from isofield.llm import op6_forest as forest
from isofield.llm import op9_training_order as order
from isofield.llm import op10_language as lang
from isofield.llm.common import table
from isofield.llm.op7_decontamination import FMIndex


def best_segments(scores):
    """All maximal segments by recursion on the best one (the definition)."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*best_segments(scores[:a]), (a, b), *[(x + b, y + b) for x, y in best_segments(scores[b:])]]


def test_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 7 for _ in range(rng.randint(0, 12))]
        assert [(a, b) for a, b, _ in tox.segments(s)] == best_segments(s)


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = tox.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / n[0, 0] < 0.02


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = tox.toxicity(docs, none)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert tox.without_toxic(docs, none).columns == docs.columns


def test_extraction():
    page = """<!DOCTYPE html><html><head><title>t</title><script>if (a<b) "</p>";</script><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, yes, many.</p></div>
    <div id=main class='post-content'><h1>Head &amp; title</h1><p>First,  long &eacute;\n paragraph, with commas, and more.<p>Second<br>line <b>bo</b>ld.</div>
    <aside class="sidebar"><p>Other, things, here.</p></aside><div class=comments><p>I, reader, say, much, more, than, others.</p></div><form><input><p>Send, now</p></form><footer>&copy; x</footer></body></html>"""
    assert html.main_text(page) == "Head & title First, long é paragraph, with commas, and more. Second line bold."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><script>x") == ""
    assert html.main_text("<article><p>broken &amp; off, here <b>an") == "broken & off, here an"


def test_extraction_table(spark, sf):
    pages = table(spark, sf, "pages")
    got = html.extract(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in got)


def test_forest_recall(spark):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = forest.nearest(v).toPandas()
    e = v.orderBy("vec_id").toPandas()
    m, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    q = np.flatnonzero(ids % 20 == 0)
    s = m[q] @ m.T
    s[np.arange(len(q)), q] = -9
    twentieth = np.sort(s, axis=1)[:, -20]
    score = got.sort_values(["query_id", "rank"])["score"].to_numpy().reshape(-1, 20)
    assert (score >= twentieth[:, None] - 1e-12).mean() > 0.9


def test_forest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (20, [0.0, 1.0]), (3, None), (40, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 0.0, 0.0])]
    got = [tuple(r) for r in forest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 400)
    text = np.concatenate([text, text[100:300]])
    index = FMIndex(text)
    for n in (1, 2, 5):
        patterns = np.stack([text[i : i + n] for i in range(0, 300, 7)] + [np.full(n, 9)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_feistel():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        assert sorted(order.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert order.feistel(np.arange(1000), 1000, 1).tolist() != order.feistel(np.arange(1000), 1000, 2).tolist()


def test_tokens_round_trip(spark, docs, tmp_path):
    length, shard = 64, 4
    out = order.training_order(docs, length=length, shard=shard).persist()
    rows = out.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows))) and {len(r["tokens"]) for r in rows} == {2 * length}
    stream = order.sequences(docs, length=length).orderBy("part", "row").collect()
    ids = np.concatenate([np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]] for r in stream])
    texts, part = [], []
    enc = order.Tokeniser(order.read_ranks(order.VOCABULARY)).encoding
    for i in ids.tolist():
        if i == order.END:
            texts.append(enc.decode(part))
            part = []
        else:
            part.append(i)
    assert sorted(texts) == sorted((r["text"] or "") for r in docs.select("text").collect())
    order.write_shards(out, str(tmp_path / "shards"), shard)
    got = order.read_from(spark, str(tmp_path / "shards"), 3, 6, length, shard).collect()
    assert [r["slot"] for r in got] == list(range(3, min(9, len(rows)))) and [bytes(r["tokens"]) for r in got] == [bytes(r["tokens"]) for r in rows[3:9]]


@pytest.mark.parametrize("text", ["a  b \n c", " lead x", "", " " * 10_000 + "ab c", "x" + "\n" * 12_345 + "y z", "a " + " " * 20_000, "b" + "\t" * 10_001 + " word", "\u3000" * 15_000 + "q"])
def test_tokeniser_equals_the_plain_one(text):
    t = order.Tokeniser(order.read_ranks(order.VOCABULARY))
    assert t.ids(text) == t.encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n " * 700_000 + "x", "a" * 1_000_000])
def test_tokeniser_takes_very_long_pieces(text):
    t = order.Tokeniser(order.read_ranks(order.VOCABULARY))
    assert t.encoding.decode(t.ids(text)) == text


def test_viterbi():
    rng = np.random.default_rng(3)
    for _ in range(100):
        s = rng.normal(0, 6, (rng.integers(1, 7), 3))
        path = lang.best_path(s, 5.0)
        value = lambda p: sum(s[i, j] for i, j in enumerate(p)) - 5.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        every = [value(p) for p in np.ndindex(*[3] * len(s))]
        assert abs(value(path.tolist()) - max(every)) < 1e-9


def test_language_on_held_out(spark):
    d = table(spark, "/root/testdata/sf0.1", "documents")
    got = lang.language(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97


def test_language_edges(spark, docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang.language(docs).collect()}
    assert got[4] == got[5] == got[6] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    digits = spark.createDataFrame([(1, "12 34 ²"), (2, "abc")], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    assert {r["doc_id"]: r["lang_pred"] for r in lang.language(digits).collect()} == {1: "und", 2: "en"}


def test_pipeline_keeps_whole_rows(spark, sf):
    import corpus_pipeline as p

    d = table(spark, sf, "documents")
    one = p.toxicity(spark, d, sf)
    assert one.columns == d.columns and one.count() > 0.8 * d.count()
    four = p.mixing(spark, one, sf)
    assert four.columns == d.columns and four.join(one, "doc_id", "left_anti").count() == 0
