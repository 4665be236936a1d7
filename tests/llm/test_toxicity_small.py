"""Toxic words that are rare, and small samples."""

import random

import pytest

from isofield.llm import op2_toxicity as tox
from isofield.llm.common import table


def test_rare_words_count(spark):
    """Each toxic word is in a thirtieth of the toxic documents; none comes near five standard deviations."""
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefghijklmno", k=7)) for _ in range(400)]
    bad = ["".join(rng.choices("pqrstuvwxyz", k=7)) for _ in range(30)]
    rows = [(i, int(i % 2), " ".join([*rng.choices(plain, k=40), *[bad[i // 2 % 30]] * (i % 2 * 2)])) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, toxic int, text string")
    got = tox.toxicity(d, d).join(d, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) > 0.9 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.05 * n[0, 0]


@pytest.mark.parametrize("size, least", [("sf0.001", 0.0), ("sf0.01", 0.5)])
def test_small_samples(spark, size, least):
    """sf0.001 has 10 toxic documents to learn from and one held out, so only that something was learned."""
    docs, labels = (table(spark, f"/root/testdata/{size}", n) for n in ("documents", "labels"))
    model = tox.fit(docs, labels)
    assert any(o > 1 for o, _ in model.odds.values()) and model.curve[1] > 0
    got = tox.score(docs, model).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) >= least and n.get((0, 1), 0) <= 0.02 * n[0, 0]
