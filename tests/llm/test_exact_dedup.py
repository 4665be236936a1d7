"""Exact dedup: against SQL over awkward rows, whatever the sketch finds; over groups of every size; no Python in the plan."""

import pytest

from isofield.llm import op13_exact_dedup as op


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(i, "the very same\ttext" if i % 3 == 0 else f"own text {i % 700}  {'a' * (i % 5)}", i) for i in range(3000)]
    rows += [(None, "the very same text", 1), (None, "only null ids", 1), (None, "only  null ids", 2), (0, "the very same text", 5), (0, "the very same text", 5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest int").repartition(7)


@pytest.mark.parametrize("counters, frequent", [(op.COUNTERS, op.FREQUENT), (16, 2), (64, 9)])
def test_against_sql(docs, groups, duck, same, counters, frequent):
    for d in (docs, groups):
        same(op.copies(d, counters, frequent).toPandas(), duck(op.ORACLE, documents=d.toArrow()))


def test_a_large_group_is_a_candidate(groups):
    digests = groups.select(op.digest(groups["text"]).alias("digest"))
    found = {r[0] for r in op.candidates(digests, 64, 9).collect()}
    import hashlib

    assert hashlib.sha256(b"the very same text").hexdigest() in found and len(found) <= 9


def test_rows_that_stay(docs, groups):
    for d in (docs, groups):
        for counters, frequent in ((op.COUNTERS, op.FREQUENT), (16, 2)):
            left = op.without_copies(d, counters, frequent)
            want = op.copies(d).where("kept").select("doc_id", "text_sha256")
            assert left.columns == d.columns
            got = left.select("doc_id", op.digest(left["text"]).alias("text_sha256"))
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_empty_long_and_spaces(spark, docs):
    assert op.copies(docs.limit(0)).count() == 0 and op.without_copies(docs.limit(0)).count() == 0
    long = "long " * 200_000
    d = spark.createDataFrame([(1, long), (2, long.replace(" ", "\n\n")), (3, ""), (4, None), (5, " "), (6, " "), (7, "\x0b\x0c")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in op.copies(d).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 2, True), 6: (6, 1, True), 7: (5, 2, False)}


def test_no_python_in_the_plan(docs):
    plan = op.copies(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "BroadcastHashJoin" in plan
