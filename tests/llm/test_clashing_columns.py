"""Stages and row operators on a table whose columns have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

NAMES = ["__key", "__size", "__taken", "__words", "__found", "row", "d", "t", "s", "text_key", "words", "found", "cut", "mix_key", "size", "taken", "spans", "a.b"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({n: F.concat(F.lit(n + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1), (7, 0), (9, 0)], "doc_id bigint, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_columns(spark, clashing, folder, at):
    import corpus_pipeline as p

    got = p.STAGES[at][1](spark, clashing, folder)
    assert got.columns == clashing.columns and got.dtypes == clashing.dtypes
    for r in got.collect():
        assert all(r[n] == f"{n}/{'-' if r['doc_id'] is None else r['doc_id']}" for n in NAMES)


def test_last_stage_ignores_them(spark, clashing, docs, folder):
    import corpus_pipeline as p

    rows = lambda d: sorted(map(repr, p.STAGES[4][1](spark, d, folder).collect()))
    assert rows(clashing) == rows(docs)


def test_a_cut_that_forms_a_passage_anew(spark):
    from isofield.llm import op7_decontamination as d

    items = spark.createDataFrame([(1, "a b c"), (2, "x y")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "p a b a x y b c c q"), (2, "x x y y")], "doc_id bigint, text string")
    clean = d.decontaminated(docs, items, 3)
    got = {r["doc_id"]: r["text"].split() for r in clean.collect()}
    assert d.contamination(clean, items, 3).where("contaminated").count() == 0 and got[2] == [] and got[1][0] == "p" and got[1][-1] == "q"
