"""Queries with SQL against DuckDB on a small fixture with awkward rows, with small limits, and on the smallest tables."""

import pytest

from isofield.llm import op1_line_dedup, op5_sharding, op7_decontamination, op8_mixing
from isofield.llm.op4_hyperminhash import near_duplicates, one_of_each
from isofield.llm.queries import LEAKS_ORACLE, NEAR_ORACLE, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_tables(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf).toPandas(), duck(ORACLES[name], sf))


def test_line_dedup(spark, docs, duck, same):
    for least in (1, 4, 50):
        same(op1_line_dedup.deduplicated(docs, least).toPandas(), duck(op1_line_dedup.oracle(least), documents=docs.toArrow()))


def test_sharding(docs, duck, same):
    for limit in (1 << 20, 500, 9, 1):
        same(op5_sharding.shards(docs, limit).toPandas(), duck(op5_sharding.oracle(limit), documents=docs.toArrow()))


def test_mixing(docs, duck, same):
    got = op8_mixing.mixed(docs)
    same(got.select("doc_id", "size", "source_size", "target", "taken").toPandas(), duck(op8_mixing.ORACLE, documents=docs.toArrow()))
    assert got.where("taken > 2 * size").count() == 0
    assert op8_mixing.mixture(docs).columns == docs.columns


def test_near_duplicates(docs, duck, same):
    known = docs.where("doc_id is not null")
    same(near_duplicates(known, 4).select("doc_id", "n_shingles", "component_id", "kept").toPandas(), duck(NEAR_ORACLE, documents=known.toArrow()))
    left = one_of_each(docs)
    # one of 1, 2, 3 (and 10, which holds the same run of words), one of the repeated row
    assert sorted(r[0] for r in left.select("doc_id").where("doc_id < 4").collect()) == [1] and left.where("doc_id = 9").count() == 1
    assert left.where("doc_id in (4, 5, 6)").count() == 3 and left.columns == docs.columns


def test_chain_of_near_copies(spark):
    """Links run along a chain whose ends are unlike; a hub alone would not find them."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 3, i * 3 + 60))) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_duplicates(d, 4).select("component_id").distinct().count() == 1


def test_contamination(spark, docs, duck, same):
    items = spark.createDataFrame([(1, "one TWO"), (2, "word10 word11 word12 word13 word14 word15 word16 word17 word18 word19 word20"), (3, None), (4, ""), (2, "tail")], "item_id bigint, text string")
    found = op7_decontamination.contamination(docs, items).drop("spans")
    same(found.toPandas(), duck(LEAKS_ORACLE, documents=docs.toArrow(), benchmark=items.toArrow()))
    clean = op7_decontamination.decontaminated(docs, items)
    assert clean.count() == docs.count() and op7_decontamination.contamination(clean, items).where("contaminated").count() == 0
    assert op7_decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_blocks_of_a_large_benchmark(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"word{i} word{i + 1} word{i + 2}") for i in range(20)], "item_id bigint, text string")
    whole = sorted(map(repr, op7_decontamination.contamination(docs, items).collect()))
    monkeypatch.setattr(op7_decontamination, "BLOCK_WORDS", 12)
    assert sorted(map(repr, op7_decontamination.contamination(docs, items).collect())) == whole


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (op1_line_dedup.deduplicated, op5_sharding.shards, op8_mixing.mixed, near_duplicates):
        assert f(none).count() == 0
