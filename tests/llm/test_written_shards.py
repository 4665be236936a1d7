"""Shards on disk: what is written is what came, and doesn't depend on how it came."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isofield.llm import op5_sharding, op9_training_order as order
from isofield.llm.common import table


def test_extendible_shards(spark, docs, tmp_path):
    d = docs.withColumns({"shard": F.lit("x"), "row": F.col("doc_id"), "h": F.lit(1)})
    op5_sharding.write_shards(d, str(tmp_path / "s"), 500)
    back = spark.read.parquet(str(tmp_path / "s"))
    rows = lambda f: sorted(map(repr, f.collect()))
    assert rows(back.select("row.*")) == rows(d)
    told = {r["shard"].replace("/", "-"): r["n"] for r in op5_sharding.shards(docs, 500).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert {r["shard"][1:]: r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == told and len(told) > 3
    files = back.select("shard", F.input_file_name().alias("f")).distinct().groupBy("shard").count()
    assert files.where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_splits_against_sql(spark, duck, same, name):
    sf = f"/root/testdata/{name}"
    same(op5_sharding.shards(table(spark, sf, "documents"), 1 << 14).toPandas(), duck(op5_sharding.oracle(1 << 14), sf))


def slow(docs, length, shard):
    """slot: (ids, documents) by one list over all documents in order."""
    enc = order.Tokeniser(order.read_ranks(order.VOCABULARY))
    stream = []
    rows = sorted(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["k"]))
    for r in rows:
        stream += [(t, r["doc_id"]) for t in [*enc.ids(r["text"] or ""), order.END]]
    total = -(-len(stream) // length)
    slots = order.feistel(np.arange(total), total).tolist()
    out = {}
    for i, slot in enumerate(slots):
        part = stream[i * length : (i + 1) * length]
        own = [d for j, (t, d) in enumerate(part) if j == 0 or part[j - 1][0] == order.END]
        out[slot] = ([t for t, _ in part] + [order.END] * (length - len(part)), len(part), own)
    return out


def test_order_against_one_list(spark, docs):
    got = order.training_order(docs, length=64, shard=4).collect()
    want = slow(docs, 64, 4)
    assert {r["slot"]: (np.frombuffer(r["tokens"], "<u2").tolist(), r["n_tokens"], r["doc_ids"]) for r in got} == want and len(got) == len(want)
    assert all(r["shard"] == r["slot"] // 4 and r["place"] == r["slot"] % 4 for r in got)


def test_bytes_do_not_depend_on_splits(spark, docs, tmp_path):
    found = []
    for i, d in enumerate((docs, docs.repartition(5, F.col("text")), docs.coalesce(1))):
        order.shards(d, length=32, shard=8).write.parquet(str(tmp_path / str(i)))
        found.append(sorted((r["shard"], r["first_slot"], bytes(r["records"])) for r in spark.read.parquet(str(tmp_path / str(i))).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 2
    got = order.read_from(spark, str(tmp_path / "0"), 5, 20, 32, 8).collect()
    assert [r["slot"] for r in got] == list(range(5, 25)) and {len(r["tokens"]) for r in got} == {64}


def test_empty(spark, docs, tmp_path):
    assert order.training_order(docs.limit(0)).count() == 0 and order.sequences(docs.limit(0)).count() == 0
    op5_sharding.write_shards(docs.limit(0), str(tmp_path / "none"))
