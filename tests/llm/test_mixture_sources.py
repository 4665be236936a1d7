"""Equal rows in two sources."""

from pyspark.sql import functions as F

from isofield.llm.op8_mixing import mixed, mixture


def test_each_source_gets_its_own_share(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text + f" {i}", s) for i in range(6) for s in ("a", "b", None)] + [(100 + i, text + f" {i}", "b") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    asked = {r["source"]: r["n"] for r in mixed(d).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    words = {r["source"]: r["n"] for r in mixture(d).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[^ ]+"))).alias("n")).collect()}
    assert words == {k: v for k, v in asked.items() if v}
