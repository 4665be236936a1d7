"""Numbers of points both ways; only the parts that a look-up needs are read."""

from pyspark.sql import functions as F

from isofield.operators.numbers import number_points, numbers_of, points_of


def test_both_ways_and_pruning(spark):
    points = spark.range(5000).select(F.lit(0).alias("layer"), (F.col("id") % 7).cast("int").alias("x"), (F.col("id") * 31 % 101).cast("int").alias("y"), F.col("id").cast("int").alias("z"), F.lit(1.5).alias("phi")).repartition(6)
    index = number_points(points, 500)
    rows = sorted(tuple(r[:4]) for r in points.collect())
    assert [tuple(r[:4]) for r in index.orderBy("id").collect()] == rows and index.where("part <> id div 500").count() == 0
    asks = spark.createDataFrame([(3, "a"), (4, "b"), (4999, "c"), (5000, "d"), (3, "e"), (None, "f")], "id bigint, name string")
    found = points_of(index, asks, 500)
    assert {r["name"]: r["z"] for r in found.collect()} == {"a": rows[3][3], "b": rows[4][3], "c": rows[4999][3], "d": None, "e": rows[3][3], "f": None}
    inner = points_of(index, asks.where("id < 5"), 500)
    inner.collect()
    plan = inner._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "id div 500" in plan
    back = numbers_of(index, points.select("layer", "x", "y", "z").unionByName(spark.createDataFrame([(9, 9, 9, 9)], "layer int, x int, y int, z int")))
    assert {tuple(r[:4]): r["id"] for r in back.collect()} == {**{r: i for i, r in enumerate(rows)}, (9, 9, 9, 9): None}
    assert number_points(points.limit(0), 10).count() == 0
