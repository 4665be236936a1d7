"""As-of merges by ranges: each row meets the last point at or before it and the first one behind it, in tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def as_of(rows: DataFrame, at: Column, points: DataFrame, key: str) -> DataFrame:
    """``rows``, all columns (none of them called below or above), with ``below`` and ``above``: structs of the columns of ``points``, the last one with ``key`` <= ``at`` and the first one with ``key`` > ``at``.

    Either is null where there is no such point, and both are where ``at`` is null. Points with a null key are left out; of equal keys the
    greatest point counts. Rows and points are dealt by range in one order (many rows of one value go to several parts) and stored once; each part's first
    and last point are carried over its borders, as one row a part. Nothing is collected.
    """
    known = points.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*points.columns)).alias("point")).select(F.col(key).cast("double").alias("at"), "point")
    kind = known.schema["point"].dataType
    asks = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), at.cast("double").alias("at"))
    both = asks.select("row", "at", F.lit(None).cast(kind).alias("point")).unionByName(known.select(F.lit(None).cast(asks.schema["row"].dataType).alias("row"), "at", "point"))
    order = ["at", "asks", "salt"]
    both = both.withColumn("asks", F.col("point").isNull()).withColumn("salt", F.monotonically_increasing_id())
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    held = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "as-of")
    known_at = F.when(F.col("point").isNotNull(), F.col("place"))
    ends = held.groupBy("part").agg(F.max_by("point", known_at).alias("last"), F.min_by("point", known_at).alias("first"))
    parts = Window.orderBy("part")
    carried = ends.select("part", F.last("last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", ignorenulls=True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    # both ways as running values: a frame that ends at the part's end would be gone through anew for each row
    own, back = Window.partitionBy("part").orderBy("place"), Window.partitionBy("part").orderBy(F.desc("place"))
    met = held.withColumn("below", F.last("point", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("above", F.last("point", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    # one row a part
    out = met.where("asks").join(F.broadcast(carried), "part", "left").withColumn("below", F.coalesce("below", "before")).withColumn("above", F.when(F.col("at").isNotNull(), F.coalesce("above", "after")))
    return out.select("row.*", "below", "above")


def interpolate(rows: DataFrame, at: Column, table: DataFrame, to: str, x: str = "x", y: str = "y") -> DataFrame:
    """``rows`` with ``to``: the value at ``at`` of the piecewise-linear curve through ``table`` (``x``, ``y``), held at its ends; null for a null or an empty table.

    Entries with a null are left out; of equal x the greatest y counts. The table may have any size.
    """
    points = table.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("held"), at.cast("double").alias("at"))
    met = as_of(packed, F.col("at"), points, "x")
    low, high = F.col("below"), F.col("above")
    slope = (high["y"] - low["y"]) / (high["x"] - low["x"])
    value = F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(low["y"] + (F.col("at") - low["x"]) * slope)
    return met.select("held", value.alias("value")).select("held.*", F.col("value").alias(to))
