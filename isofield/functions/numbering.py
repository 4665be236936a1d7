"""Running sums and row numbers over a whole table, without a task that sees it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def numbered(df: DataFrame, order: list[str], weight: str | Column | int = 1, name: str = "numbered") -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` (whole numbers; 1 gives row numbers from 0) over all earlier rows; ties stand in any order.

    Rows are dealt by range, summed within each part, and parts get their offsets from a table of one row a part.
    """
    w = F.lit(weight) if isinstance(weight, int) else F.col(weight) if isinstance(weight, str) else weight
    ranged = df.withColumn("__w", w.cast("bigint")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), name)
    parts = rows.groupBy("__part").agg(F.sum("__w").alias("__sum"))
    offsets = parts.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__offset"))
    inner = F.sum("__w").over(Window.partitionBy("__part").orderBy("__at")) - F.col("__w")
    out = rows.withColumn("__inner", inner).join(F.broadcast(offsets), "__part").withColumn("before", F.col("__offset") + F.col("__inner"))
    return out.drop("__w", "__part", "__at", "__inner", "__offset")
