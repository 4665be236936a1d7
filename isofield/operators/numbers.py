"""Dense numbers of points and look-ups both ways, on a table that is stored in parts by ranges of numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import KEY
from ..functions.numbering import numbered
from ..functions.storage import shared_dir

#: Numbers of a part.
PART = 1 << 20


def number_points(points: DataFrame, part: int = PART) -> DataFrame:
    """``points`` (layer, x, y, z and more) with ``id``: dense numbers from 0 in the order of layer, x, y, z, and ``part``: the id divided by ``part``.

    Sorted by range over the cluster and stored as Parquet with a folder for each part; a look-up by number reads the folders that its numbers
    fall in and no others.
    """
    spark = points.sparkSession
    out = numbered(points, KEY, name="numbers").withColumnRenamed("before", "id").withColumn("part", F.expr(f"id div {part}"))
    path = f"{shared_dir(spark)}/by-number-{uuid.uuid4().hex}"
    # a part may be split over tasks, each of which sorts what it writes
    out.sortWithinPartitions("part", "id").write.partitionBy("part").parquet(path)
    schema = out.select(*[c for c in out.columns if c != "part"], "part").schema
    return spark.read.schema(schema).parquet(path)


def points_of(index: DataFrame, asks: DataFrame, part: int = PART) -> DataFrame:
    """``asks`` (id and more) with the columns of the point of that number in ``index`` (from ``number_points``), null where there is none.

    The join is by part and number, so a small ``asks`` makes Spark leave out the folders of all other parts as it reads.
    """
    own = asks.withColumn("__part", F.expr(f"id div {part}"))
    held = index.withColumnRenamed("part", "__part")
    return own.join(held, ["__part", "id"], "left").drop("__part")


def numbers_of(index: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks`` (layer, x, y, z and more) with the number of the point there, null where there is none."""
    return asks.join(index.select(*KEY, "id"), KEY, "left")
