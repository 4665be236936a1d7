"""A level set from the lineitem table: stacked layers over a grid of columns, in whole thousandths of a cell.

Column x is a group of twenty parts, y a quantity; layers 0, 1, 2 are the return flags A, N, R; a layer's height is its mean
price on a fixed scale, and no layer lies below the one under it. phi = 1000 z - height, kept within 1500 of the surface.
The grid grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAND = 1500


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, x, y, h): the nested heights. One aggregation with partial sums; the window sees three rows a column."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    layer = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    g = li.groupBy(layer.alias("layer"), F.expr("cast(l_partkey div 20 as int)").alias("x"), F.col("l_quantity").cast("int").alias("y"))
    raw = g.agg(F.sum(cents).alias("s"), F.count("*").alias("n")).select("layer", "x", "y", F.expr("s div (n * 187)").alias("h"))
    below = Window.partitionBy("x", "y").orderBy("layer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn("h", F.max("h").over(below))


def band(surface: DataFrame, width: int = BAND) -> DataFrame:
    """The level set (layer, x, y, z, phi) of a height field up to ``width`` from it: three or four rows a column and layer unless told, made in place."""
    reach = width // 1000 + 1
    z = F.explode(F.expr(f"sequence(cast(h div 1000 as int) - {reach}, cast(h div 1000 as int) + {reach})"))
    out = surface.select("layer", "x", "y", z.alias("z"), "h")
    return out.select("layer", "x", "y", "z", (F.col("z").cast("bigint") * 1000 - F.col("h")).alias("phi")).where(F.abs("phi") <= width)


def level_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band(heights(spark, sf_dir))


#: The same in SQL, as common table expressions ``hf`` (heights) and ``ls`` (level set).
SQL = """raw AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS layer, (l_partkey // 20)::INT AS x, l_quantity::INT AS y,
               sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // (count(*) * 187) AS h FROM lineitem GROUP BY 1, 2, 3),
hf AS (SELECT layer, x, y, max(h) OVER (PARTITION BY x, y ORDER BY layer) AS h FROM raw),
ls AS (SELECT * FROM (SELECT layer, x, y, z::INT AS z, 1000 * z - h AS phi FROM (SELECT *, unnest(range(h // 1000 - 2, h // 1000 + 3)) AS z FROM hf)) WHERE abs(phi) <= 1500)"""


def carved(points: DataFrame, low: int = 10, high: int = 14) -> DataFrame:
    """The level set less a slab low < z < high at odd x: overhangs and closed cavities for visibility and connectivity."""
    from ..operators.algebra import combine

    columns = points.where("x % 2 = 1").select("layer", "x", "y").distinct()
    z = F.explode(F.sequence(F.lit(low - 1), F.lit(high + 1)))
    slab = columns.select("layer", "x", "y", z.alias("z"))
    phi = F.greatest(low * 1000 - F.col("z") * 1000, F.col("z") * 1000 - high * 1000).cast("bigint")
    return combine(points, slab.select("layer", "x", "y", "z", phi.alias("phi")).where(F.abs("phi") <= BAND), "difference")


def flat_level_set(spark: SparkSession, sf_dir: str, by: int = 50) -> DataFrame:
    """The level set of heights divided by ``by``: neighbouring columns differ by less than the band, so most points have neighbours along x and y."""
    return band(heights(spark, sf_dir).withColumn("h", F.expr(f"h div {int(by)}")))


def low_level_set(spark: SparkSession, sf_dir: str, by: int = 10, width: int = 8000) -> DataFrame:
    """The level set of heights divided by ``by``, with a band wider than any difference of heights: corners of cells at the surface are all held."""
    return band(heights(spark, sf_dir).withColumn("h", F.expr(f"h div {int(by)}")), width)


#: The same in SQL, after ``SQL``: a further common table expression ``fl``.
FLAT_SQL = """ff AS (SELECT layer, x, y, h // 50 AS h FROM hf),
fl AS MATERIALIZED (SELECT * FROM (SELECT layer, x, y, z::INT AS z, 1000 * z - h AS phi FROM (SELECT *, unnest(range(h // 1000 - 2, h // 1000 + 3)) AS z FROM ff)) WHERE abs(phi) <= 1500)"""
