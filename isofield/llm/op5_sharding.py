"""Shards by extendible hashing, in DataFrame code only.

The directory is indexed by the leading bits of a 60-bit hash. A bucket over the byte limit splits on its next bit, and only
such a bucket does; its halves are looked at again, until every shard fits. Rows are summed once by a
prefix somewhat longer than needed on average; the bucket of a prefix is its shortest beginning whose sum fits. Only what
is still too large there is summed again, by twelve more bits. Equal rows hash alike: a bucket of
one hash is cut into pieces of as many rows as fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

LIMIT = 32 << 20
BITS, STEP = 60, 12


def shard_hash(doc_id: Column, text: Column) -> Column:
    """60 bits from md5 of the id and md5 of the text; equal rows have equal hashes."""
    key = F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _leaves(sums: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth) from (cell, bytes) by ``high`` bits: the least depth from ``low`` to ``high`` that fits; null if none."""
    grown = sums.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = grown.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    fits = fits.where(F.col("bytes") <= limit).select("depth", "prefix")
    found = grown.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return sums.select("cell").join(found, "cell", "left")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, shard (the bits of its bucket, with a piece number for buckets of one hash), depth,
    shard_bytes, shard_rows, oversize (true only where one row alone exceeds ``limit``).

    n_bytes: UTF-8 bytes of the text (null: 0). Null ids hash by their text. Repeated rows are told apart only by
    piece. Other columns are ignored. An empty table gives an empty result.
    """
    out = _assigned(_sized(docs), limit)
    sums = out.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return out.join(sums, "shard").select("doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", ((F.col("n_bytes") > limit) & (F.col("shard_rows") == 1)).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """``docs`` as Parquet, a folder for each shard: shard=b and its bits, a dash in place of the slash before a piece number. A shard is
    one task and one file, its rows in the order of their ids.

    All columns of a row, whatever their names, are in the struct ``row``; rows come back as often as they came. An empty table writes no shard.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _assigned(_sized(docs, row), limit).select(F.concat(F.lit("b"), F.translate("shard", "/", "-")).alias("shard"), "doc_id", "row")
    out.repartition("shard").sortWithinPartitions("shard", "doc_id").select("shard", "row").write.partitionBy("shard").parquet(path)


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_bytes, h (hash), part (where a row is stored) and ``more`` columns, stored."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    text = F.col("text")
    rows = own.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), shard_hash(F.col("doc_id"), text).alias("h"), *own.columns[2:])
    return stored(rows.withColumn("part", F.spark_partition_id()), "sized")


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    """The columns of ``_sized`` but h and part, with shard and depth."""
    if limit < 1:
        raise ValueError("limit must be positive")
    held = [c for c in rows.columns if c not in ("h", "part")]
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    high = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 5)
    low, open_, done = 0, rows, []
    while True:
        cell = F.shiftright("h", BITS - high)
        leaves = stored(_leaves(open_.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes")), low, high, limit), "directory")
        placed = open_.withColumn("cell", cell).join(leaves, "cell")
        name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(shiftright(cell, {high} - depth)), depth, '0')"))
        done.append(placed.where("depth is not null").select(*held, name.alias("shard"), "depth"))
        if not leaves.where("depth is null").take(1):
            break
        open_ = stored(placed.where("depth is null").select(*rows.columns), "open")
        if high == BITS:
            # rows of one hash: number them, first within each stored part, then from part to part
            counts = open_.groupBy("h", "part").agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.partitionBy("h").orderBy("part")) - F.col("n")
            own = F.row_number().over(Window.partitionBy("h", "part").orderBy(F.lit(0))) - 1
            number = open_.withColumn("own", own).join(counts.select("h", "part", before.alias("before")), ["h", "part"])
            piece = F.expr(f"(own + before) div greatest({limit} div n_bytes, 1)")
            done.append(number.select(*held, F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lit("/"), piece.cast("string")).alias("shard"), F.lit(BITS).alias("depth")))
            break
        low, high = high + 1, min(BITS, high + STEP)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def oracle(limit: int = LIMIT) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
u AS (SELECT h, sum(n_bytes) AS bytes FROM d GROUP BY h),
g AS (SELECT h, bytes, unnest(range(0, 61)) AS depth FROM u),
s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS bytes FROM g GROUP BY 1, 2),
l AS (SELECT g.h, min(g.depth) FILTER (s.bytes <= {limit}) AS depth FROM g JOIN s ON g.depth = s.depth AND g.h >> (60 - g.depth) = s.prefix GROUP BY g.h),
n AS (SELECT d.*, coalesce(l.depth, 60)::INT AS depth,
        CASE WHEN l.depth IS NULL
          THEN (row_number() OVER (PARTITION BY d.h) - 1) // greatest({limit} // greatest(d.n_bytes, 1), 1) END AS piece
      FROM d JOIN l ON d.h = l.h),
b AS (SELECT doc_id, n_bytes, depth,
        CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END || coalesce('/' || piece::VARCHAR, '') AS shard
      FROM n)
SELECT doc_id, n_bytes, shard, depth, (sum(n_bytes) OVER w)::BIGINT AS shard_bytes, (count(*) OVER w)::BIGINT AS shard_rows,
       n_bytes > {limit} AND count(*) OVER w = 1 AS oversize
FROM b WINDOW w AS (PARTITION BY shard)
"""
