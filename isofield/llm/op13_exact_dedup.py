"""Exact dedup with a heavy-hitter split, in DataFrame code only.

Digests of normalised texts are stored once, without the texts. A frequent-items sketch of bounded size (Spark's ``approx_top_k`` functions
keep the mergeable form of Misra-Gries counters), merged in two levels, names the digests that may hold a large share of all rows. An
exact pass, aggregated before its shuffle, counts these few and finds their winners; the winners, at most ``FREQUENT`` rows, are broadcast, so copies of
frequent texts are told apart where they lie and never meet in one task. All other digests are shuffled as usual; a
group there holds at most about 7 / ``COUNTERS`` of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

#: Counters of a sketch. Every digest with more than 7 / COUNTERS of all rows is among the candidates (twice the sketch's error of 3.5 / COUNTERS).
COUNTERS = 1 << 14
#: Candidates at most; no more digests than COUNTERS / 7 can hold such a share.
FREQUENT = COUNTERS // 7
#: Sketches of tasks are merged in so many groups first.
MERGES = 256

#: White space that counts as one space: [\x20\x09-\x0D]+.
SPACE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the normalised text in UTF-8; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ").cast("binary"), 256)


def candidates(digests: DataFrame, counters: int = COUNTERS, frequent: int = FREQUENT) -> DataFrame:
    """(digest): at most ``frequent`` digests, every one with more than 7 / ``counters`` of the rows among them."""
    sketches = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("m")).agg(F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("s"))
    # grouped by a constant: no rows give no sketch
    one = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {counters}), {frequent})").alias("top"))
    # an estimate of 1 can't be a copy
    return one.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("digest"))


def winners(digests: DataFrame, found: DataFrame) -> DataFrame:
    """(digest, first, group_size) of the candidates ``found``, counted exactly over all of ``digests`` (digest, doc_id and, if there, row).

    first: the row that stays, least by doc_id (nulls last), then by row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *[c for c in digests.columns if c == "row"])
    own = digests.join(F.broadcast(found), "digest").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    return own.where("group_size > 1")


def copies(docs: DataFrame, counters: int = COUNTERS, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space is one space (identical SHA-256, that is). Null texts count
    as empty, and all empty ones are equal; a text of white space is one space and differs from them. The smallest doc_id stays; a null id stays only in a group without
    others, whose keep_id is null. Of rows that repeat text and id exactly one stays. Columns other than doc_id and text are
    ignored. An empty table gives an empty result.
    """
    own = pick(docs, doc_id="bigint", text="string")
    rows = stored(own.select("doc_id", digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = winners(rows, candidates(rows.select("digest"), counters, frequent))
    split = rows.join(F.broadcast(heavy), "digest", "left")
    frequent_rows = split.where("group_size is not null").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("doc_id").asc_nulls_last(), "row")
    rest = split.where("group_size is null").select("doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"), "digest")
    return frequent_rows.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, counters: int = COUNTERS, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``docs`` that stay by the rule of ``copies``, with all their columns, whatever their names.

    Copies of frequent texts are removed before the shuffle; the text of any other row crosses the network once. Of rows that repeat id and text, any one stays.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    rows = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), digest(F.col("`text`")).alias("digest"), held)
    digests = stored(rows.select("digest", "doc_id"), "digests")
    heavy = winners(digests, candidates(digests.select("digest"), counters, frequent))
    split = rows.join(F.broadcast(heavy), "digest", "left")
    frequent_rows = split.where("group_size is not null and doc_id <=> first.doc_id").groupBy("digest").agg(F.first("held").alias("held")).select("held")
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last())
    rest = split.where("group_size is null").withColumn("n", F.row_number().over(order)).where("n = 1").select("held")
    return frequent_rows.unionByName(rest).select("held.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""
