"""Mixing sources to target weights by hash thresholds.

Every row has a 60-bit hash of its id and text. Words are summed by source and the first twelve bits; the one bucket of a
source in which its budget ends is summed again by the next twelve bits, and so on; the threshold that results is nested: a
larger budget takes every row that a smaller one takes. Rows are then filtered by their hash alone; nothing is sorted.
Shuffles carry one row for each task, source and bucket. Thresholds are stored, one row a source, so the planner broadcasts them where
their size allows it and joins by source otherwise. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, pick, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order (null last), over and over.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BITS, STEP = 60, 12


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits from md5 of the id and md5 of the text; equal rows have equal hashes."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight; what exceeds ``most`` sizes of a source is
    dealt again among the others until none is above.

    With sources in order of most * size / weight, the level at which water stands is (rest of the budget) / (weights
    of the sources not full); the first source that this level doesn't fill fixes it. One row a source; ranks and sums in order are
    taken by ranges, so sources may be many.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    s = numbered(s, ["none", "source"], F.lit(1), "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("w")).drop("before")
    order = ["ratio", "none", "source"]
    s = numbered(s, order, "cap", "caps").withColumnRenamed("before", "filled")
    s = stored(numbered(s, order, "w", "weights"), "levels")
    total, every = s.agg(F.sum("source_size").cast("double") * share, F.sum("w")).first()
    level = (F.lit(total) - F.col("filled").cast("double")) / (F.lit(every) - F.col("before")).cast("double")
    s = s.withColumn("level", level)
    found = s.agg(F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("ratio", "level"))).alias("x")).first()["x"]
    cap = F.col("cap").cast("double")
    return s.select("source", "source_size", (F.least(F.lit(found["level"]) * F.col("w"), cap) if found else cap).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, threshold columns and mix_key (the hash).

    size: words of the text (null: 0). A source's whole passes are given to every row, the rest to rows with hashes below its
    threshold; rows with the threshold's own hash share what is left in proportion to their sizes. So a source's sum misses
    its target by less than one word for each such row plus one. Repeated rows have equal hashes and fare alike; null ids, null sources
    and empty texts are ordinary values; other columns are ignored; an empty table gives an empty result.
    """
    raw = F.col("text")
    sized = pick(docs, doc_id="bigint", text="string", source="string").select("doc_id", "source", F.coalesce(F.regexp_count(raw, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), mix_hash(F.col("doc_id"), raw).alias("mix_key"))
    sized = stored(sized, "sized")
    goal = stored(targets(sized, weights, share, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = goal.withColumn("passes", passes)
    state = state.withColumn("rest", F.floor(F.col("target") - (F.col("passes") * F.col("source_size")).cast("double")).cast("bigint"))
    state = state.withColumn("rest", F.greatest("rest", F.lit(0))).withColumn("prefix", F.lit(0).cast("bigint")).withColumn("unit", F.lit(0).cast("bigint"))
    for bits in range(STEP, BITS + 1, STEP):
        inside = sized.alias("d").join(state.where("rest > 0").select(F.col("source").alias("s"), "prefix").alias("t"), F.expr(f"d.source <=> t.s and shiftright(d.mix_key, {BITS - bits + STEP}) = t.prefix"))
        cells = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("d.mix_key", BITS - bits).alias("cell")).agg(F.sum("d.size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        cells = cells.withColumn("below", upto - F.col("words"))
        now = state.alias("t").join(cells.alias("c"), F.expr("t.source <=> c.source and t.rest > 0 and c.below <= t.rest and t.rest < c.below + c.words"), "left")
        state = now.select(*[F.col(f"t.{c}").alias(c) for c in ("source", "source_size", "target", "passes")], (F.col("t.rest") - F.coalesce("c.below", F.lit(0))).alias("rest"), F.coalesce(F.col("c.cell"), F.shiftleft(F.col("t.prefix"), STEP)).alias("prefix"), F.coalesce(F.col("c.words"), F.lit(0)).cast("bigint").alias("unit"))
        state = stored(state, "thresholds")
    out = sized.alias("d").join(state.alias("t"), F.expr("d.source <=> t.source"))
    part = F.when(F.col("mix_key") < F.col("prefix"), F.col("size")).when((F.col("mix_key") == F.col("prefix")) & (F.col("unit") > 0), F.expr("cast(cast(rest as decimal(38,0)) * size div unit as bigint)")).otherwise(0)
    return out.select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", (F.col("passes") * F.col("size") + part).cast("bigint").alias("taken"), "d.mix_key")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2 AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM n),
f AS (SELECT *, (sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE AS filled,
             (sum(w) OVER () - sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) + w)::DOUBLE AS open_w FROM r),
v AS (SELECT (total - filled) / open_w AS level FROM f WHERE (total - filled) / open_w * w <= cap ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((SELECT level FROM v) * w, cap::DOUBLE), cap::DOUBLE) AS target FROM n),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
q AS (SELECT *, greatest(floor(target - (passes * source_size)::DOUBLE)::BIGINT, 0) AS rest FROM p),
u AS (SELECT source, h, sum(size)::BIGINT AS unit FROM d GROUP BY source, h),
c AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - unit AS below FROM u)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (q.passes * d.size + CASE WHEN c.below + c.unit <= q.rest THEN d.size
                                 WHEN c.below < q.rest AND c.unit > 0 THEN ((q.rest - c.below)::HUGEINT * d.size) // c.unit
                                 ELSE 0 END)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""


def mixture(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it: whole copies, and a last copy of the first words that are left.

    Equal rows of two sources are taken as each source asks. Copies keep the doc_id. A row of which nothing is taken is left out, as the weights ask; a row without words
    stays once. A column n_chars is set anew where a text was cut. Columns may have any names.
    """
    took = mixed(docs).groupBy("doc_id", "source", "mix_key").agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), mix_hash(F.col("doc_id"), F.col("text")).alias("mix_key"))
    out = own.alias("d").join(took.alias("t"), F.expr("d.doc_id <=> t.doc_id and d.source <=> t.source and d.mix_key = t.mix_key")).select("d.row", "t.size", "t.taken")
    left = F.when(F.col("size") > 0, F.expr("taken % nullif(size, 0)")).otherwise(0)
    whole = F.when(F.col("size") > 0, F.expr("taken div nullif(size, 0)")).otherwise(1)
    # one entry a copy: its number of words, -1 for all; at most three
    plan = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), whole.cast("int")), F.when(left > 0, F.array(left.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    out = out.select("row", F.explode(plan).alias("words"))
    cut, text = F.col("words") >= 0, F.col("row.text")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), 1, F.when(cut, F.col("words")).otherwise(0).cast("int")), "")
    out = out.select("row", "words", F.when(cut, first).otherwise(text).alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")
