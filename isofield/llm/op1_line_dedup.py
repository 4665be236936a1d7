"""Repeated runs of lines, by a suffix array over line ids that is built by distributed prefix doubling.

All documents, in the order of their ids, form one sequence of lines. Round k ranks the runs of 2**k lines: equal runs have equal
ranks, and ranks follow the lexicographic order of the runs. A run of twice the length is ranked by the pair of its halves, which is a
join on position and one aggregation. Runs that occur once leave at once, so every round holds only what still repeats.

An interval of suffixes whose common prefix is at least n lines long is the set of positions with equal ranks for n lines. A
position is a later copy if its shortest run of at least ``min_words`` words belongs to such an interval and isn't the interval's
first. Shortest runs that begin at a line leave the last lines of a maximal repeated run where those hold fewer words. With ``whole``, as the
registered query asks, shortest runs that end at a line count as well: every line of a maximal repeated
run of that many words or more is then in one of the two kinds, and their union is the union of all such runs, less their first
copies. The doubling stops at the longest shortest run (a few rounds), not at the longest repeat.

Plan at scale: texts are stored once and read twice; lines travel as a 16-byte hash and a position. Groups
of equal runs are aggregated, never gathered, and joins on a hot rank are plain joins that the adaptive planner can split.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pick, stored

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
CUT = T.StructType([T.StructField("n_removed", T.IntegerType()), T.StructField("text", T.StringType())])


def ranked(keyed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(pos, rank) of the rows of ``keyed`` whose keys occur more than once; rank: how many such rows have smaller keys."""
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    order = numbered(groups, keys, "n", name + "-keys").select(*keys, F.col("before").alias("__rank"))
    return stored(keyed.join(order, keys).select("pos", F.col("__rank").alias("rank")), name)


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """(pos, length) of the runs to delete. ``lines``: pos (global), length (lines of the shortest run from here with enough
    words; null if the document ends before), line (hash); optionally ``back``, the same for the shortest run that ends here."""
    runs = lines.where("length is not null").select("pos", "length")
    if "back" in lines.columns:
        ending = lines.where("back is not null").select((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("length"))
        runs = stored(runs.union(ending).distinct(), "runs")
    longest = runs.agg(F.max("length")).first()[0]
    rank = ranked(lines.select("pos", "line"), ["line"], "ranks-1")
    found, size = None, 1
    while longest is not None and size <= longest:
        # runs of size .. 2 * size - 1 lines are a run of ``size`` lines from either end
        own = runs.where((F.col("length") >= size) & (F.col("length") < 2 * size))
        first = own.join(rank, "pos").withColumn("tail", F.col("pos") + F.col("length") - size)
        both = first.join(rank.select(F.col("pos").alias("tail"), F.col("rank").alias("tail_rank")), "tail")
        both = both.select("pos", "length", "rank", "tail_rank")
        intervals = both.groupBy("length", "rank", "tail_rank").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
        later = both.join(intervals, ["length", "rank", "tail_rank"]).where("pos > first").select("pos", "length")
        found = later if found is None else found.union(later)
        size *= 2
        if size > longest:
            break
        halves = rank.join(rank.select((F.col("pos") - size // 2).alias("pos"), F.col("rank").alias("next")), "pos")
        rank = ranked(halves, ["rank", "next"], f"ranks-{size}")
        if not rank.take(1):
            break
    return found if found is not None else runs.where("false")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text (what is left, lines joined by line feeds).

    Lines are what lies between line feeds. A line is removed if it is part of a run of whole lines of one document, of ``min_words``
    words or more and (unless ``whole``) no longer than its first line needs, that also begins at an earlier place (order: doc_id, null last; then text hash; of equal rows any order; then line). So the first copy stays,
    and a line that repeats itself keeps its first occurrence. Runs don't pass a document's end. Null text: null text, no
    lines. Empty text: one empty line. Repeated rows are documents of their own: the later ones lose what they repeat.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "rows")
    split = F.split("text", "\n", -1)
    keys = rows.select("row", F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.size(split), F.lit(0)).alias("n_lines")).where("n_lines > 0")
    # one position more than lines, so that no run reaches into the next document
    placed = numbered(keys, ["none", "doc_id", "key", "row"], F.col("n_lines") + 1, "documents").select("row", F.col("before").alias("start"))
    lines = rows.where("text is not null").select("row", F.posexplode(split).alias("at", "line")).select("row", "at", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    lines = lines.join(placed, "row").select("row", (F.col("start") + F.col("at")).alias("pos"), "at", "line", "words")
    upto = F.sum("words").over(Window.partitionBy("row").orderBy("at"))
    lines = lines.withColumn("upto", upto).withColumn("goal", F.col("upto") - F.col("words") + min_words)
    lines = _with_length(lines)
    if whole:
        lines = _with_back(lines, min_words)
    lines = stored(lines.select("row", "pos", "at", "line", "length", *["back"] * whole), "lines")
    gone = stored(later_copies(lines, min_words), "later")
    # a document's spans are as many as its later starts; none is unrolled into its lines
    spans = gone.join(lines.select("pos", "row", "at"), "pos").select("row", F.struct(F.col("at").cast("bigint").alias("first"), (F.col("at") + F.col("length")).alias("end")).alias("span"))
    marks = spans.groupBy("row").agg(F.collect_list("span").alias("spans"))
    out = rows.join(marks, "row", "left")
    marked = F.col("spans").isNotNull()
    out = out.withColumn("cut", without_spans(F.when(marked, F.col("text")), "spans"))
    return out.select("doc_id", F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.when(marked, F.col("cut.n_removed")).otherwise(0).alias("n_removed"), F.when(marked, F.col("cut.text")).otherwise(F.col("text")).alias("text"))


@F.pandas_udf(CUT)
def without_spans(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Texts without the lines of their spans, which may overlap: one sort of the spans and one pass over the lines. Null spans: null."""
    removed, left = [], []
    for t, s in zip(text, spans, strict=True):
        if s is None:
            removed.append(None)
            left.append(None)
            continue
        own, kept, upto = t.split("\n"), [], 0
        for a, b in sorted((x["first"], x["end"]) for x in s):
            if a > upto:
                kept += own[upto:a]
            upto = max(upto, b)
        kept += own[upto:]
        removed.append(len(own) - len(kept))
        left.append("\n".join(kept))
    return pd.DataFrame({"n_removed": pd.array(removed, "Int32"), "text": pd.Series(left, dtype=object)})


def _with_length(lines: DataFrame) -> DataFrame:
    """length: lines from here up to the first at which ``upto`` reaches ``goal``; null if none does.

    Both rise along a document, so goals and sums are merged in one order: every goal looks for the next sum that is not smaller.
    """
    own = F.struct("upto", "goal").alias("own")
    goals = lines.select("row", F.col("goal").alias("v"), F.lit(0).alias("kind"), "at", "pos", "line", own)
    sums = lines.select("row", F.col("upto").alias("v"), F.lit(1).alias("kind"), "at", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("line"), own)
    ahead = Window.partitionBy("row").orderBy(F.col("v").desc(), F.col("kind").desc(), F.col("at").desc())
    nearest = F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return goals.union(sums).withColumn("end", nearest).where("kind = 0").withColumn("length", (F.col("end") - F.col("at") + 1).cast("bigint"))


def _with_back(lines: DataFrame, min_words: int) -> DataFrame:
    """back: lines from the last at which a run with ``min_words`` words that ends here can begin; null if none can. As ``_with_length``."""
    before = F.col("own.goal") - min_words
    sums = lines.select("row", before.alias("v"), F.lit(0).alias("kind"), "at", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("line"), F.lit(None).cast("bigint").alias("length"))
    ends = lines.select("row", (F.col("own.upto") - min_words).alias("v"), F.lit(1).alias("kind"), "at", "pos", "line", "length")
    behind = Window.partitionBy("row").orderBy("v", "kind", "at")
    nearest = F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sums.union(ends).withColumn("begin", nearest).where("kind = 1").withColumn("back", (F.col("at") - F.col("begin") + 1).cast("bigint"))


def oracle(min_words: int = MIN_WORDS) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS dn, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT dn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY dn ORDER BY i) AS upto FROM w),
e AS (SELECT a.dn, a.i, min(b.i) AS j FROM c a JOIN c b ON a.dn = b.dn AND b.i >= a.i AND b.upto - a.upto + a.words >= {min_words} GROUP BY a.dn, a.i),
r AS (SELECT e.dn, e.i, e.j, md5(array_to_string(list_slice(d.ls, e.i, e.j), chr(10))) AS run, e.j - e.i AS n FROM e JOIN d ON e.dn = d.dn),
f AS (SELECT *, row_number() OVER (PARTITION BY run, n ORDER BY dn, i) AS nth FROM r),
g AS (SELECT DISTINCT dn, unnest(range(i, j + 1)) AS i FROM f WHERE nth > 1),
k AS (SELECT l.dn, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
      FROM l LEFT JOIN g ON l.dn = g.dn AND l.i = g.i GROUP BY l.dn)
SELECT d.doc_id, coalesce(k.n_lines, 0)::INT AS n_lines, coalesce(k.n_removed, 0)::INT AS n_removed, k.text AS text
FROM d LEFT JOIN k ON d.dn = k.dn
"""


def whole_oracle(min_words: int = MIN_WORDS) -> str:
    """SQL for ``whole``: as ``oracle``, with the shortest runs that end at each line beside those that begin there."""
    shortest = f"b.i <= a.i AND a.upto - b.upto + b.words >= {min_words}"
    ending = f"back AS (SELECT a.dn, max(b.i) AS i, a.i AS j FROM c a JOIN c b ON a.dn = b.dn AND {shortest} GROUP BY a.dn, a.i),\neither AS (SELECT dn, i, j FROM e UNION SELECT dn, i, j FROM back),\nr AS ("
    return oracle(min_words).replace("\nr AS (", "\n" + ending).replace("FROM e JOIN d ON e.dn = d.dn", "FROM either e JOIN d ON e.dn = d.dn")
