"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time with skipping over long ones.

Documents are indexed in shards of bounded size, a shard a row of the index: for each term of the items the shard's documents that hold it and how
often. Counts over all shards (documents, terms, documents of a term) give the weights, and every shard is searched by itself
for its best documents of each item; the best of these are ranked by item.

In a shard, the short lists of an item are summed into accumulators first. These then count as one more list, beside the long ones,
and all are read by document in windows: each list has a bound for every window, a window whose bounds can't pass the worst of the best is
skipped, and in others only the lists that can lift a document past it name candidates, the others are looked up. All figures are whole numbers, so
skipping loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import numbered, pick, stored

BEST = 10
#: A shard ends at so many documents or postings; a text of its own may exceed the second, by its distinct item terms.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Documents of a window.
WINDOW = 512
#: A list is short that holds at most one of so many documents of the shard.
SHORT = 32
#: Bytes of item texts that one pass over the documents serves; more items take more passes.
BLOCK_BYTES = 8 << 20

_INDEX = pa.schema(
    [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("n_null", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int32())) for c in ("terms", "lengths", "docs", "tf")]
)
_INDEX_DDL = "n_docs long, n_terms long, n_null long, doc_ids array<long>, sizes array<long>, terms array<int>, lengths array<int>, docs array<int>, tf array<int>"


class Shard:
    """Documents gathered for one row of the index."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = self.held = self.postings = 0
        self.ids, self.sizes, self.parts = [], [], []

    def add(self, ids: list[int | None], texts: list[bytes], vocabulary: np.ndarray) -> None:
        """Texts that fit in one chunk; only documents that hold an item's term are kept by name."""
        word, bounds = wordhash.words(texts, wordhash.ALNUM)
        size = np.diff(bounds)
        self.n_docs += int((size > 0).sum())
        self.n_terms += int(size.sum())
        if not len(word) or not len(vocabulary):
            return
        at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[at] == word)
        doc = np.repeat(np.arange(len(texts)), size)[known]
        key, tf = np.unique(doc * len(vocabulary) + at[known], return_counts=True)
        doc, term = np.divmod(key, len(vocabulary))
        some, doc = np.unique(doc, return_inverse=True)
        self.ids += [ids[i] for i in some]
        self.sizes += size[some].tolist()
        self.parts.append((doc + self.held, term, tf))
        self.held += len(some)
        self.postings += len(tf)

    def row(self) -> pa.RecordBatch:
        """Documents by id (nulls last), postings by term and document."""
        none = np.array([i is None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, none))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term, tf = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(3))
        doc = place[doc] if len(doc) else doc
        by = np.lexsort((doc, term))
        terms, lengths = np.unique(term, return_counts=True)
        sizes = np.array(self.sizes, np.int64)[order]
        lists = [ids[order], sizes, *(x.astype(np.int32) for x in (terms, lengths, doc[by], tf[by]))]
        one = [pa.array([x], pa.int64()) for x in (self.n_docs, self.n_terms, int(none.sum()))]
        return pa.RecordBatch.from_arrays([*one, *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists)], schema=_INDEX)


def _indexer(vocabulary) -> Callable:
    """A function for mapInArrow over (doc_id, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = vocabulary.value, Shard()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, part in wordhash.chunks(batch.column(1).to_pylist()):
                shard.add(ids[first : first + len(part)], part, words)
                if shard.held >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield shard.row()
                    shard = Shard()
        if shard.n_docs:
            yield shard.row()

    return run


class Lists:
    """The lists of a shard with what each posting adds to a score (for one occurrence of its term in an item)."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int, short: int, window: int) -> None:
        self.ids, sizes, terms, lengths, self.docs, tf = (row[c] for c in ("doc_ids", "sizes", "terms", "lengths", "docs", "tf"))
        self.n_null, self.n, self.window = row["n_null"], len(self.ids), window
        tf = tf.astype(np.int64)
        m = 100 - 75 + (75 * sizes * n_docs) // n_terms
        self.gain = np.repeat(weights[terms], lengths) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs]))
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        self.place = np.full(len(weights), -1, np.int64)
        self.place[terms] = np.where(weights[terms] > 0, np.arange(len(terms)), -1)
        self.firsts = np.arange(0, self.n, window)
        # long lists: where each window starts in the list, and its greatest gain there
        long = np.flatnonzero(lengths > self.n // short)
        self.long = np.full(len(terms), -1, np.int64)
        self.long[long] = np.arange(len(long))
        self.cut = np.array([self.start[t] + np.searchsorted(self.docs[self.start[t] : self.end[t]], np.append(self.firsts, self.n)) for t in long], np.int64).reshape(len(long), len(self.firsts) + 1)
        self.most = np.zeros((len(long), len(self.firsts)), np.int64)
        for i in range(len(long)):
            some = np.flatnonzero(np.diff(self.cut[i]))
            if len(some):
                self.most[i, some] = np.maximum.reduceat(self.gain[: self.cut[i, -1]], self.cut[i, some])

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the ``k`` best of an item with ``terms``, each so many times; equal ones by document."""
        at = self.place[terms]
        at, times = at[at >= 0], times[at >= 0]
        top_doc, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(at):
            return top_doc, top
        row = self.long[at]
        summed = np.zeros(self.n, np.int64)
        for t, q in zip(at[row < 0].tolist(), times[row < 0].tolist(), strict=True):
            own = slice(self.start[t], self.end[t])
            summed[self.docs[own]] += q * self.gain[own]
        row, times = row[row >= 0], times[row >= 0]
        bounds = np.vstack([np.maximum.reduceat(summed, self.firsts)[None, :], times[:, None] * self.most[row]])
        # nothing of a score up to ``worst`` can still be among the best; accumulators are a first estimate from below
        reached = summed[summed > 0]
        worst = int(np.partition(reached, -k)[-k]) - 1 if len(reached) >= k else 0
        total = bounds.sum(axis=0)
        for w in np.flatnonzero(total > worst).tolist():
            if total[w] <= worst:
                continue
            low = w * self.window
            by = np.argsort(bounds[:, w], kind="stable")
            so_far = np.cumsum(bounds[by, w])
            cut = int(np.searchsorted(so_far, worst, side="right"))  # lists before it can't pass ``worst`` together
            score = np.zeros(min(self.window, self.n - low), np.int64)
            for i in by[cut:].tolist():
                if i == 0:
                    score += summed[low : low + len(score)]
                else:
                    own = slice(self.cut[row[i - 1], w], self.cut[row[i - 1], w + 1])
                    score[self.docs[own] - low] += times[i - 1] * self.gain[own]
            found = np.flatnonzero(score)
            for j in range(cut - 1, -1, -1):
                found = found[score[found] + so_far[j] > worst]
                i = int(by[j])
                if not len(found) or not bounds[i, w]:
                    break
                if i == 0:
                    score[found] += summed[low + found]
                    continue
                own = slice(self.cut[row[i - 1], w], self.cut[row[i - 1], w + 1])
                docs = self.docs[own]
                p = np.minimum(np.searchsorted(docs, low + found), len(docs) - 1)
                score[found] += np.where(docs[p] == low + found, times[i - 1] * self.gain[own][p], 0)
            found = found[score[found] > worst]
            if not len(found):
                continue
            top_doc, top = np.concatenate([top_doc, low + found]), np.concatenate([top, score[found]])
            order = np.lexsort((top_doc, -top))[:k]
            top_doc, top = top_doc[order], top[order]
            if len(top) == k:
                worst = max(worst, int(top[-1]))
        return top_doc, top


_BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searcher(sent, n_docs: int, n_terms: int, k: int) -> Callable:
    """A function for mapInArrow over rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: (v[i].as_py() if c == "n_null" else v[i].values.to_numpy(zero_copy_only=False)) for c, v in zip(batch.schema.names, batch.columns, strict=True)}
                lists = Lists(row, weights, n_docs, n_terms, SHORT, WINDOW)
                found = [(number, *lists.best(terms, times, k)) for number, terms, times in items]
                found = [f for f in found if len(f[1])]
                if not found:
                    continue
                docs = np.concatenate([f[1] for f in found])
                ids = pa.array(lists.ids[docs], pa.int64(), mask=docs >= lists.n - lists.n_null)
                number = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(np.concatenate([f[2] for f in found]))], schema=_BEST)

    return run


def _terms(texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The sorted hashes of all terms of item texts, and for each text its terms, as places there, and how often each occurs."""
    each = [np.unique(own, return_counts=True) for _, part in wordhash.chunks(texts) for own in _split(*wordhash.words(part, wordhash.ALNUM))]
    vocabulary = np.unique(np.concatenate([h for h, _ in each])) if each else np.zeros(0, np.uint64)
    return vocabulary, [(np.searchsorted(vocabulary, h), n.astype(np.int64)) for h, n in each]


def _split(word: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [word[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def search(docs: DataFrame, benchmark: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents of each row of ``benchmark``: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII digits, letters (A-Z as a-z) and anything beyond ASCII, told apart by 64-bit hashes. With N documents that have a
    term, L terms of all of them, df documents of a term: its weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document of n
    terms has m = 25 + 75nN div L, and a term that it holds tf times adds its weight times 10**9 tf div (1000 tf + 8m), as often
    as the item repeats it. Equal scores stand by doc_id, nulls last; a score of 0 is no find.

    Null texts have no terms; documents without terms count for nothing, items without terms find nothing. Every row is a document or an item of its own,
    repeated ids too (rows of one item_id each get ranks from 1). Texts are read whole. Other columns are ignored; an empty table on either side gives
    an empty result. Items are fetched in blocks of ``BLOCK_BYTES`` bytes and one item; each block takes a pass over the documents.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = numbered(pick(benchmark, item_id=kind, text="string"), ["item_id", "text"], F.octet_length(F.coalesce("text", F.lit(""))) + 1, "items").withColumnRenamed("before", "item")
    size = items.agg(F.max("item")).first()[0]
    texts = pick(docs, doc_id="bigint", text="binary")
    found = None
    for block in range(0 if size is None else size // BLOCK_BYTES + 1):
        own = [(r["item"], r["text"]) for r in items.where(F.expr(f"item div {BLOCK_BYTES} = {block}")).select("item", F.col("text").cast("binary").alias("text")).toLocalIterator()]
        vocabulary, terms = _terms([bytes(t) if t is not None else None for _, t in own])
        if not len(vocabulary):
            continue
        index = stored(texts.mapInArrow(_indexer(sc.broadcast(vocabulary)), _INDEX_DDL), "index")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            break
        # one row a term of the block
        held = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t")).groupBy("t.terms").agg(F.sum("t.lengths").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for r in held.select("terms", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w")).toLocalIterator():
            weights[r["terms"]] = r["w"]
        asked = [(item, *t) for (item, _), t in zip(own, terms, strict=True) if len(t[0])]
        shards = index.select("n_null", "doc_ids", "sizes", "terms", "lengths", "docs", "tf").where("size(doc_ids) > 0")
        # an index is small beside its texts and may lie in few files
        shards = shards.repartition(F.xxhash64("doc_ids", "docs"))
        best = shards.mapInArrow(_searcher(sc.broadcast((asked, weights)), n_docs, n_terms, k), "item long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
g AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT i, term, count(*)::BIGINT AS q FROM (SELECT i, unnest(w) AS term FROM b) GROUP BY i, term),
f AS (SELECT term, floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, g WHERE term IN (SELECT term FROM q) GROUP BY term, g.n),
s AS (SELECT q.i, d.doc_id, d.r, sum(q.q * f.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * len(d.w)::BIGINT * g.n) // g.l))))::BIGINT AS score
      FROM q JOIN f ON f.term = q.term JOIN t ON t.term = q.term JOIN d ON d.r = t.r, g GROUP BY q.i, d.r, d.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT b.item_id, k.rank::INT AS rank, k.doc_id, k.score FROM k JOIN b ON b.i = k.i WHERE k.rank <= 10
"""
