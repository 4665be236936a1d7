"""Benchmark passages in documents, found with an FM-index of every shard of the corpus.

A shard is what one task holds of an Arrow batch. Its text is the sequence of its words over the benchmark's vocabulary; a word outside
that vocabulary can be in no match, so it only separates, and so do stretches that are shorter than the shortest window.
Over that sequence stand a suffix array, the Burrows-Wheeler transform in a wavelet matrix, and every eighth
suffix position. All windows go through backward search together; occurrences are located by walking to a sampled
suffix; their spans are merged per document.

Plan: windows are made by tasks and aggregated, so that each travels once with its items. They go to the tasks in blocks of about
``BLOCK_WORDS`` words, of which the driver holds one. One pass over the documents, no shuffle; if there are more blocks than one, each takes
a pass of its own over a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces, stored
from .wordhash import ALNUM, U, chunks, located, words

WINDOW = 10
#: Words in the windows that are sent to the tasks at once (8 bytes each).
BLOCK_WORDS = 10_000_000
SAMPLED = 8


@dataclass
class Windows:
    """Distinct windows of some items as rows of symbols; ``owners``: the items of each."""

    vocabulary: np.ndarray  # sorted word hashes; symbol i + 2 is the word vocabulary[i]
    groups: list[tuple[np.ndarray, list[tuple[str, ...]]]]  # windows of one length each

    @property
    def shortest(self) -> int:
        return min((len(w[0]) for w, _ in self.groups), default=1)


def window_table(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, owners): distinct windows of ``width`` consecutive words of an item (of a shorter one the whole, of an empty one none) as eight bytes a
    word, and the items that hold each; an item without an id marks words but owns nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words([text], ALNUM)[0]
                n = min(width, len(w))
                for at in range(0, len(w) - n + 1 if n else 0, 10_000):
                    keys = [w[i : i + n].tobytes() for i in range(at, min(at + 10_000, len(w) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([name] * len(keys), pa.string())], ["window", "item"])

    items = pick(benchmark, item_id="string", text="binary").where("text is not null")
    return items.mapInArrow(run, "window binary, item string").groupBy("window").agg(F.collect_set("item").alias("owners"))


def windows_of(owners: dict[bytes, list[str]]) -> Windows:
    """``Windows`` of window keys and the items of each."""
    rows: dict[int, list[bytes]] = {}
    for key in owners:
        rows.setdefault(len(key) // 8, []).append(key)
    vocabulary = np.unique(np.concatenate([np.frombuffer(k, U) for k in owners])) if owners else np.zeros(0, U)
    groups = [(np.searchsorted(vocabulary, np.frombuffer(b"".join(keys), U)).reshape(-1, n) + 2, [tuple(owners[k]) for k in keys]) for n, keys in sorted(rows.items())]
    return Windows(vocabulary, groups)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling the length that is sorted."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Backward search over a sequence of symbols from 1 on; symbol 0 ends it."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0)
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.bwt = bwt
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])  # symbols smaller than c
        self.levels = []  # from the highest bit: zeros, ones before each place
        row = bwt
        for bit in range(int(text.max()).bit_length() - 1, -1, -1):
            one = (row >> bit) & 1
            ones = np.concatenate([[0], np.cumsum(one)])
            self.levels.append((bit, len(row) - ones[-1], ones))
            row = np.concatenate([row[one == 0], row[one == 1]])
        marked = sa % SAMPLED == 0
        self.marked, self.mark_rank = marked, np.cumsum(marked) - 1
        self.samples = sa[marked]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before row i of the transform."""
        start = np.zeros_like(i)
        for bit, zeros, ones in self.levels:
            up = ((c >> bit) & 1) == 1
            start = np.where(up, zeros + ones[start], start - ones[start])
            i = np.where(up, zeros + ones[i], i - ones[i])
        return i - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the suffixes that begin with each pattern (rows of equal length)."""
        m = len(patterns)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for column in patterns.T[::-1]:
            c = column[live]
            known = c < len(self.before) - 1
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live], high[live] = self.before[c] + self.rank(c, low[live]), self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by stepping back to a sampled one."""
        rows = rows.copy()
        out = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        steps = 0
        while len(open_):
            r = rows[open_]
            there = self.marked[r]
            out[open_[there]] = self.samples[self.mark_rank[r[there]]] + steps
            open_, r = open_[~there], r[~there]
            c = self.bwt[r]
            rows[open_] = self.before[c] + self.rank(c, r)
            steps += 1
        return out


def scan(texts: list[bytes | None], told: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list[tuple[int, int]]], list[set[str]]]:
    """For every text: number of words, merged spans of hit words, the same spans in bytes, items with a window in it."""
    n_words, base = [], 0
    runs, where, sizes, starts, ends = [], [], [], [], []
    for _, part in chunks(texts):
        w, at, first, end = located(part, ALNUM)
        n_words += np.diff(at).tolist()
        starts.append(first)
        ends.append(end)
        sizes.append(len(w))
        if not told.groups:
            base += len(w)
            continue
        symbol = np.searchsorted(told.vocabulary, w)
        symbol[symbol == len(told.vocabulary)] = 0
        inside = told.vocabulary[symbol] == w
        # stretches of known words within one text, long enough for a window
        owner = np.repeat(np.arange(len(part)), np.diff(at))
        cut = np.flatnonzero(np.diff(inside) | (np.diff(owner) != 0)) + 1 if len(w) else np.zeros(0, np.int64)
        a, b = np.concatenate([[0], cut]), np.append(cut, len(w))
        good = (b - a >= told.shortest) & inside[np.minimum(a, len(w) - 1)] if len(w) else np.zeros(1, bool)
        for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
            runs += [symbol[x:y] + 2, [1]]
            where += [np.arange(base + x, base + y), [-1]]
        base += len(w)
    bounds = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    in_bytes: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not runs:
        return n_words, spans, in_bytes, items
    index, origin = FMIndex(np.concatenate(runs).astype(np.int64)), np.concatenate(where).astype(np.int64)
    cover = np.zeros(base + 1, np.int64)
    for patterns, owners in told.groups:
        low, high = index.search(patterns)
        n = high - low
        if not n.sum():
            continue
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = origin[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + patterns.shape[1], -1)
        text = np.searchsorted(bounds, at, side="right") - 1
        for t, p in set(zip(text.tolist(), which.tolist(), strict=True)):
            items[t].update(owners[p])
    hit = np.concatenate([[0], np.cumsum(cover)[:-1] > 0, [0]]).astype(np.int8)
    step = np.diff(hit)
    first_byte, end_byte = np.concatenate(starts), np.concatenate(ends)
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        t = int(np.searchsorted(bounds, a, side="right") - 1)
        while a < b:  # a span may run on into the next text
            stop = min(b, int(bounds[t + 1]))
            if a < stop:
                spans[t].append((a - int(bounds[t]), stop - int(bounds[t])))
                in_bytes[t].append((int(first_byte[a]), int(end_byte[stop - 1])))
            a, t = max(a, stop), t + 1
    return n_words, spans, in_bytes, items


def _blocks(benchmark: DataFrame, width: int) -> tuple[int, Callable[[int], Windows]]:
    """How many blocks of windows there are (one at least), and a function that fetches one."""
    found = stored(window_table(benchmark, width), "windows")
    size = found.agg(F.sum(F.octet_length("window")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // (8 * BLOCK_WORDS)))

    def block(i: int) -> Windows:
        own = found.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i)
        return windows_of({bytes(r["window"]): r["owners"] for r in own.toLocalIterator()})

    return n, block


_SPAN = "array<struct<first: bigint, end: bigint>>"
_FOUND = f"n_words bigint, spans {_SPAN}, bytes {_SPAN}, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "end": b} for a, b in out]


def passages(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(row, text, found): ``row`` holds all columns of ``docs``; ``text`` its text as bytes; ``found`` n_words, spans and bytes (merged; in words and in
    bytes of the text) and items."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("binary").alias("text"), F.lit(None).cast(f"struct<{_FOUND}>").alias("found"))
    schema = rows.schema
    n, block = _blocks(benchmark, width)
    for i in range(n):
        sent = docs.sparkSession.sparkContext.broadcast(block(i))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            told = sent.value
            for b in batches:
                texts, old = b.column(1).to_pylist(), b.column(2).to_pylist()
                n, spans, in_bytes, items = scan(texts, told)
                found = []
                for i, was in enumerate(old):
                    known = [[(x["first"], x["end"]) for x in was[k]] if was else [] for k in ("spans", "bytes")]
                    found.append({"n_words": n[i], "spans": _merged(known[0] + spans[i]), "bytes": _merged(known[1] + in_bytes[i]), "items": sorted({*(was["items"] if was else ()), *items[i]})})
                kind = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("bytes", _SPANS), ("items", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], ["row", "text", "found"])

        rows = rows.mapInArrow(run, schema)
        if i + 1 < n:
            rows = stored(rows, "passages")
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged, in words).

    Words: runs of ASCII digits, letters (A-Z as a-z) and anything beyond ASCII. A window is ``width`` consecutive words of an item, or all
    of a shorter one; a word within an occurrence is hit. Null and empty texts have no words; items without words have no
    windows; an item without id marks words but is not listed; rows of one item_id count as one item. Long texts are scanned
    whole, repeated rows come back each, other columns are ignored, an empty table on either side gives no hits.
    """

    found = passages(pick(docs, doc_id="bigint", text="string"), benchmark, width)
    hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["first"])
    ids = F.array_sort("found.items")
    return found.select("row.doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "found.spans")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` less the spans (in bytes, merged)."""
    ends = [0, *(b for _, b in spans)]
    starts = [*(a for a, _ in spans), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs``, all columns, with the hit spans cut out of the texts (from the first byte of a span's first word to the end of its last).

    What stands left and right of a cut may form a window anew; such texts are scanned again until none occurs. Every row stays; texts without
    hits stay as they are. A column n_chars is set anew where a text was cut. Columns may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("binary").alias("text"), F.lit(False).alias("cut"))
    schema = rows.schema
    n, block = _blocks(benchmark, width)
    while True:
        if n > 1:
            rows = stored(rows, "decontaminated")
            before = rows.where("cut").agg(F.sum(F.octet_length("text")), F.count("*")).first()
        for i in range(n):
            sent = docs.sparkSession.sparkContext.broadcast(block(i))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                told = sent.value
                for b in pieces(batches, 1):
                    texts, cut = b.column(1).to_pylist(), b.column(2).to_pylist()
                    at = list(range(len(texts)))
                    while at:
                        spans = scan([texts[k] for k in at], told)[2]
                        hit = [(k, s) for k, s in zip(at, spans, strict=True) if s]
                        for k, s in hit:
                            texts[k], cut[k] = without(texts[k], s), True
                        at = [k for k, _ in hit]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), pa.array(cut, pa.bool_())], ["row", "text", "cut"])

            rows = rows.mapInArrow(run, schema)
            if n > 1:
                rows = stored(rows, "decontaminated")
        if n == 1 or rows.where("cut").agg(F.sum(F.octet_length("text")), F.count("*")).first() == before:
            break
    kind = docs.schema["text"].dataType
    row = F.col("row").withField("text", F.when(F.col("cut"), F.col("text").cast("string").cast(kind)).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("cut"), F.length(F.col("text").cast("string")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*")
