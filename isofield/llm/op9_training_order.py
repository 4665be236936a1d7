"""Token ids in training order, as shards of fixed-stride binary records.

Texts are tokenised once and stored. Documents stand in the order of their ids (ties: text hash) and each ends with ``END``; sums of
their lengths give every document its place in one long sequence of ids, which is cut into records of ``LENGTH``, the last one padded. So records don't
depend on how the input is split. A keyed Feistel network over the next power of four, walked along its cycle until it falls below the number
of records, gives each record its global slot: a permutation that needs no sort and no table. Shard s holds the slots from
s * SHARD to (s + 1) * SHARD as one blob, and a record's place in it is its slot's remainder: a reader goes on from any
slot by reading shard slot div SHARD from byte (slot mod SHARD) * stride.

Every id crosses the network twice: to its document's place, and cut at record bounds to its shard, where it is written.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, pick, pieces, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to that vocabulary (a fixed value), and its free id, which ends a document.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH = 2048
SHARD = 1024
KEY = 0x1F2E3D4C5B6A7988
#: White space as the pattern understands it, in runs too long for it.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver and sent to the tasks (about a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str = PATTERN):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class Tokeniser:
    """Ids of a text as little-endian uint16 bytes.

    The splitting pattern backtracks over white space, which ends in an error on runs of about a million characters. Long runs are
    therefore cut out where the pattern would cut them: all of a run but its last character is one piece; at the text's end, all of it.
    """

    def __init__(self, ranks: bytes):
        self.ranks, self.encoding = ranks, _encoding(ranks)

    def ids(self, text: str) -> list[int]:
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += _encoding(self.ranks, r"[\s\S]+").encode_ordinary(text[run.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def __call__(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u2").tobytes()


def feistel(slot: np.ndarray, n: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to each number; values beyond n walk on along their cycle."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * (2 * r + 1) + 0x9E3779B97F4A7C15 * r) % (1 << 64)) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            y = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((y >> np.uint64(17)) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(slot).astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _placed(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, int]:
    """(doc_id, tokens, before): ids of every document and how many ids stand before them; and how many there are in all."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokeniser(ranks.value)
        for b in pieces(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([(encode(t) if t else b"") + end for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "text_key", "tokens"])

    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    rows = stored(rows.mapInArrow(run, "doc_id bigint, text_key bigint, tokens binary").withColumn("row", F.monotonically_increasing_id()), "tokens", "zstd")
    sizes = rows.select("row", F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", (F.octet_length("tokens") / 2).cast("bigint").alias("n"))
    before = numbered(sizes, ["none", "doc_id", "text_key", "row"], "n", "token-sums").select("row", "before")
    return rows.join(before, "row").select("doc_id", "tokens", "before"), sizes.agg(F.sum("n")).first()[0] or 0


_PACKED = "shard bigint, first_slot bigint, records binary, n_tokens array<bigint>, doc_ids array<bigint>, docs_from array<int>"


def shards(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, key: int | None = KEY) -> DataFrame:
    """One row a shard, ready to be written: shard, first_slot, records (a blob of records of a fixed stride, in slot order), n_tokens (ids of
    each record before the padding), doc_ids (documents that have ids in the records, in order) and docs_from (record i has those from docs_from[i] up to
    docs_from[i + 1]). Without ``key`` records keep the order of the documents.

    Ids are little-endian uint16. Slots are 0 to the number of records less one, each once. Every document has at least its END id, whatever its
    text; null text counts as empty. A null doc_id stays null and comes last in the order before the permutation; repeated rows are
    documents of their own; other columns are ignored; an empty table gives no shard. The same rows give the same bytes however the input is split.
    """
    rows, n_ids = _placed(docs, vocabulary)
    stride, total = 2 * length, -(-n_ids // length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids, record, at, tokens = zip(*rows, strict=True)
            record = np.array(record, np.int64)
            slot = record if key is None else feistel(record, total, key)
            return pa.RecordBatch.from_arrays([pa.array(slot // shard), pa.array(slot % shard), pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], ["shard", "place", "at", "doc_id", "tokens"])

        for b in batches:
            out, size = [], 0
            for doc_id, tokens, before in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                record, at, done = before // length, before % length, 0
                while done < len(tokens):
                    part = tokens[done : done + stride - 2 * at]
                    out.append((doc_id, record, at, part))
                    size += len(part)
                    record, at, done = record + 1, 0, done + len(part)
                    if size > 4 << 20:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, blob, n_tokens, doc_ids, docs_from = None, None, [], [], [], [0]

        def padded() -> None:
            if n_tokens and n_tokens[-1] < length:
                blob.append(np.full(length - n_tokens[-1], END, "<u2").tobytes())

        def row() -> pa.RecordBatch:
            padded()
            cells = ([now], [now * shard], [b"".join(blob)], [n_tokens], [doc_ids], [docs_from])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

        for b in batches:
            for s, p, _, doc_id, tokens in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if s != now:
                    if blob:
                        yield row()
                    now, place, blob, n_tokens, doc_ids, docs_from = s, None, [], [], [], [0]
                if p != place:
                    padded()
                    place = p
                    n_tokens.append(0)
                    docs_from.append(len(doc_ids))
                blob.append(tokens)
                n_tokens[-1] += len(tokens) // 2
                doc_ids.append(doc_id)
                docs_from[-1] += 1
        if blob:
            yield row()

    pieces = rows.mapInArrow(cut, "shard bigint, place bigint, at bigint, doc_id bigint, tokens binary")
    return pieces.repartition("shard").sortWithinPartitions("shard", "place", "at").mapInArrow(pack, _PACKED)


def _records(packed: DataFrame, length: int) -> DataFrame:
    """One row a record of ``packed``: slot, shard, place, n_tokens, doc_ids, tokens."""
    stride = 2 * length
    rows = packed.select("shard", "first_slot", "records", "doc_ids", "docs_from", F.posexplode("n_tokens").alias("place", "n_tokens"))
    first, end = (F.get("docs_from", F.col("place") + i) for i in (0, 1))
    return rows.select((F.col("first_slot") + F.col("place")).alias("slot"), "shard", "place", "n_tokens", F.slice("doc_ids", first + 1, end - first).alias("doc_ids"), F.substr(F.col("records"), F.col("place") * stride + 1, F.lit(stride)).alias("tokens"))


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """(part, row, n_tokens, doc_ids, tokens): the records in the order of the documents, ``SHARD`` a part."""
    return _records(shards(docs, vocabulary, length, SHARD, None), length).select(F.col("shard").cast("int").alias("part"), F.col("place").cast("bigint").alias("row"), "n_tokens", "doc_ids", "tokens")


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """``shards`` as one row a record: slot, shard, place (in the shard), n_tokens, doc_ids, tokens. Records of a shard stay in one task, in order."""
    return _records(shards(docs, vocabulary, length, shard, key), length)


def write_shards(ordered: DataFrame, path: str, shard: int = SHARD) -> None:
    """Rows of ``training_order`` as one row a shard: its number, its first slot, and one blob of records of a fixed stride, in slot order.

    For rows that were dealt or filtered since; ``shards`` gives the same without another shuffle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, blob = None, None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([first], pa.int64()), pa.array([b"".join(blob)], pa.binary())], ["shard", "first_slot", "records"])

        for b in batches:
            for s, slot, tokens in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now:
                    if blob:
                        yield row()
                    now, first, blob = s, slot, []
                blob.append(tokens)
        if blob:
            yield row()

    rows = ordered.select("shard", "slot", "tokens").repartition("shard").sortWithinPartitions("shard", "slot")
    rows.mapInArrow(pack, "shard bigint, first_slot bigint, records binary").write.parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, count: int, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(slot, tokens) of ``count`` records from ``slot`` on: whole shards outside are skipped, the rest is cut by stride."""
    stride, last = 2 * length, slot + count - 1
    blobs = spark.read.parquet(path).where(F.col("shard").between(slot // shard, last // shard))
    rows = blobs.select("first_slot", "records", F.explode(F.sequence(F.lit(0), (F.octet_length("records") / stride).cast("int") - 1)).alias("i"))
    rows = rows.withColumn("slot", F.col("first_slot") + F.col("i")).where(F.col("slot").between(slot, last))
    return rows.select("slot", F.substr(F.col("records"), F.col("i") * stride + 1, F.lit(stride)).alias("tokens")).orderBy("slot")
