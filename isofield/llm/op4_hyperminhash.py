"""Near-duplicate groups: HyperMinHash sketches, banded, estimated with a collision correction, then verified.

A document's set holds its distinct k-word shingles. One hash per shingle chooses one of 128 registers; a
register keeps, of the smallest remaining hash, the count of leading zeros and ten mantissa bits (two bytes in all). An empty
register borrows from a filled one in an order fixed for all documents, so short texts band like long ones.

Plan at scale: texts are read once for sketches; all that is shuffled is a sketch (256 bytes) for each distinct
set and 32 band keys for it. Equal sets meet by aggregation, never as pairs. Texts are read again only for
distinct sets that share a band with another one. Within a bucket links go to one hub, at first to the
member whose bands are most common; only buckets that still hold several components are taken up again: what is apart
from the hub is compared with everything else around that hub, block by block within a task, first by sketches, which gives links and no pairs. So a group of n copies costs
order n rows, and no link between different texts is lost after banding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces, stored
from ..operators.components import connected_components
from .wordhash import NOT_SPACE, U, chunks, mix, shingles, words

REGISTERS, INDEX_BITS, MANTISSA_BITS = 128, 7, 10
#: 32 bands of 4 registers: a pair of similarity 0.8 shares none of them with probability 5e-8.
BANDS, ROWS = 32, 4
#: A pair with a lower estimate is not verified: 0.8 less ten standard deviations of 128 registers, so that
#: short texts, whose registers depend on each other, are safe as well.
LEAST_ESTIMATE = 0.45
#: Rows of a block in the comparison of what hubs leave apart.
BLOCK = 1000
#: Members of the sets of a block, beyond which it is cut further (8 bytes each); one set stays whole.
MEMBERS = 1_000_000

_ORDER = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=U) + U(77)).reshape(REGISTERS, REGISTERS), axis=1)
_EDGES = (np.arange(REGISTERS, dtype=U) << U(64 - INDEX_BITS)).astype(U)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers of a set of sorted distinct hashes, not empty."""
    first = np.searchsorted(hashes, _EDGES)
    filled = first < np.append(first[1:], len(hashes))
    rest = (hashes[np.minimum(first, len(hashes) - 1)] << U(INDEX_BITS)) >> U(64 - 53)
    share, exponent = np.frexp(rest.astype(np.float64))
    registers = ((53 - exponent) << MANTISSA_BITS) + ((share - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64).clip(0)
    if not filled.all():
        lender = _ORDER[np.arange(REGISTERS), filled[_ORDER].argmax(axis=1)]
        registers = registers[np.where(filled, np.arange(REGISTERS), lender)]
    return registers.astype("<u2")


def expected_collisions(n, m):
    """Registers that agree by chance for sets of n and m members (published approximation for HyperMinHash); numbers or arrays."""
    ratio = np.maximum(n, m) / np.minimum(n, m)
    return 0.169919487159739093975315012348 * 2.0 ** (INDEX_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2


def estimate(a: bytes, b: bytes, n: int, m: int) -> float:
    """Jaccard similarity from two sketches, less the agreement expected by chance."""
    same = int((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).sum())
    chance = expected_collisions(n, m)
    return max(0.0, (same - chance) / (REGISTERS - chance))


def _sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    for _, part in chunks(texts):
        w, at = words(part, NOT_SPACE)
        for i in range(len(part)):
            yield shingles(w[at[i] : at[i + 1]], k)


def node_of(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set: two independent sums over mixed members."""
    one = mix(hashes).sum(dtype=U)
    two = mix(mix(hashes ^ U(0x5851F42D4C957F2D)) + U(len(hashes))).sum(dtype=U)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sketch); node and sketch are null for a set without members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            n, node, sk = [], [], []
            for s in _sets(b.column(2).to_pylist(), k):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sk, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "sketch"])

    return pick(docs, doc_id="bigint", text="binary").select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, node binary, sketch binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, members): the whole shingle set of each text, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            node, members, size = [], [], 0
            for s in _sets(b.column(0).to_pylist(), k):
                if len(s):
                    node.append(node_of(s))
                    members.append(s.view(np.int64))
                    size += len(s)
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(members, pa.list_(pa.int64()))], ["node", "members"])
                    node, members, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(members, pa.list_(pa.int64()))], ["node", "members"])

    return docs.select("text").mapInArrow(run, "node binary, members array<bigint>")


def _agree(same: np.ndarray, n: np.ndarray, m: np.ndarray | float) -> np.ndarray:
    """Whether sketches that share ``same`` registers, of sets of n and m members, may belong to similar sets."""
    chance = expected_collisions(n, m)
    return (same - chance) / (REGISTERS - chance) >= LEAST_ESTIMATE


def _registers(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u2").reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, nu, nv, su, sv) those whose estimate and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (_registers(b.column(i).to_pylist()) for i in (4, 5))
            n, m = (b.column(i).to_numpy().astype(float) for i in (2, 3))
            yield b.filter(pa.array(_agree((a == c).sum(axis=1), n, m))).select([0, 1, 2, 3])

    return pairs.mapInArrow(run, "u binary, v binary, nu bigint, nv bigint")


_BLOCK_KEY = ["group", "mb", "ob"]
_BLOCK_ROWS = "group bigint, mb int, ob int, ask boolean, hub binary, node binary, n bigint, root binary"


def _rest(entries: DataFrame, hubs: DataFrame, roots: DataFrame, members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of a bucket that its hub left in different components.

    A node that isn't in its hub's component meets every other node that shares a bucket of this hub, in blocks of about ``BLOCK`` rows, or fewer if
    their sets have more than ``MEMBERS`` members, on either side. Sketches meet first; whole sets go only to the blocks in which the sketch has a likely partner of another
    component, and only those of such nodes. At most one link for each node, component and block comes back. Small groups share a task.
    """
    now = entries.join(roots.withColumnRenamed("root", "found"), "node", "left").select("node", "n", "key", F.coalesce("found", "node").alias("root")).join(hubs, "key")
    split = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c")).where("a <> b and c > 2").select("key")
    hub_root = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    around = now.where("node <> hub").join(split, "key").select("hub", "node", "n", "root").distinct().join(hub_root, "hub", "left")
    around = stored(around.withColumn("apart", F.col("root") != F.coalesce("hub_root", "hub")).drop("hub_root"), "around-hubs")
    apart = F.col("apart").cast("int")
    sizes = around.groupBy("hub").agg(F.count("*").alias("c"), F.sum(apart).alias("o"), F.sum("n").alias("cn"), F.sum(apart * F.col("n")).alias("on")).where("o > 0 and c > 1")
    n_rows, n_members = around.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = max(1, n_rows // (4 * BLOCK), n_members // (4 * MEMBERS))
    blocks = lambda c: F.ceil(F.greatest(F.col(c) / BLOCK, F.col(c + "n") / MEMBERS)).cast("int")
    group = F.when((F.col("c") > BLOCK) | (F.col("cn") > MEMBERS), F.xxhash64("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(shared)))
    # stored, so that the planner knows its size and deals the rows of a large hub by that
    sizes = stored(sizes.select("hub", group.alias("group"), blocks("c").alias("mbs"), blocks("o").alias("obs")), "hub-sizes")
    full = around.join(sizes, "hub").join(classes.select("node", "sketch"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["hub", "node", "n", "root", "sketch"]
    held_rows = full.select("group", own("mbs").alias("mb"), each("obs").alias("ob"), F.lit(False).alias("ask"), *columns)
    asks_rows = full.where("apart").select("group", each("mbs").alias("mb"), own("obs").alias("ob"), F.lit(True).alias("ask"), *columns)

    def likely(rows: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(rows), bool)
        ask, n, root = rows["ask"].to_numpy(), rows["n"].to_numpy(), rows["root"].to_numpy()
        for at in rows.groupby("hub", sort=False).indices.values():
            held, asks = at[~ask[at]], at[ask[at]]
            if not len(held) or not len(asks):
                continue
            every = _registers(rows["sketch"].iloc[held].to_list())
            for i, own in zip(asks, _registers(rows["sketch"].iloc[asks].to_list()), strict=True):
                good = _agree((every == own).sum(axis=1), n[held], n[i]) & (100 * np.minimum(n[held], n[i]) >= percent * np.maximum(n[held], n[i])) & (root[held] != root[i])
                if good.any():
                    keep[i] = True
                    keep[held[good]] = True
        return rows.loc[keep, [*_BLOCK_KEY, "ask", "hub", "node", "n", "root"]]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        a, b = rows[~rows["ask"]], rows[rows["ask"]]
        by_hub = dict(list(a.groupby("hub", sort=False)))
        for hub, asks in b.groupby("hub", sort=False):
            if (held := by_hub.get(hub)) is None:
                continue
            owner = np.repeat(np.arange(len(held)), held["n"].to_numpy())
            every = np.concatenate(held["members"].to_list())
            n, node, root = held["n"].to_numpy(), held["node"].to_list(), held["root"].to_list()
            for x, nx, rx, sx in zip(asks["node"], asks["n"], asks["root"], asks["members"], strict=True):
                sx = np.sort(sx)
                both = np.bincount(owner[sx[np.minimum(np.searchsorted(sx, every), len(sx) - 1)] == every], minlength=len(held))
                known = {rx}
                for i in np.flatnonzero(100 * both >= percent * (n + nx - both)):
                    if root[i] not in known:
                        known.add(root[i])
                        u.append(x)
                        v.append(node[i])
        return pd.DataFrame({"u": pd.Series(u, dtype=object), "v": pd.Series(v, dtype=object)})

    hopeful = held_rows.union(asks_rows).groupBy(*_BLOCK_KEY).applyInPandas(likely, _BLOCK_ROWS)
    hopeful = stored(hopeful, "likely")
    return stored(hopeful.join(members, "node").groupBy(*_BLOCK_KEY).applyInPandas(compare, "u binary, v binary"), "links-of-the-rest")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * |A and B| >= percent * |A or B| over their k-word shingle sets.

    Reads doc_id (integer) and text; other columns are ignored. Returns doc_id, n_shingles, component_id (smallest
    non-null doc_id reachable), kept (doc_id = component_id), text_key (64-bit hash of the text) and group_key (names
    the group; null where n_shingles is 0).
    Null or empty texts, and texts without words, have n_shingles 0, stand alone and are kept. Repeated rows come
    back as often as they came. A null doc_id takes part in links; such a row is kept only where
    no member of its group has an id (component_id is null then). Empty table: empty result.
    ``percent`` below 60 is refused: banding is laid out for high similarities.
    """
    if percent < 60:
        raise ValueError("percent must be 60 at least")
    all_docs = stored(sketches(docs, k), "sketches")
    sets = all_docs.where("n_shingles > 0")
    classes = sets.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("min_doc"))
    classes = stored(classes, "classes")

    band = lambda i: F.xxhash64(i, F.substr(F.col("sketch"), i * F.lit(2 * ROWS) + 1, F.lit(2 * ROWS)))
    keyed = classes.select("node", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = stored(keyed.join(crowded, "key"), "bands")
    # a text from which many copies were made has the values that are common in all its bands
    central = stored(entries.groupBy("node").agg(F.sum("size").alias("central")), "central")
    entries = stored(entries.join(central, "node").select("node", "n", "key", "central"), "band-entries")

    busy = entries.select("node").distinct()
    chosen = classes.join(busy, "node").select("node", F.col("min_doc").alias("doc_id"))
    texts = pick(docs, doc_id="bigint", text="binary").where(F.col("text").isNotNull())
    wanted = chosen.select("doc_id").distinct().alias("c")
    found = texts.alias("t").join(wanted, F.expr("t.doc_id <=> c.doc_id"), "left_semi")
    members = full_sets(found, k).join(busy, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))
    members = stored(members, "members")

    first = F.min(F.struct((-F.col("central")).alias("rank"), "node", "n")).alias("hub")
    hubs = stored(entries.groupBy("key").agg(first).select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("m")), "hubs")
    pairs = entries.join(hubs, "key").where(f"node <> hub and 100 * least(n, m) >= {percent} * greatest(n, m)").select(F.col("node").alias("u"), F.col("hub").alias("v"), F.col("n").alias("nu"), F.col("m").alias("nv")).distinct()
    s = classes.select("node", "sketch")
    pairs = pairs.join(s.select(F.col("node").alias("u"), F.col("sketch").alias("su")), "u").join(s.select(F.col("node").alias("v"), F.col("sketch").alias("sv")), "v").select("u", "v", "nu", "nv", "su", "sv")
    left, right = members.select(F.col("node").alias("u"), F.col("members").alias("mu")), members.select(F.col("node").alias("v"), F.col("members").alias("mv"))
    both = F.size(F.array_intersect("mu", "mv"))
    checked = _estimated(pairs).join(left, "u").join(right, "v").where(100 * both >= percent * (F.col("nu") + F.col("nv") - both)).select("u", "v")
    links = stored(checked, "links-to-hubs")
    roots = connected_components(links)
    rest = _rest(entries, hubs, roots, members, classes, percent)
    if rest.take(1):
        roots = connected_components(links.union(rest))

    placed = classes.select("node", "min_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    ids = stored(placed.join(smallest, "root").select("node", "component_id", F.hex("root").alias("group_key")), "components")
    out = all_docs.join(ids, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key", "group_key")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, with all its columns, less every row but one of each group; texts without words all stay.

    Of a group stays the row with the smallest doc_id (ties: the smallest text hash; of equal rows, any one).
    """
    rows = stored(near_duplicates(docs, k, percent).where("kept and n_shingles > 0").select("doc_id", "text_key", "group_key"), "kept")
    single = rows.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.doc_id", "x.text_key").distinct()
    text = F.col("text")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text.cast("binary")).alias("text_key"), F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    stay = own.alias("d").where("worded").join(single.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.text_key = s.text_key"), "left_semi")
    if rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").take(1):
        stay = stay.groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
    return stay.select("row").union(own.where("not worded").select("row")).select("row.*")
