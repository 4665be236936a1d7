"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_line_dedup, op2_toxicity, op3_extraction, op4_hyperminhash, op5_sharding, op6_forest, op7_decontamination, op8_mixing, op9_training_order, op10_language, op11_lexical_search, op12_conversation_repair, op13_exact_dedup
from .common import table


#: Bytes of a shard in the query; even the small tables take several.
SHARD_LIMIT = 1 << 20


def op1_line_dedup_(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a maximal repeated run of 50 words or more goes, its short last lines too, but for the first copy."""
    return op1_line_dedup.deduplicated(table(spark, sf, "documents"), whole=True)


def whole_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same, under the name that it had while ``op1_line_dedup`` marked shortest runs only."""
    return op1_line_dedup_(spark, sf)


def op2_toxicity_(spark: SparkSession, sf: str) -> DataFrame:
    return op2_toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc_id", "held_out", "score", "predicted", "n_passages")


def op3_extraction_(spark: SparkSession, sf: str) -> DataFrame:
    return op3_extraction.extract(table(spark, sf, "pages"))


def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return op4_hyperminhash.near_duplicates(table(spark, sf, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_sharding_(spark: SparkSession, sf: str) -> DataFrame:
    return op5_sharding.shards(table(spark, sf, "documents"), SHARD_LIMIT)


def op6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return op6_forest.nearest(table(spark, sf, "embeddings"))


def op7_decontamination_(spark: SparkSession, sf: str) -> DataFrame:
    found = op7_decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_mixing_(spark: SparkSession, sf: str) -> DataFrame:
    return op8_mixing.mixed(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_training_order_(spark: SparkSession, sf: str) -> DataFrame:
    return op9_training_order.shards(table(spark, sf, "documents"))


def op10_language_(spark: SparkSession, sf: str) -> DataFrame:
    return op10_language.language(table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_search(spark: SparkSession, sf: str) -> DataFrame:
    return op11_lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return op12_conversation_repair.judged(op12_conversation_repair.damaged(rows), rows)


def op13_exact_dedup_(spark: SparkSession, sf: str) -> DataFrame:
    return op13_exact_dedup.copies(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup_,
    "line_dedup_whole": whole_runs,
    "op2_toxicity": op2_toxicity_,
    "op3_html_extraction": op3_extraction_,
    "op4_hyperminhash": op4_near_dedup,
    "op5_sharding": op5_sharding_,
    "op6_hash_forest": op6_neighbours,
    "op7_decontamination": op7_decontamination_,
    "op8_mixing": op8_mixing_,
    "op9_training_order": op9_training_order_,
    "op10_language_id": op10_language_,
    "op11_lexical_search": op11_search,
    "op12_conversation_repair": op12_repair,
    "op13_exact_dedup": op13_exact_dedup_,
}

NEAR_ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x.a, x.b FROM x JOIN n p ON p.r = x.a JOIN n q ON q.r = x.b WHERE 100 * x.both >= 80 * (p.n + q.n - x.both)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.t),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.r = d.r LEFT JOIN n ON n.r = d.r
"""

LEAKS_ORACLE = """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
o AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
      FROM (SELECT w.r, w.w, k.n, unnest(range(1, len(w.w) - k.n + 2)) AS i FROM w, k WHERE len(w.w) >= k.n)),
h AS (SELECT o.r, o.n, o.i, p.item_id FROM o JOIN p ON o.n = p.n AND o.g = p.g),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.r = w.r LEFT JOIN t ON t.r = w.r
"""

#: Operators without an entry are learned or approximate (2, 6, 10), parse trees (3) or tokenise (9); tests hold them against
#: brute force, exact round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op1_line_dedup": op1_line_dedup.whole_oracle(),
    "line_dedup_whole": op1_line_dedup.whole_oracle(),
    "op4_hyperminhash": NEAR_ORACLE,
    "op5_sharding": op5_sharding.oracle(SHARD_LIMIT),
    "op7_decontamination": LEAKS_ORACLE,
    "op8_mixing": op8_mixing.ORACLE,
    "op11_lexical_search": op11_lexical_search.ORACLE,
    "op12_conversation_repair": op12_conversation_repair.ORACLE,
    "op13_exact_dedup": op13_exact_dedup.ORACLE,
}
