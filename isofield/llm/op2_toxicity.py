"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Fit (on about ``SAMPLE`` labelled documents of each class at most): how many toxic and clean documents hold a feature,
turned into log-odds with an informative Dirichlet prior and their z-scores. Features of a token are the word
and its prefixes of 4 to 6 letters, so that an inflected form not seen in the sample is known by its stem.

Scoring (one pass over the whole table, no shuffle): every token has a score, negative for most; a linear-time scan
finds all maximal segments with a positive sum (Ruzzo and Tompa). A segment of sum S in n tokens of clean text is
expected K n exp(-lambda S) times (Karlin and Altschul); lambda solves sum p(s) exp(lambda s) = 1 over the scores of
clean text. A document's evidence adds -ln P over its significant segments, and a logistic curve fitted on documents
that the features were not fitted on turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick, pieces, stored
from .wordhash import NOT_SPACE, chunks, shingles, words

#: Labelled documents of each class that the fit takes at most, give or take the chance of a hash threshold.
SAMPLE = 10_000
#: A feature counts beyond this many standard deviations; how far it counts is left to the prior, which shrinks rare ones.
LEAST_Z = 2.0
#: Weight of the prior against the counts; documents that it adds to those, of which the curve part chooses; score of a token
#: without a feature that counts.
PRIOR_SHARE, PRIORS, BACKGROUND = 0.02, (0.5, 2.0, 8.0, 32.0), -1.0
PREFIXES = (4, 5, 6)
#: Tokens whose score a task keeps at hand; beyond it the memory is emptied, results stay the same.
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(token: str) -> list[str]:
    return [token, *(token[:n] + "*" for n in PREFIXES if len(token) > n)]


@dataclass
class Model:
    odds: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature: (log-odds, z)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    curve: tuple[float, float] = (-2.0, 0.0)

    def token_score(self, token: str) -> float:
        """Log-odds of the feature that is surest to be toxic, else of the word if it is surely clean, plus background."""
        known = [x for x in (self.odds.get(f) for f in features(token)) if x]
        best = max(known, key=lambda x: x[1], default=None)
        return BACKGROUND + (best[0] if best else 0.0)


class Memo(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[token] = s = self.model.token_score(token)
        return s


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, sum) with a positive sum, in time linear in the scores.

    Every segment kept knows the nearest earlier one that begins at a lower running sum, so a search leaps from one
    to the next and never passes the same segment twice.
    """
    begin: list[int] = []
    end: list[int] = []
    low: list[float] = []  # running sum before a segment
    high: list[float] = []  # and after it
    lower: list[int] = []  # the nearest earlier segment with a smaller ``low``; -1: none
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, floor = i, before
        j = len(begin) - 1
        while True:
            while j >= 0 and low[j] >= floor:
                j = lower[j]
            if j < 0 or high[j] >= total:
                break
            # joined with segment j and all between; what lies lower than that one is known
            first, floor, back = begin[j], low[j], lower[j]
            del begin[j:], end[j:], low[j:], high[j:], lower[j:]
            j = back
        begin.append(first)
        end.append(i + 1)
        low.append(floor)
        high.append(total)
        lower.append(j)
    return [(a, b, h - g) for a, b, g, h in zip(begin, end, low, high, strict=True)]


def evidence(model: Model, scores: list[float]) -> tuple[float, list[tuple[int, int, float]]]:
    """(sum of -ln P over significant segments, those segments with -ln P)."""
    if not scores or max(scores) <= 0:
        return 0.0, []
    found, n = [], len(scores)
    for a, b, s in segments(scores):
        expected = model.scale * n * math.exp(-min(700.0, model.rate * s))
        p = -math.expm1(-expected)
        if p < 0.5:
            found.append((a, b, min(700.0, -math.log(max(p, 1e-300)))))
    return sum(x[2] for x in found), found


def probability(model: Model, x: float) -> float:
    a, b = model.curve
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * math.log1p(x)))))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, int, int]:
    """(text, toxic, least, part) of the sample, and the sizes of both classes.

    A class of more than ``sample`` labelled documents gives those whose hash is below a threshold, about ``sample`` of them; a smaller one gives
    all. Of texts of one class with the same smallest 3-word shingle (nearly always copies of each other) the smallest one
    teaches. part: 0 for features, 1 for the curve.
    """
    own = pick(labels, doc_id="bigint", toxic="int").where("toxic is not null and doc_id is not null").where(~held_out("doc_id"))
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    share = F.when(F.col("toxic") == 1, F.lit(sample / max(sample, sizes.get(1, 0)))).otherwise(F.lit(sample / max(sample, sizes.get(0, 0))))
    chosen = own.where(place < share * F.lit(float(1 << 40)))
    # about 2 * sample rows of two numbers are broadcast
    rows = pick(docs, doc_id="bigint", text="string").where("text is not null").join(F.broadcast(chosen), "doc_id")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, part in chunks([t.encode() for t in b.column("text").to_pylist()]):
                w, at = words(part, NOT_SPACE)
                out += [int(s[0] >> np.uint64(1)) if len(s := shingles(w[at[i] : at[i + 1]], 3)) else 0 for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), pa.array(out, pa.int64())], ["text", "toxic", "least"])

    rows = rows.select("text", "toxic").mapInArrow(key, "text string, toxic int, least bigint")
    rows = rows.groupBy("least", "toxic").agg(F.min("text").alias("text"))
    return rows.withColumn("part", (F.pmod(F.xxhash64("least"), F.lit(10)) < 3).cast("int")), sizes.get(1, 0), sizes.get(0, 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model; without labelled documents of both classes one that gives every document the known share.

    It learns from about ``sample`` labelled documents of each class at most, and of texts of one class that share their
    smallest 3-word shingle from one, so that a text with thousands of copies counts once.
    """
    rows, n_toxic, n_clean = _sampled(docs, labels, sample)
    model = Model(curve=(math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_toxic + n_clean else -2.0, 0.0))
    if not (n_toxic and n_clean):
        return model
    rows = stored(rows, "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[toxic].update({f for t in set(tokens(text)) for f in features(t)})
            names = list({*seen[0], *seen[1]})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], ["feature", "t", "c"])

    counts = rows.where("part = 0").select("text", "toxic").mapInArrow(count, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = stored(counts.where("t + c > 1"), "toxic-features")
    docs_in = {r["toxic"]: r["count"] for r in rows.where("part = 0").groupBy("toxic").count().collect()}
    nt, nc = docs_in.get(1, 0) + 1.0, docs_in.get(0, 0) + 1.0
    models = _models(counts, nt, nc)
    told = rows.sparkSession.sparkContext.broadcast(models)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(m) for m in told.value]
        for b in batches:
            bins: Counter = Counter()
            for text in b.column("text").to_pylist():
                for i, memo in enumerate(memos):
                    bins.update((i, round(memo[t], 1)) for t in tokens(text))
            keys = list(bins)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.float64()), pa.array([bins[k] for k in keys], pa.int64())], ["prior", "score", "n"])

    curve = rows.where("part = 1").select("text", "toxic")
    clean: list[Counter] = [Counter() for _ in models]
    for r in curve.where("toxic = 0").select("text").mapInArrow(scored, "prior int, score double, n bigint").groupBy("prior", "score").agg(F.sum("n").alias("n")).collect():  # one row a prior and tenth
        clean[r["prior"]][r["score"]] = r["n"]
    for m, found in zip(models, clean, strict=True):
        m.rate, m.scale = _extreme(found, max((o for o, _ in m.odds.values()), default=1.0) + BACKGROUND)
    ready = rows.sparkSession.sparkContext.broadcast(models)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(m) for m in ready.value]
        for b in batches:
            found = [[evidence(memo.model, [memo[t] for t in own])[0] for memo in memos] for own in map(tokens, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "evidence"])

    held = curve.mapInArrow(weighed, "toxic int, evidence array<double>").toPandas()  # about 2 * sample rows of a few numbers at most
    xs, y = np.log1p(np.array(held["evidence"].to_list(), float).reshape(-1, len(models))), held["toxic"].to_numpy().astype(float)
    tried = [_calibrated(m, xs[:, i], y, n_toxic / n_clean) for i, m in enumerate(models)]
    return min(tried, key=lambda x: x[0])[1]


def _models(counts: DataFrame, nt: float, nc: float) -> list[Model]:
    """A model without curve for each of ``PRIORS``; counts: feature, t, c (toxic and clean documents that hold it)."""
    of = []
    for base in PRIORS:
        prior = PRIOR_SHARE * (F.col("t") + F.col("c")) + base
        odds = lambda y, n: F.log((y + prior * n / (nt + nc) * 2) / (n + 1))  # noqa: B023, E731
        o = odds(F.col("t"), F.lit(nt)) - odds(F.col("c"), F.lit(nc))
        z = o / F.sqrt(1 / (F.col("t") + prior * nt / (nt + nc) * 2) + 1 / (F.col("c") + prior * nc / (nt + nc) * 2))
        of.append(F.when(F.abs(z) >= LEAST_Z, F.struct(o.alias("odds"), z.alias("z"))))
    kept = counts.select("feature", F.array(*of).alias("of")).where(F.exists("of", lambda x: x.isNotNull())).collect()  # bounded by the sample
    return [Model(odds={r["feature"]: (r["of"][i]["odds"], r["of"][i]["z"]) for r in kept if r["of"][i]}) for i in range(len(PRIORS))]


def _calibrated(model: Model, xs: np.ndarray, y: np.ndarray, ratio: float) -> tuple[float, Model]:
    """(loss on the curve part, ``model`` with its curve)."""
    model.curve = _logistic(xs, y, ratio)
    p = np.clip(1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * xs, -50, 50))), 1e-9, 1 - 1e-9)
    weight = np.where(y > 0, ratio * (1 - y).sum() / max(1.0, y.sum()), 1.0)
    return float(-(weight * np.log(np.where(y > 0, p, 1 - p))).sum()), model


def _extreme(clean: Counter, largest: float) -> tuple[float, float]:
    """(lambda, K) for the scores of clean tokens; one token of the largest score is added, so that lambda is finite."""
    scores = np.array([*clean, max(largest, 0.1)])
    share = np.array([*clean.values(), 1.0])
    share = share / share.sum()
    if (share * scores).sum() >= 0:
        return 1.0, 1.0
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (mid, high) if (share * np.exp(np.minimum(700, mid * scores))).sum() < 1 else (low, mid)
    # share of tokens at which a segment can begin
    return low, float(share[scores > 0].sum())


def _logistic(x: np.ndarray, y: np.ndarray, ratio: float) -> tuple[float, float]:
    """Ridge logistic regression of y on x by Newton steps; ``ratio``: toxic to clean documents outside the sample."""
    if not (0 < y.sum() < len(y)):
        return math.log(ratio), 0.0
    weight = np.where(y > 0, ratio * (1 - y).sum() / y.sum(), 1.0)
    m = np.column_stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        grad = m.T @ (weight * (y - p)) - 0.05 * beta
        hess = (m * (weight * p * (1 - p))[:, None]).T @ m + 0.05 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), max(0.0, float(beta[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages (first and end token of each significant one).

    Null and empty texts and texts without letters score like a text without passages. Long texts are scanned whole. Rows
    come back as often as they came; a null doc_id stays null and counts as held out. Other columns are ignored.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        memo = Memo(model)
        get = memo.__getitem__
        for b in batches:
            value, spans = [], []
            for text in b.column(1).to_pylist():
                x, found = evidence(model, list(map(get, tokens(text)))) if text else (0.0, [])
                value.append(probability(model, x))
                spans.append([{"first": a, "end": e} for a, e, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value, pa.float64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], ["doc_id", "score", "passages"])

    rows = pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, score double, passages array<struct<first: bigint, end: bigint>>")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), "passages")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``score`` with the model that ``fit`` learns from ``labels`` of ``docs``."""
    return score(docs, fit(docs, labels, sample))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs``, with all its columns, less the documents that are predicted toxic. One pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.arrow_udf("double")
    def value(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(model.value)
        get = memo.__getitem__
        for a in texts:
            own = (t for b in pieces([pa.RecordBatch.from_arrays([a], ["text"])], 0) for t in b.column(0).to_pylist())
            yield pa.array([probability(model.value, evidence(model.value, list(map(get, tokens(t))))[0] if t else 0.0) for t in own], pa.float64())

    return docs.where(value(F.col("text").cast("string")) < 0.5)
