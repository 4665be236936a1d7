"""Language of a text: scripts narrow the candidates, then Viterbi over per-word scores labels spans.

Fit, on about ``SAMPLE`` documents of each language at most: counts of letter trigrams (with word ends) and the scripts that
make up a hundredth of a language's letters. A word's score in a language is its log-likelihood under the trigrams.

Labelling is one pass without a shuffle. A word's candidates are the languages that use its script (all, if none does). The
best path pays ``SWITCH`` for each change of language. The best single language is the optimal path if against it no stretch of words gains
more than one switch and the best beginning and the best ending together gain no more than one: a path with m changes then has m - 1
stretches within, a beginning and an ending, which gain m switches at most and pay m. Only other texts go through the full recurrence.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick

#: Documents of each language that the fit takes at most, give or take the chance of a hash threshold.
SAMPLE = 800
#: Cost, in nats, of a change of language between two words.
SWITCH = 12.0
MEMO = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")

# First and last code points of scripts, from the Unicode block chart; all else is "Other".
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F),
    ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]


def script(char: str) -> str:
    c = ord(char)
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "Other")


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def letters_of(text: str) -> list[str]:
    """Words in lower case: runs of letters that hold at least one letter in Unicode's sense."""
    return _WORD.findall(text.lower())


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    odds: dict[str, np.ndarray] = field(default_factory=dict)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scripts: dict[str, np.ndarray] = field(default_factory=dict)  # script: which languages use it

    def tabled(self) -> None:
        """Sorted trigram codes beside their rows, for lookups of many words at once."""
        codes = np.array([_code(*map(ord, g)) for g in self.odds], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.rows = np.vstack([*self.odds.values(), self.floor])[[*order, len(order)]] if self.odds else self.floor[None]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, a row a word; a large loss for languages that don't use the script of its first letter."""
        c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        mid = np.flatnonzero(c[1:-1] != 32) + 1  # every letter is the middle of one trigram of its word
        code = _code(c[mid - 1], c[mid], c[mid + 1])
        at = np.searchsorted(self.codes, code)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == code[known]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])
        s = np.add.reduceat(self.rows[np.where(known, at, len(self.codes))], first, axis=0)
        for name, allowed in self.scripts.items():
            if not allowed.all() and allowed.any():
                own = np.array([script(w[0]) == name for w in words])
                s[np.ix_(own, ~allowed)] -= 50.0
        return s


def _code(a, b, c):
    """Three code points in one integer."""
    return (a << 42) + (b << 21) + c if isinstance(a, int) else (a << np.uint64(42)) + (b << np.uint64(21)) + c


class Memo:
    """Numbers words; row i of ``rows`` has the scores of word i."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.model.langs)))

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > MEMO:
            self.reset()
        ids = self.ids
        new = [w for w in set(words) if w not in ids]
        if new:
            n = len(ids)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[n : n + len(new)] = self.model.word_scores(new)
            ids.update(zip(new, range(n, n + len(new)), strict=True))
        return self.rows[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]


def best_path(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language index of each word on the path with the largest sum of scores less ``switch`` a change."""
    n, k = s.shape
    best = int(s.sum(axis=0).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    gain = np.concatenate([np.zeros((1, k)), np.cumsum(s - s[:, [best]], axis=0)])
    ending = gain[-1] - gain.min(axis=0)
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= switch and gain.max() + ending.max() <= switch:
        return np.full(n, best)
    rows, back, v = s.tolist(), [], s[0].tolist()
    for t in range(1, n):
        top = max(range(k), key=v.__getitem__)
        stay = v[top] - switch
        back.append([j if v[j] >= stay else top for j in range(k)])
        v = [(v[j] if v[j] >= stay else stay) + rows[t][j] for j in range(k)]
    out = np.empty(n, np.int64)
    out[-1] = j = max(range(k), key=v.__getitem__)
    for t in range(n - 2, -1, -1):
        j = back[t][j]
        out[t] = j
    return out


def label(memo: Memo, text: str | None) -> tuple[str, float, list[dict]]:
    """(language with the most letters on the best path, its share of the letters, spans of words)."""
    words = letters_of(text or "")
    if words and not text.isascii() and not any(map(str.isalpha, text)):
        words = []  # signs that count as word characters only, such as raised digits
    if not words or not memo.model.langs:
        return UNKNOWN, 0.0, []
    path = best_path(memo.scores(words))
    langs = memo.model.langs
    size = np.fromiter(map(len, words), np.int64, len(words))
    total = np.bincount(path, size, len(langs))
    cut = np.flatnonzero(np.diff(path)) + 1
    starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(words)]
    best = int(total.argmax())
    return langs[best], float(total[best] / total.sum()), [{"lang": langs[path[a]], "first": a, "end": b} for a, b in zip(starts, ends, strict=True)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of documents outside the held-out fold.

    A language with more than ``sample`` of them gives those whose hash is below a threshold, about ``sample``; another gives all. Languages are
    counted first, one row each to the driver: the model holds a row for each as well.
    """
    own = pick(docs, doc_id="bigint", text="string", lang="string").where("text is not null and lang is not null and doc_id is not null").where(~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    large = [x for lang, n in sorted(sizes.items()) if n > sample for x in (F.lit(lang), F.lit(int(sample / n * (1 << 40))))]
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40))
    limit = F.try_element_at(F.create_map(*large), F.col("lang")) if large else F.lit(None).cast("bigint")
    chosen = own.where(place < F.coalesce(limit, F.lit(1 << 40))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for word, n in Counter(letters_of(text)).items():
                    for g in grams(word):
                        seen[lang][g] += n
                    seen[lang]["#" + script(word[0])] += n * len(word)
            rows = [(lang, g, n) for lang, c in seen.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    found = chosen.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in found.toLocalIterator():  # trigrams of the bounded sample
        counts[r["lang"]][r["gram"]] = r["n"]
    model = Model(langs=sorted(counts))
    if not model.langs:
        return model
    plain = {lang: {g: n for g, n in c.items() if g[0] != "#"} for lang, c in counts.items()}
    every = sorted({g for c in plain.values() for g in c})
    total = np.array([sum(plain[x].values()) for x in model.langs], float)
    table = np.array([[plain[x].get(g, 0) for x in model.langs] for g in every], float)
    logs = np.log((table + 0.5) / (total + 0.5 * (len(every) + 1)))
    model.floor = np.log(0.5 / (total + 0.5 * (len(every) + 1)))
    model.odds = dict(zip(every, logs, strict=True))
    for lang_at, lang in enumerate(model.langs):
        own_scripts = {g[1:]: n for g, n in counts[lang].items() if g[0] == "#"}
        for s, n in own_scripts.items():
            if n >= 0.01 * sum(own_scripts.values()):
                model.scripts.setdefault(s, np.zeros(len(model.langs), bool))[lang_at] = True
    model.tabled()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the letters on the best path) and spans (lang, first and end word).

    Null texts and texts without a letter, and all texts if nothing could be learned: ``und``, score 0, no spans. Whole
    texts are labelled however long. Rows come back as often as they came; other columns are ignored; a null doc_id stays null.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(told.value)
        span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = [label(memo, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), span)))], ["doc_id", "lang_pred", "score", "spans"])

    out = pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, lang_pred string, score double, spans array<struct<lang: string, first: bigint, end: bigint>>")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "spans")


def language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``predict`` with the model that ``fit`` learns from ``docs``."""
    return predict(docs, fit(docs, sample))
