"""Words of many texts at once as 64-bit hashes, with numpy over the UTF-8 bytes.

A word's hash is a polynomial over random byte codes modulo 2**64, taken from one running sum per chunk
of texts, so that no Python object is made for a word. A-Z hash as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
#: Texts are joined up to about this many bytes before one numpy pass; a longer text is a chunk of its own.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply and xor-shift)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random odd code for every byte; capital ASCII letters share the code of the small ones.
CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
CODES[65:91] = CODES[97:123]

#: Bytes of the class [^\x20\x09-\x0D]: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(BASE), of(BASE_INVERSE)


def chunks(texts: list[bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with about ``limit`` bytes each; None counts as empty."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if part and size + len(t) > limit:
            yield at, part
            at, part, size = i, [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield at, part


def words(part: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, bounds): text i has the words bounds[i]:bounds[i + 1]. ``kind``: bytes that make words."""
    return located(part, kind)[:2]


def located(part: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``; also the first byte and the end of every word, counted from the start of its own text."""
    joined = b"\n".join(part)
    buf = np.frombuffer(joined, np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in part])
    if not len(buf):
        none = np.zeros(0, np.int64)
        return np.empty(0, U), np.zeros(len(part) + 1, np.int64), none, none
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = kind[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _powers(1 << max(20, int(len(buf) + 1).bit_length()))
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(CODES[buf] * power[: len(buf)], out=total[1:])
    out = mix((total[end] - total[start]) * inverse[start])
    bounds = np.concatenate([[0], np.searchsorted(start, ends_of)]).astype(np.int64)
    own = np.repeat(np.concatenate([[0], ends_of[:-1]]), np.diff(bounds))
    return out, bounds, start - own, end - own


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; of the whole sequence if it is shorter."""
    n = len(word)
    if not n:
        return word
    k = min(k, n)
    acc = np.full(n - k + 1, k, U)
    for j in range(k):
        acc = mix(acc * U(0xD6E8FEB86659FD93) + word[j : n - k + 1 + j])
    return np.unique(acc)
