"""Text similarity: hashed character n-grams and fuzzy partial matching, plain and as Arrow UDFs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Lengths of the n-grams and number of buckets.
NGRAMS, BUCKETS = (1, 6), 64
_MASK = 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32 bit, signed."""
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (((h ^ _scramble(int.from_bytes(data[i : i + 4], "little"))) << 13) | ((h ^ _scramble(int.from_bytes(data[i : i + 4], "little"))) >> 19)) & _MASK
        h = (h * 5 + 0xE6546B64) & _MASK
    if whole < len(data):
        h ^= _scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & _MASK
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & _MASK
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _scramble(k: int) -> int:
    k = (k * 0xCC9E2D51) & _MASK
    k = ((k << 15) | (k >> 17)) & _MASK
    return (k * 0x1B873593) & _MASK


@lru_cache(maxsize=200_000)
def _place(gram: str, buckets: int) -> tuple[int, int]:
    h = murmur3_32(gram.encode())
    return abs(h) % buckets, 1 if h >= 0 else -1


def hash_features(text: str | None, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS) -> list[float]:
    """L2-normalised signed counts of character n-grams of the lower-cased text, white-space runs as one space."""
    text = re.sub(r"\s\s+", " ", (text or "").lower())
    counts = Counter(text[i : i + n] for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(text) - n + 1))
    out = [0.0] * buckets
    for gram, n in counts.items():
        at, sign = _place(gram, buckets)
        out[at] += sign * n
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


#: Characters whose n-grams are hashed at once.
_CHARS = 200_000


def _scramble_all(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)


def _murmur_all(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """MurmurHash3 of many short byte ranges. words: at every byte the four bytes from there on."""
    h, whole, rest = np.zeros(len(start), np.uint32), size // 4, size % 4
    for block in range(int(whole.max(initial=0))):
        own = np.flatnonzero(whole > block)
        x = h[own] ^ _scramble_all(words[start[own] + 4 * block])
        h[own] = ((x << np.uint32(13)) | (x >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
    own = np.flatnonzero(rest)
    tail = words[start[own] + 4 * whole[own]] & ((np.uint32(1) << (8 * rest[own]).astype(np.uint32)) - np.uint32(1))
    h[own] ^= _scramble_all(tail)
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _blocks(texts: Sequence[str | None], buckets: int, overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """The cleaned texts in pieces, with the number of each piece's text, in blocks of about _CHARS: a longer text is cut, and each piece but the last has the next `overlap` characters too."""
    rows, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        clean = re.sub(r"\s\s+", " ", (text or "").lower())
        for low in range(0, len(clean), _CHARS):
            rows.append(row)
            pieces.append(clean[low : low + _CHARS + overlap])
            held += len(pieces[-1]) + buckets
            if held >= _CHARS:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if rows:
        yield rows, pieces


def _counts(pieces: list[str], buckets: int, ngrams: tuple[int, int]) -> np.ndarray:
    """Signed counts of the n-grams that begin in the first _CHARS characters of every piece."""
    raw = np.frombuffer("".join(pieces).encode(), np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    sizes = np.array([len(t) for t in pieces])
    owner = np.repeat(np.arange(len(pieces)), sizes)
    begins = np.arange(len(owner)) < (np.cumsum(sizes) - sizes + _CHARS)[owner]
    padded = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
    words = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    out = np.zeros(len(pieces) * buckets)
    for n in range(ngrams[0], ngrams[1] + 1):
        at = np.arange(max(0, len(owner) - n + 1))
        at = at[begins[at] & (owner[at] == owner[at + n - 1])]
        h = _murmur_all(words, starts[at], starts[at + n] - starts[at]).astype(np.int64)
        out += np.bincount(owner[at] * buckets + np.abs(h) % buckets, np.where(h >= 0, 1.0, -1.0), len(out))
    return out.reshape(-1, buckets)


def hash_features_batch(texts: Sequence[str | None], buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS) -> np.ndarray:
    """hash_features of every text, as rows; the n-grams of a block of texts are hashed together, so memory does not grow with the texts."""
    out = np.zeros((len(texts), buckets))
    for rows, pieces in _blocks(texts, buckets, ngrams[1] - 1):
        np.add.at(out, rows, _counts(pieces, buckets, ngrams))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def cosine_of(a: list[float], b: list[float]) -> float:
    """NaN where a side is zero."""
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else math.nan


def text_hash_scores(query: str, documents: list[str]) -> list[float]:
    own = hash_features(query)
    return [cosine_of(own, hash_features(d)) for d in documents]


def _lcs(places: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence, bit-parallel. places: bits of each character of a string of `size`."""
    state = full = (1 << size) - 1
    for c in text:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def partial_ratio(a: str | None, b: str | None) -> int:
    """0 to 100: the best Indel similarity of the shorter text with any window of its length, or a shorter one at either end, of the longer."""
    if not a or not b:
        return 0
    best = _best_window(a, b) if len(a) <= len(b) else _best_window(b, a)
    if len(a) == len(b) and best < 1:
        best = max(best, _best_window(b, a))
    return round(100 * best)


def _best_window(short: str, long: str) -> float:
    m, places = len(short), {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
    if short in long:
        return 1.0
    best = 0.0
    for i in range(len(long) - m + 1):
        if long[i + m - 1] in places:
            best = max(best, _lcs(places, m, long[i : i + m]) / m)
    for n in range(m - 1, 0, -1):
        if 2 * n / (m + n) <= best:
            break  # no shorter window can do better
        best = max(best, 2 * _lcs(places, m, long[:n]) / (m + n), 2 * _lcs(places, m, long[-n:]) / (m + n))
    return best


@pandas_udf(T.ArrayType(T.DoubleType()))
def hash_features_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(list(hash_features_batch(texts.tolist())))


def text_hash_score(query: str, text: Column) -> Column:
    own = hash_features(query)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([cosine_of(own, row) for row in hash_features_batch(texts.tolist()).tolist()])

    return score(text)


def fuzzy_partial_ratio(query: str, text: Column) -> Column:
    @pandas_udf("int")
    def ratio(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: partial_ratio(query, t)).astype("int32")

    return ratio(text)
