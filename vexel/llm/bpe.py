"""Pieces that both byte-level BPE operators use: vocabularies, the splitting pattern, merging of one long piece.

Vocabulary files are read where the work runs, from a path that is a parameter;
the installed public tokenizers have them on every machine.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Sequence
from functools import lru_cache

import public_tokenizers
import regex

#: The pattern that splits text before merging, shared by the byte-level vocabularies.
PATTERN = public_tokenizers.PATTERN


@lru_cache(maxsize=8)
def splitter(pattern: str = PATTERN) -> regex.Pattern:
    """The pattern with white space as the Unicode property, which the tokenizers' engines mean by \\s."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return regex.compile(inside.replace(r"(?!\S)", r"(?=\p{White_Space}|\Z)").replace(r"\s", r"\p{White_Space}"))


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pair_merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id) of every way a token falls into two tokens."""
    found = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found.append((left, right, rank))
    return found


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabularies kept as text: a printable byte for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load_merge_file(path: str) -> tuple[list[int], list[tuple[int, int, int]], list[str]]:
    """Of a tokenizer kept as JSON: the id of each byte, (left, right, merged) by rank, the added tokens' strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    byte_ids = [0] * 256
    for char, byte in printable_bytes().items():
        byte_ids[byte] = vocab[char]
    merges = []
    for merge in spec["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    return byte_ids, merges, [t["content"] for t in spec.get("added_tokens", [])]


def merge_piece(ids: Sequence[int], rank_of: Callable[[tuple[int, int]], tuple[int, int] | None]) -> list[int]:
    """Merge one piece in O(n log n): always the lowest-rank pair, the leftmost of equals. rank_of: pair -> (rank, merged id)."""
    ids, n = list(ids), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := rank_of((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = merged, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for t in ids if t >= 0]
