"""Operator 5. Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased words. A document and an
item that share a seed of MIN_TILE consecutive words are a candidate pair. In
each pair running Karp-Rabin matching finds the longest common runs of unmarked
words, marks them, and goes on with shorter ones down to MIN_TILE, so that an
item whose parts stand in another order is still covered. A document is
contaminated by an item of which tiles cover at least COVERAGE.

The benchmark is met in blocks of bounded size, each broadcast to one pass over
the documents; seeds that no document word can form cost nothing, as words
outside the block's vocabulary end a run.

Edge cases: null or empty texts, and items of fewer than MIN_TILE words, match
nothing; null ids are kept; repeated documents or items give repeated rows;
an empty benchmark gives no rows; other columns are ignored, or in
drop_contaminated passed through.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import lean, table, text_slices

MIN_TILE, COVERAGE = 5, 0.5
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Length at which the search for tiles starts.
FIRST_LENGTH = 20

WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long, n_item_words long"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Tile:
    pattern: int
    text: int
    length: int


def tiles(pattern: list[int], text: list[int], least: int = MIN_TILE) -> list[Tile]:
    """Greedy string tiling by running Karp-Rabin: non-overlapping common runs of at least `least` words, longest first."""
    marked_p, marked_t = [False] * len(pattern), [False] * len(text)
    found: list[Tile] = []
    length = max(least, min(FIRST_LENGTH, len(pattern)))
    while True:
        matches, longest = _scan(pattern, text, marked_p, marked_t, length)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-m.length, m.pattern, m.text) for m in matches]
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            clear = [not marked_p[p + i] and not marked_t[t + i] for i in range(-n)]
            if all(clear):
                marked_p[p : p - n] = marked_t[t : t - n] = [True] * -n
                found.append(Tile(p, t, -n))
                continue
            start = 0  # a longer tile has cut this match: its clear parts queue again
            for i, free in enumerate([*clear, False]):
                if not free:
                    if i - start >= length:
                        heapq.heappush(queue, (start - i, p + start, t + start))
                    start = i + 1
        if length == least:
            return found
        length = max(least, length // 2)


def _windows(row: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of each window of unmarked words, by a rolling hash."""
    mod, base = (1 << 61) - 1, 1_000_003
    top, h, run = pow(base, length - 1, mod), 0, 0
    for i, word in enumerate(row):
        if marked[i]:
            h, run = 0, 0
            continue
        if run == length:
            h = (h - (row[i - length] + 2) * top) % mod
            run -= 1
        h = (h * base + word + 2) % mod
        run += 1
        if run == length:
            yield h, i - length + 1


def _scan(pattern: list[int], text: list[int], marked_p: list[bool], marked_t: list[bool], length: int) -> tuple[list[Tile], int]:
    """Maximal unmarked matches of at least `length` words, and the longest one's length."""
    table: dict[int, list[int]] = defaultdict(list)
    for h, start in _windows(pattern, marked_p, length):
        table[h].append(start)
    matches: dict[tuple[int, int], Tile] = {}
    longest = 0
    ends: dict[int, int] = {}
    for h, t in _windows(text, marked_t, length):
        for p in table.get(h, ()):
            if ends.get(t - p, -1) > t:
                continue  # inside a match already found on this diagonal
            n = 0
            while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not marked_p[p + n] and not marked_t[t + n]:
                n += 1
            if n >= length:
                matches[(p, t)] = Tile(p, t, n)
                ends[t - p] = t + n
                longest = max(longest, n)
    return list(matches.values()), longest


class Block:
    """A block of the benchmark: vocabulary, items as word numbers, and the items of each seed."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        seeds: dict[int, set[int]] = defaultdict(set)
        for item_id, text in items:
            row = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if len(row) < MIN_TILE:
                continue
            for h in seed_hashes(np.array(row, np.int64)).tolist():
                seeds[h].add(len(self.items))
            self.items.append((item_id, row))
        self.seeds = {h: sorted(s) for h, s in seeds.items()}
        self.sorted_seeds = np.array(sorted(self.seeds), np.uint64)

    def matches(self, text: str | None) -> Iterator[tuple[int | None, float, int, int, int]]:
        """(item_id, coverage, tiles, longest tile, item words) of every item that shares a seed with the text."""
        words = words_of(text)
        if len(words) < MIN_TILE or not len(self.sorted_seeds):
            return
        known = np.fromiter(map(self.vocabulary.get, words, (-1 for _ in words)), np.int64, len(words))
        hashes = seed_hashes(known)
        inside = np.convolve(known >= 0, np.ones(MIN_TILE, np.int64), "valid") == MIN_TILE
        at = np.flatnonzero(inside)
        if not len(at):
            return
        place = np.minimum(np.searchsorted(self.sorted_seeds, hashes[at]), len(self.sorted_seeds) - 1)
        at = at[self.sorted_seeds[place] == hashes[at]]
        if not len(at):
            return
        by_item: dict[int, list[int]] = defaultdict(list)
        for start in at.tolist():
            for item in self.seeds[int(hashes[start])]:
                by_item[item].append(start)
        for item, starts in by_item.items():
            item_id, row = self.items[item]
            # only words under the pair's seeds can be in a tile; a gap keeps runs apart
            part: list[int] = []
            end = -1
            for start in starts:
                if start > end and part:
                    part.append(-1)
                part.extend(known[max(start, end) : start + MIN_TILE].tolist())
                end = start + MIN_TILE
            found = tiles(row, part)
            if found:
                yield item_id, sum(t.length for t in found) / len(row), len(found), max(t.length for t in found), len(row)


def seed_hashes(row: np.ndarray) -> np.ndarray:
    """A hash of every MIN_TILE consecutive word numbers."""
    n = len(row) - MIN_TILE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    words = row.astype(np.uint64) + np.uint64(1)
    for k in range(MIN_TILE):
        h = (h ^ words[k : k + n]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_BYTES (a longer item alone), read a partition at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        n = len((row[1] or "").encode())
        if block and held + n > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile and n_item_words of every pair with coverage of at least the threshold."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for items in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Block(items))

        def tile(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for ids, texts in text_slices(batches, ["doc_id", "text"]):
                hits = [(i, *hit) for i, text in zip(ids, texts, strict=True) for hit in block.matches(text) if hit[1] >= threshold]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), _TYPES, strict=True)], _NAMES)

        out = out.union(rows.mapInArrow(lean(tile), SCHEMA))
    return out


_NAMES = ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "n_item_words"]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    spark = docs.sparkSession
    for items in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Block(items))
        place = docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                keep = [not any(hit[1] >= threshold for hit in block.matches(t.as_py())) for t in batch.column(place)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(lean(clean), docs.schema)
    return docs


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
