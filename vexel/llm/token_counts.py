"""Operator 4. Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie end to end in one array of symbol ids, with an
array that says which sequence each symbol belongs to. A round looks up the
rank of every adjacent pair, takes each sequence's lowest, and merges all
occurrences of that pair in all sequences at once (from the left where they
overlap). Sequences without a mergeable pair leave; the symbols that survive
are counted. A worker keeps counts of words it has seen, up to a bound.

Special tokens that the vocabulary lists count as one wherever their string
stands, as the library does by default; nothing is added or cut.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a null id stays
null; repeated rows give repeated rows; other columns are ignored. A single
piece over LONG_PIECE symbols is merged by a heap, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.bpe import load_merge_file, merge_piece, splitter
from vexel.llm.common import table, text_slices

#: Words whose counts a worker keeps, and symbols of a piece beyond which a heap merges it.
KEPT_WORDS = 400_000
LONG_PIECE = 2_048
#: Words that are merged in one go.
ROUND_WORDS = 100_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class RaggedCounter:
    def __init__(self, path: str) -> None:
        byte_ids, merges, special = load_merge_file(path)
        self.byte_ids = np.array(byte_ids, np.int64)
        self.base = 1 + max(max(m) for m in merges) if merges else 256
        left, right, merged = (np.array(x, np.int64) for x in zip(*merges, strict=True)) if merges else (np.empty(0, np.int64),) * 3
        order = np.argsort(left * self.base + right, kind="stable")
        self.keys, self.ranks, self.merged = (left * self.base + right)[order], order, merged[order]
        self.pairs = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        self.split = splitter()
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def merge_rounds(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each word survive."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = sizes.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        none = len(self.keys)
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            key = symbols[:-1] * self.base + symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(same & (self.keys[place] == key), self.ranks[place], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            wanted = np.repeat(lowest, lengths)
            hit = (rank == wanted) & (rank < none)
            # of a run of hits that overlap, every second one counts, from the left
            at = np.flatnonzero(hit)
            if not len(at):
                break
            fresh = np.append(True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[place[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            np.subtract.at(counts, owner[at], 1)
            keep &= np.repeat(lowest < none, lengths)
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known.clear()
        short = []
        for word in words:
            raw = word.encode()
            if len(raw) > LONG_PIECE:
                self.known[word] = len(merge_piece(self.byte_ids[np.frombuffer(raw, np.uint8)].tolist(), self.pairs.get))
            else:
                short.append((word, raw))
        for i in range(0, len(short), ROUND_WORDS):
            part = short[i : i + ROUND_WORDS]
            self.known.update(zip((w for w, _ in part), self.merge_rounds([r for _, r in part]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        extra, pieces = [], []
        for text in texts:
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                extra.append(len(parts) - 1)
                pieces.append([w for p in parts for w in self.split.findall(p)])
            else:
                extra.append(0)
                pieces.append(self.split.findall(text))
        unseen = list({w for words in pieces for w in words}.difference(self.known))
        if len(self.known) + len(unseen) > KEPT_WORDS:
            self.known.clear()
            unseen = list({w for words in pieces for w in words})
        self.learn(unseen)
        return [n + sum(map(self.known.__getitem__, words)) for n, words in zip(extra, pieces, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> RaggedCounter:
    """One for each Python worker, which keeps it from task to task."""
    return RaggedCounter(path)


def _count_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = counter(path)
    for ids, texts in text_slices(batches, ["doc_id", "text"]):
        texts = [t or "" for t in texts]
        n_bytes = [len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(tokens.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_count_batches, tokenizer_path), SCHEMA)


LIMIT = 1024


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
