"""Operator 6. Byte-level BPE encoding and decoding by recursive queries.

Each Python worker holds one DuckDB with the merge table: (left, right, merged)
for every way a token falls into two tokens. The words of a batch become rows
(word, position, token). A recursive query joins each row and its right
neighbour with the merge table and contracts every word's leftmost pair of
minimum rank, until no word has a pair left. Encoding works word by word, so a
batch's distinct words are done once and a text's ids are put together from them;
a worker keeps words up to a bound. Decoding takes the ids of every text: rows
(text, position, id) are joined with the vocabulary and their bytes aggregated in
the order of positions.

Edge cases: null and empty texts give 0 tokens and the hashes of the empty
string; a null id stays null; repeated rows give repeated rows; other columns
are ignored. A piece over LONG_PIECE bytes is merged by a heap, with the same
result, as the recursion's rows grow with the square of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.bpe import load_ranks, merge_piece, pair_merges, splitter
from vexel.llm.common import lean, table, text_slices

#: Words that a worker keeps, documents whose words are learnt together, bytes of a piece beyond which a heap merges it, words of one recursive query.
KEPT_WORDS = 600_000
SLICE_ROWS = 1024
LONG_PIECE = 256
QUERY_WORDS = 30_000
#: Ids of one part of a sequence, and of one decoding query.
PART_IDS, QUERY_IDS = 100_000, 500_000

_CONTRACTED = """
WITH RECURSIVE step AS (
    SELECT 0 AS round, word, pos, token FROM symbols
  UNION ALL (
    WITH neighbour AS (
        SELECT word, pos, token, lead(token) OVER w AS next_token, lead(pos) OVER w AS next_pos
        FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), best AS (
        SELECT n.word, min(m.merged::BIGINT * 65536 + n.pos) AS pick, arg_min(n.next_pos, m.merged::BIGINT * 65536 + n.pos) AS gone
        FROM neighbour n JOIN merges m ON m.lhs = n.token AND m.rhs = n.next_token
        GROUP BY n.word
    )
    SELECT s.round + 1, s.word, s.pos, CASE WHEN s.pos = b.pick % 65536 THEN (b.pick // 65536)::INT ELSE s.token END
    FROM step s JOIN best b ON b.word = s.word
    WHERE s.pos <> b.gone
  )
), ended AS (SELECT word, max(round) AS round FROM step GROUP BY word)
"""

ENCODE = f"{_CONTRACTED} SELECT s.word, list(s.token ORDER BY s.pos) AS ids FROM step s JOIN ended USING (word, round) GROUP BY s.word"

#: The same with the ids in decimal, joined by commas.
ENCODE_TEXT = f"{_CONTRACTED} SELECT s.word, string_agg(s.token::VARCHAR, ',' ORDER BY s.pos) AS ids FROM step s JOIN ended USING (word, round) GROUP BY s.word"

DECODE = """
SELECT i.seq, array_to_string(list(v.hex ORDER BY i.pos), '') AS hex
FROM ids i JOIN vocabulary v ON v.token = i.token GROUP BY i.seq
"""

SCHEMA = "doc_id long, n_tokens long, ids string, decoded binary"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RecursiveCodec:
    def __init__(self, path: str, kept_words: int = KEPT_WORDS) -> None:
        self.kept_words = kept_words
        self.ranks = load_ranks(path)
        merges = pair_merges(self.ranks)
        self.pairs = {(a, b): (c, c) for a, b, c in merges}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = splitter()
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "200MB"})
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self._load("merges", pa.table({"lhs": left, "rhs": right, "merged": merged}))
        self._load("vocabulary", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        #: word -> ids in decimal, joined by commas: the words of late, and those before them
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, words: list[bytes], query: str) -> Iterator[tuple]:
        """Rows of the query, whose word numbers are those of the list; words over LONG_PIECE are left out."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG_PIECE]
        for start in range(0, len(short), QUERY_WORDS):
            part = short[start : start + QUERY_WORDS]
            sizes = np.fromiter((len(words[i]) for i in part), np.int64, len(part))
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            symbols = pa.table({
                "word": np.repeat(np.array(part, np.int32), sizes),
                "pos": (np.arange(sizes.sum()) - first).astype(np.int32),
                "token": self.byte_ids[np.frombuffer(b"".join(words[i] for i in part), np.uint8)],
            })
            self.db.register("symbols", symbols)
            yield from self.db.execute(query).fetchall()
            self.db.unregister("symbols")

    def _merge_long(self, word: bytes) -> list[int]:
        return merge_piece(self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.pairs.get)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out = [self._merge_long(w) if len(w) > LONG_PIECE else [] for w in words]
        for word, ids in self._contract(words, ENCODE):
            out[word] = ids
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids. A long sequence is decoded in parts."""
        parts = [(i, ids[at : at + PART_IDS]) for i, ids in enumerate(sequences) for at in range(0, len(ids), PART_IDS)]
        found: list[list[bytes]] = [[] for _ in sequences]
        start = 0
        while start < len(parts):
            end, held = start, 0
            while end < len(parts) and (end == start or held + len(parts[end][1]) <= QUERY_IDS):
                held += len(parts[end][1])
                end += 1
            own = [ids for _, ids in parts[start:end]]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = pa.table({"seq": np.repeat(np.arange(len(own), dtype=np.int32), sizes), "pos": (np.arange(held) - first).astype(np.int32), "token": np.concatenate(own).astype(np.int32)})
            self.db.register("ids", rows)
            for seq, hexed in sorted(self.db.execute(DECODE).fetchall()):
                found[parts[start + seq][0]].append(bytes.fromhex(hexed))
            self.db.unregister("ids")
            start = end
        return [b"".join(x) for x in found]

    def learn(self, words: set[str]) -> None:
        """Encode the words not yet known."""
        if len(self.known) > self.kept_words // 2:
            self.older, self.known = self.known, {}
        unseen = []
        for word in words.difference(self.known):
            if (kept := self.older.get(word)) is not None:
                self.known[word] = kept
            else:
                unseen.append(word)
        raw = [w.encode() for w in unseen]
        for i, ids in self._contract(raw, ENCODE_TEXT):
            self.known[unseen[i]] = ids
        for i, word in enumerate(raw):
            if len(word) > LONG_PIECE:
                self.known[unseen[i]] = ",".join(map(str, self._merge_long(word)))

    def run(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Of each text: the number of ids, the ids in decimal joined by commas, the bytes they decode to."""
        pieces = [self.split.findall(t) for t in texts]
        self.learn({w for words in pieces for w in words})
        listed = [",".join(map(self.known.__getitem__, words)) for words in pieces]
        numbers = [np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32) for ids in listed]
        for ids, row, raw in zip(listed, numbers, self.decode(numbers), strict=True):
            yield len(row), ids, raw


@lru_cache(maxsize=2)
def codec(path: str, kept_words: int = KEPT_WORDS) -> RecursiveCodec:
    """One for each Python worker, which keeps it from task to task."""
    return RecursiveCodec(path, kept_words)


def _run_batches(path: str, digest: bool, kept_words: int, slice_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path, kept_words)
    for ids, texts in text_slices(batches, ["doc_id", "text"], slice_rows):
        n, listed, decoded = [], [], []
        for count, joined, raw in own.run([t or "" for t in texts]):
            n.append(count)
            listed.append(sha256(joined.encode()).hexdigest() if digest else joined)
            decoded.append(sha256(raw).hexdigest() if digest else raw)
        columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string() if digest else pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])


def encode_decode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, kept_words: int = KEPT_WORDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded bytes of every row; digest: SHA-256 of the last two.

    kept_words: words that a Python worker remembers, about 200 bytes each; slice_rows: texts whose words it learns at once.
    Less of either costs time and changes no result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(partial(_run_batches, ranks_path, digest, kept_words, slice_rows)), DIGEST_SCHEMA if digest else SCHEMA)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digest=True)
