"""Operator 9. SimHash near-duplicates by BK-trees.

Fingerprints: 64 majority votes over the XXH64 hashes of a text's 3-word
shingles. Links: fingerprints that differ in at most RADIUS bits.

Only distinct fingerprints are compared. If two differ in at most RADIUS bits
and the 64 bits are cut into b blocks, at least b - RADIUS blocks are equal, so
every linked pair meets in one of the buckets keyed by a choice of b - RADIUS
blocks; b grows with the number of fingerprints so that buckets stay small.
A bucket is a shard: its fingerprints are put in a BK-tree, whose children are
keyed by the integer Hamming distance to the parent, and each is looked up along
the edges within the radius of its own distance. A bucket of more than
SHARD_ROWS is cut into shards, and the tree of each shard meets the rows of each
later one, so that memory is bounded and no link is lost. A tree hands on a
spanning forest of its links and not all pairs.

Edge cases: a null or empty text, or one without words, has fingerprint zero and
is linked like any other; a text of one or two words is one shingle; a null id
never is the least id of a component unless the component has no other (then
its component_id is null); repeated rows give repeated rows; other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import fresh, hub_join, lean, materialize, table, text_slices
from vexel.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one tree, and the mean size of a bucket beyond which more blocks are cut.
SHARD_ROWS = 20_000
BUCKET_ROWS = 64


def fingerprint(text: str) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = text.encode().lower().split()  # bytes: A-Z are lowered, ASCII white space splits
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else [b" ".join(w) for w in zip(words, words[1:], words[2:], strict=False)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Nodes in flat lists; children[i] maps a distance to a node."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = new
                break
            at = below
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The nodes at most radius away."""
        pending = [0] if self.values else []
        while pending:
            at = pending.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            pending.extend(child for d, child in self.children[at].items() if distance - radius <= d <= distance + radius)


class Forest:
    """Union-find over the rows of one bucket."""

    def __init__(self) -> None:
        self.parent: list[int] = []

    def add(self) -> None:
        self.parent.append(len(self.parent))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def links(tree_rows: list[int], other_rows: Iterable[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among tree_rows, or between tree_rows and other_rows."""
    tree, forest = BKTree(), Forest()
    for value in tree_rows:
        if other_rows is None:
            near = list(tree.within(value, radius))
        at = tree.add(value)
        forest.add()
        if other_rows is None:
            for other in near:
                if forest.join(at, other):
                    yield value, tree.values[other]
    for value in other_rows or ():
        first = None
        for other in tree.within(value, radius):
            if first is None or forest.join(first, other):
                yield value, tree.values[other]
            first = other if first is None else first


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_slices(batches, ["doc_id", "text"]):
        values = np.fromiter((fingerprint(t or "") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def _placed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, ids, texts in text_slices(batches, ["doc_id", "id", "text"]):
        values = np.fromiter((fingerprint(t or "") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(values.view(np.int64))], ["row", "id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def block_choices(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of the choices of blocks - radius blocks."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks with which a bucket of n even fingerprints has BUCKET_ROWS on average."""
    blocks = radius + 1
    while blocks < 12 and n / 2 ** (BITS * (blocks - radius) / blocks) > BUCKET_ROWS:
        blocks += 1
    return blocks


def _bucket_links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (choice, bucket, lhs, rhs, shard, fp) sorted by the first five: the shard lhs is the tree, rhs asks it."""
    found: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        columns = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], ["a", "b"])

    def close(key: tuple, own: list[int], others: list[int]) -> None:
        if len(own) > 1 or others:
            found.extend(links(own, others if key[2] != key[3] else None, radius))

    key, own, others = None, [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for choice, bucket, lhs, rhs, shard, fp in zip(*columns, strict=True):
            now = (choice, bucket, lhs, rhs)
            if now != key:
                if key is not None:
                    close(key, own, others)
                key, own, others = now, [], []
            (own if shard == lhs else others).append(fp & 0xFFFFFFFFFFFFFFFF)
        if len(found) > 50_000:
            yield flush()
    if key is not None:
        close(key, own, others)
    if found:
        yield flush()


def near_links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join all fingerprints of distinct (column fp, n rows) at most radius bits apart."""
    masks = block_choices(blocks_for(n, radius), radius)

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >= 1 << 63 else mask

    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks]))
    buckets = distinct.select("fp", keys.alias("choice", "bucket"))
    crowded = buckets.groupBy("choice", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS)
    crowded = crowded.select("choice", "bucket", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"))
    dealt = buckets.join(materialize(crowded, "crowded"), ["choice", "bucket"], "left")
    shards = F.coalesce("shards", F.lit(1))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("fp"), shards).cast("int")).withColumn("shards", shards)
    meets = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    dealt = dealt.withColumn("other", meets)
    dealt = dealt.select("choice", "bucket", F.least("shard", "other").alias("lhs"), F.greatest("shard", "other").alias("rhs"), "shard", "fp")
    sorted_rows = dealt.repartition("choice", "bucket", "lhs", "rhs").sortWithinPartitions("choice", "bucket", "lhs", "rhs", "shard", "fp")
    return sorted_rows.mapInArrow(lean(partial(_bucket_links, radius)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least id reachable over links) of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return components_of(rows, radius)


def components_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows (doc_id, fp) with component_id."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    known = distinct.count()
    groups = connected_components(materialize(near_links(distinct.select("fp"), known, radius), "links"))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "first", F.col("n").alias("rows"), F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = hub_join(named.select("fp", "rows", "component"), least, "component", known).select("fp", F.col("rows").alias("n"), "component_id")
    return hub_join(rows, materialize(named, "named"), "fp", rows.count())


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs without all but one row of every component: the one with the least id (null ids last), then row.

    Rows are told apart by their place in docs. The numbered rows are written once
    and read for both uses: a second scan may be cut otherwise and number them anew.
    """
    row = fresh(docs, "__row")
    placed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "placed")
    prints = materialize(placed.select(F.col(row).alias("doc_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_placed_fingerprints), "row long, id long, fp long"), "fingerprints")
    found = components_of(prints.select(F.col("row").alias("doc_id"), "fp"), radius)
    named = found.select(F.col("doc_id").alias("row"), "component_id").join(prints.select("row", "id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("first"))
    kept = materialize(first.select(F.col("first.row").alias(row)), "kept")
    # one shuffle of the rows at every size, hashed so that texts aren't sorted: what stays is as long as the table, too long to broadcast
    return placed.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
