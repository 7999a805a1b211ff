"""Operator 1. Repeated passages by paragraph MinHash banding.

A text's lines, lower-cased, are joined to paragraphs of MIN_WORDS words or more;
what is left at a text's end joins its last paragraph, and a text of fewer words
is one paragraph if it holds a shingle. Each has a MinHash signature over its
five-word shingles, cut into bands; the number of bands is the least that finds
pairs at the threshold with the wanted recall. Distinct paragraphs that collide
in a band are candidates: in every bucket the least paragraph stands for it and
meets each of the others, by exact Jaccard similarity of their shingles. In
buckets that this leaves in several components, the members outside the largest
one meet all others, so that every pair of a bucket is compared or already
connected. Links are closed to components. All occurrences of a component's
paragraphs are repeats; the first one stays, the others are removals.

Passages that are no paragraphs, inside them or across them, are found by
`vexel.llm.passages` and reported as runs; texts that are copies of a whole other
text are reported as copies, and everything else looks at the first of them only.

Scale: a task meets the paragraphs of its own block of texts first, so that of a
bucket that all fall into one row for each block is shuffled; no task gathers a
bucket: pairs with the representative are rows, and the rest is compared in parts
of BLOCK_ROWS against PART_ROWS. Texts are read again only for paragraphs that a
bitmap of fixed size lets pass; its false hits cost a row and change nothing.

Edge cases: null and empty texts, and texts without a shingle, have no passages;
a document is a row, so rows with equal or null ids are distinct documents, and a
passage repeated within one text only is no run, though a repeated paragraph is a
repeat anywhere; the first occurrence is the one with the least id (null ids
last), then row and position; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import hub_join, lean, materialize, salted_join, table, text_blocks, text_slices
from vexel.llm.components import connected_components
from vexel.llm.passages import BLOCK_BYTES, PLACE_BITS, SHINGLE, gram_hashes, mix, number_of, place_in, repeated_runs, word_hashes
from vexel.llm.simhash import Forest
from vexel.operators.placement import with_positions

THRESHOLD, RECALL, BAND_ROWS = 0.8, 0.995, 3
MIN_WORDS = 25
#: Members of a bucket outside its largest component that one task holds at once, and members that it compares with them.
BLOCK_ROWS, PART_ROWS = 400, 4000
#: Bits of the bitmap of candidates.
BITMAP_BITS = 1 << 27


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """The least number of bands of `rows` hashes that finds a pair at the threshold with the wanted probability."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def paragraph_words(text: str | None) -> list[tuple[int, list[bytes]]]:
    """(first word's number in the text, words) of every paragraph."""
    out: list[tuple[int, list[bytes]]] = []
    at, block = 0, []
    for line in (text or "").lower().split("\n"):
        block += line.encode().split()
        if len(block) >= MIN_WORDS:
            out.append((at, block))
            at, block = at + len(block), []
    if out:
        out[-1][1].extend(block)
    elif len(block) >= SHINGLE:
        out.append((0, block))
    return out


def paragraph_key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def signatures(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """Band keys (paragraphs x bands). hashes: word hashes of all paragraphs end to end; starts: where each begins."""
    ends = np.append(starts[1:], len(hashes))
    shingle = gram_hashes(hashes, SHINGLE)
    whole = np.ones(len(hashes), bool)
    for k in range(1, SHINGLE):
        whole[ends - k] = False
    shingle = shingle[whole[: len(shingle)]]
    first = starts - (SHINGLE - 1) * np.arange(len(starts))
    rng = np.random.default_rng(1)
    out = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for _ in range(rows):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            key = mix(key + np.minimum.reduceat(shingle * (a | np.uint64(1)) + b, first))
        out[:, band] = key
    return out


def _banded(bands: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as rows (bucket, para, mate): a paragraph that stands for this block of texts in the bucket is its own mate, another one's mate is that one."""
    for (texts,) in text_blocks(batches, ["text"], BLOCK_BYTES):
        found: dict[int, np.ndarray] = {}
        for text in texts:
            for _, own in paragraph_words(text):
                if (key := paragraph_key(own)) not in found:
                    found[key] = word_hashes(own)
        del texts[:]
        if not found:
            continue
        sizes = np.fromiter(map(len, found.values()), np.int64, len(found))
        hashes = np.concatenate(list(found.values()))
        para = np.repeat(np.fromiter(found, np.uint64, len(found)).view(np.int64), bands)
        del found
        bucket = signatures(hashes, np.cumsum(sizes) - sizes, bands).ravel().view(np.int64)
        order = np.lexsort((para, bucket))
        bucket, para = bucket[order], para[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        mate = np.repeat(para[starts], np.diff(np.append(starts, len(bucket))))
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(para), pa.array(mate)], ["bucket", "para", "mate"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _banded, the blocks' representatives of a bucket one after another: the candidate pairs."""
    last, head = None, None
    for batch in batches:
        bucket, para, mate = (np.asarray(batch.column(i)) for i in range(3))
        if not len(bucket):
            continue
        own = para == mate
        near = [np.stack([bucket, para, mate])[:, ~own]]
        bucket, para = bucket[own], para[own]
        if len(bucket):
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            heads = para[starts].copy()
            if bucket[0] == last:
                heads[0] = head
            mate = np.repeat(heads, np.diff(np.append(starts, len(bucket))))
            near.append(np.stack([bucket, para, mate])[:, para != mate])
            last, head = bucket[-1], mate[-1]
        rows = np.concatenate(near, axis=1)
        if rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["bucket", "para", "mate"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, text): the paragraphs of every text that the task has not had."""
    seen: set[int] = set()
    for ts, texts in text_slices(batches, ["t", "text"]):
        rows = []
        for t, text in zip(ts, texts, strict=True):
            if t not in seen:
                seen.add(t)
                rows += [(t, at, len(own), paragraph_key(own)) for at, own in paragraph_words(text)]
        if rows:
            t, at, n, key = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64))], ["t", "start", "n_words", "para"])


def _passing(bitmap, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(para, text) of the paragraphs whose bit is set."""
    words = bitmap.value
    for (texts,) in text_slices(batches, ["text"]):
        found = {}
        for text in texts:
            for _, own in paragraph_words(text):
                key = paragraph_key(own)
                bit = key % BITMAP_BITS
                if int(words[bit >> 5]) >> (bit & 31) & 1:
                    found[key] = b" ".join(own)
        if found:
            keys = np.fromiter(found, np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found.values(), pa.binary())], ["para", "text"])


def shingles(text: bytes) -> frozenset[tuple[bytes, ...]]:
    words = text.split(b" ")
    return frozenset(zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else frozenset([tuple(words)])


def similar(a: frozenset, b: frozenset, threshold: float = THRESHOLD) -> bool:
    """Whether the exact Jaccard similarity reaches the threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = len(a & b)
    return common >= threshold * (len(a) + len(b) - common)


class Asked:
    """Sets of shingles that others are compared with all at once: their common shingles are counted by an index from shingles to sets."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold, self.number, self.sets = threshold, {}, []
        self.starts = None

    def add(self, own: frozenset) -> None:
        self.sets.append(np.fromiter((self.number.setdefault(s, len(self.number)) for s in own), np.int64, len(own)))

    def _close(self) -> None:
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        members = np.concatenate([np.empty(0, np.int64), *self.sets])
        self.holders = np.repeat(np.arange(len(self.sizes)), self.sizes)[np.argsort(members, kind="stable")]
        self.starts = np.append(0, np.cumsum(np.bincount(members, minlength=len(self.number)))).tolist()

    def similar_to(self, own: frozenset) -> list[int]:
        """The numbers of the sets for which similar() holds. No set is added afterwards."""
        if self.starts is None:
            self._close()
        found = [self.holders[self.starts[k] : self.starts[k + 1]] for s in own if (k := self.number.get(s)) is not None]
        if not found:
            return []
        common = np.bincount(np.concatenate(found), minlength=len(self.sizes))
        return np.flatnonzero((common > 0) & (common >= self.threshold * (self.sizes + len(own) - common))).tolist()


def _verify(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (para, mate, text, its mate's text): the pairs that are similar."""
    known = lru_cache(64)(shingles)  # mates come again
    for paras, mates, texts, others in text_slices(batches, ["para", "mate", "text", "other"]):
        held = [(p, m) for p, m, a, b in zip(paras, mates, texts, others, strict=True) if similar(shingles(a), known(b), threshold)]
        if held:
            a, b = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify_rest(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, part, asks, para, component, text), sorted by the first four: the links between those that ask and those that are asked."""
    key, asked, forest, nodes, names, links = None, Asked(threshold), Forest(), {}, [], []

    def node(component: int) -> int:
        if component not in nodes:
            nodes[component] = len(nodes)
            forest.add()
        return nodes[component]

    for batch in batches:
        for bucket, block, part, asks, para, component, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (bucket, block, part) != key:
                key, asked, forest, nodes, names = (bucket, block, part), Asked(threshold), Forest(), {}, []
            own, at = shingles(text), node(component)
            if not asks:
                asked.add(own)
                names.append((at, para))
                continue
            for there, name in (names[k] for k in asked.similar_to(own)):
                if forest.root(at) != forest.root(there):
                    forest.join(at, there)
                    links.append((para, name))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            links = []


def candidate_pairs(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """bucket, para and mate: the members of every bucket of several distinct paragraphs, linked to the member that stands for it."""
    banded = texts.select("text").mapInArrow(lean(partial(_banded, bands_for(threshold))), "bucket long, para long, mate long")
    route = F.when(F.col("para") == F.col("mate"), F.col("bucket")).otherwise(F.xxhash64("para", "bucket"))
    return materialize(banded.repartition(route).sortWithinPartitions("bucket", "para").mapInArrow(lean(_meeting), "bucket long, para long, mate long"), "candidates")


def candidate_texts(texts: DataFrame, paras: DataFrame) -> DataFrame:
    """para and text of the paragraphs in paras."""
    bit = F.pmod(F.col("para"), F.lit(BITMAP_BITS))  # as of the unsigned key, since the bits divide 2 ** 64
    filled = paras.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 31 AS INT))")).alias("bits"))
    found = filled.toArrow()  # 4 million words at most
    bitmap = np.zeros(BITMAP_BITS >> 5, np.uint32)
    bitmap[np.asarray(found["word"])] = np.asarray(found["bits"]).astype(np.uint32)
    passed = texts.select("text").mapInArrow(lean(partial(_passing, texts.sparkSession.sparkContext.broadcast(bitmap))), "para long, text binary")
    return materialize(passed.join(paras, "para", "left_semi").groupBy("para").agg(F.any_value("text").alias("text")), "paragraph-texts")


def _rest_links(pairs: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """The links inside buckets that the components leave in several."""
    members = pairs.select("bucket", "para").union(pairs.select("bucket", F.col("mate").alias("para"))).distinct()
    members = members.join(groups, members["para"] == groups["node"], "left").select("bucket", "para", F.coalesce("component", "para").alias("component"))
    members = materialize(members, "members")
    sized = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sized = sized.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("core"), F.sum("n").alias("n")).where("n > core.n")
    split = materialize(sized.select("bucket", F.col("core.component").alias("core"), F.ceil((F.col("n") - F.col("core.n")) / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), "split")
    if split.isEmpty():
        return None
    dealt = members.join(split, "bucket")
    block, part = F.pmod(F.xxhash64("para"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("para"), F.col("parts")).cast("int")
    asked = dealt.where("component <> core").select("bucket", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "para", "component")
    asking = dealt.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(True).alias("asks"), "para", "component")
    rows = asked.union(asking).join(texts, "para").select("bucket", "block", "part", "asks", "para", "component", "text")
    return rows.repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "asks", "para").mapInArrow(lean(partial(_verify_rest, threshold)), "a long, b long")


def paragraph_classes(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node and component of distinct paragraphs that are linked to others."""
    pairs = candidate_pairs(texts, threshold)
    paras = pairs.select("para").union(pairs.select("mate")).distinct()
    held = candidate_texts(texts, paras)
    near = materialize(pairs.select("para", "mate").distinct(), "pairs")
    met = salted_join(near.join(held, "para"), held.select(F.col("para").alias("mate"), F.col("text").alias("other")), "mate", "para", near.count())
    links = materialize(met.select("para", "mate", "text", "other").mapInArrow(lean(partial(_verify, threshold)), "a long, b long"), "links")
    groups = connected_components(links)
    rest = _rest_links(pairs, groups, held, threshold)
    return groups if rest is None else connected_components(groups.toDF("a", "b").union(materialize(rest, "links")))


def paragraphs_of(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """at, n_words and para of every paragraph; texts: t, text."""
    found = texts.mapInArrow(lean(_lines), "t long, start int, n_words int, para long").groupBy("t", "start").agg(F.any_value("n_words").alias("n_words"), F.any_value("para").alias("para"))
    at = F.shiftleft("no", PLACE_BITS) + F.col("start")
    return materialize(found.join(numbers.select("t", "no"), "t").select(at.alias("at"), "n_words", "para"), "paragraphs")


def repeated_paragraphs(texts: DataFrame, own: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """no, start, n_words, class_id and kept of every paragraph of own that repeats."""
    groups = paragraph_classes(texts, threshold)
    counted = own.groupBy("para").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    named = counted.join(groups, counted["para"] == groups["node"], "left").where("n > 1 OR component IS NOT NULL")
    named = materialize(named.select("para", "n", "first", F.coalesce("component", "para").alias("class_id")), "named")
    first = named.groupBy("class_id").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    classes = materialize(hub_join(named.select("para", F.col("n").alias("uses"), "class_id"), first, "class_id", named.count()).withColumnRenamed("uses", "n"), "classes")
    met = hub_join(own, classes, "para", own.count())
    return met.select(number_of("at").alias("no"), place_in("at").cast("int").alias("start"), "n_words", "class_id", (F.col("at") == F.col("first")).alias("kept"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Repeated passages: row, doc_id, first word's number, words, class_id, kept (false: to be removed) and kind."""
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text")).where(F.octet_length("text") > 0)
    rows = docs.where(F.octet_length(text_col) > 0).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"))
    rows = materialize(rows, "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("least")
    firsts = rows.groupBy("t").agg(least, F.count("*").alias("n")).select("t", "n", "least.*")
    numbers = materialize(with_positions(firsts, ["null", "doc_id", "row"], "no"), "numbers")
    own = paragraphs_of(texts, numbers)

    words = own.groupBy(number_of("at").alias("no")).agg(F.sum("n_words").cast("int").alias("n_words"))  # paragraphs hold all words
    several = numbers.where("n > 1").join(words, "no").select("t", "n", F.col("row").alias("least"), "n_words")
    copied = hub_join(rows, several, "t", rows.count())
    copies = copied.select("row", "doc_id", F.lit(0).alias("start"), "n_words", F.col("t").alias("class_id"), (F.col("row") == F.col("least")).alias("kept"), F.lit("copy").alias("kind"))

    def placed(found: DataFrame, kind: str) -> DataFrame:
        return found.join(numbers.select("no", "row", "doc_id"), "no").select("row", "doc_id", "start", "n_words", "class_id", "kept", F.lit(kind).alias("kind"))

    return placed(repeated_paragraphs(texts, own, threshold), "paragraph").union(placed(repeated_runs(texts, numbers), "run")).union(copies)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word's number, words); lines that lose all their words go."""
    gone = {i for start, n in spans for i in range(start, start + n)}
    out, at = [], 0
    for line in text.split("\n"):
        words = line.split()
        keep = [w for i, w in enumerate(words, at) if i not in gone]
        if keep or not words:
            out.append(line if len(keep) == len(words) else " ".join(keep))
        at += len(words)
    return "\n".join(out)


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents")).drop("row")
