"""Passages that stand in several texts, at any place, exact to the word.

The words of a text, lines ignored, are cut at anchors: the five-word shingles
that are the least of a window of MIN_RUN words. Two texts that share a passage
have the same anchors in it, but for its first and last REACH words, and so the
same pieces between neighbouring anchors; a passage of MIN_RUN + REACH + 1 = 26
words or more holds a piece wherever it stands. A piece is shared if two
different texts have it. Of every shared piece the first occurrence is known.
Neighbouring shared pieces of a text are a run; at both ends of a run the text is
compared word by word with that of the end piece's first occurrence, REACH words
at most, since any longer common end would hold a piece. So runs are exact to the
word against first occurrences; up to REACH words at an end that only later texts
share are left out. Equal texts and pieces are told by 64-bit hashes.

Scale: a task meets the pieces of its own block of texts first, so that of a
piece that stands everywhere one row for each block is shuffled; what follows
concerns shared pieces only and is aggregated or joined, never gathered by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import hub_join, lean, materialize, text_blocks, text_slices
from vexel.llm.components import connected_components

SHINGLE, MIN_RUN = 5, 15
REACH = MIN_RUN - SHINGLE
#: A text's number and a word's place in one long.
PLACE_BITS = 31
#: Bytes of text whose pieces a task compares before they are shuffled.
BLOCK_BYTES = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every `size` neighbouring words."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        out = mix(out + hashes[k : k + len(out)])
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _sliding(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every REACH + 1 neighbours."""
    size = 1
    while 2 * size <= REACH + 1:
        x, size = pick(x[:-size], x[size:]), 2 * size
    rest = REACH + 1 - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors_of(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Places of the shingles that are the least of a window of MIN_RUN words within one text; of a shingle repeated place by place every REACH + 1st and the last."""
    n = len(hashes) - MIN_RUN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    grams = gram_hashes(hashes, SHINGLE)
    least = _sliding(grams, np.minimum)
    least[text_of[:n] != text_of[MIN_RUN - 1 :]] = 0
    pad = np.zeros(REACH, np.uint64)
    greatest = _sliding(np.concatenate([pad, least, pad]), np.maximum)  # of the windows that hold a shingle
    place = np.flatnonzero((greatest == grams) & (greatest > 0))
    if len(place) < 3:
        return place
    same = (np.diff(place) == 1) & (grams[place[1:]] == grams[place[:-1]])
    first = np.append(True, ~same)
    number = np.arange(len(place)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return place[(number % (REACH + 1) == 0) | np.append(first[1:], True)]


def pieces_of(hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, lengths and hashes of the pieces: from an anchor to the end of the next one of its text."""
    place = anchors_of(hashes, text_of)
    follows = text_of[place[1:]] == text_of[place[:-1]]
    begin = place[:-1][follows]
    length = place[1:][follows] + SHINGLE - begin
    # differences of one polynomial's running sums, moved to power 0
    powers = np.full(len(hashes), _ODD)
    powers[:1] = 1
    np.cumprod(powers, out=powers)
    powers *= hashes
    sums = np.append(np.uint64(0), np.cumsum(powers, out=powers))
    powers[:] = _INVERSE
    powers[:1] = 1
    key = (sums[begin + length] - sums[begin]) * np.cumprod(powers, out=powers)[begin]
    return begin, length, mix(key + length.astype(np.uint64))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, text) as pieces (key, t, code): place, length and state in a code.

    State 0: seen in one text of this block; 1 and 2: in several, 1 for one
    occurrence, which stands for the block where blocks are compared, 2 for the others.
    """
    seen: set[int] = set()
    for ts, texts in text_blocks(batches, ["t", "text"], BLOCK_BYTES):
        found, own = [], []
        for t, text in zip(ts, texts, strict=True):
            if t in seen or not text:
                continue
            seen.add(t)
            found.append(word_hashes(words_of(text)))
            own.append(t)
        del texts[:]
        if sum(map(len, found)) < MIN_RUN:
            continue
        hashes, lengths = np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        del found
        begins = np.cumsum(lengths) - lengths
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        begin, length, key = pieces_of(hashes, text_of)
        if not len(begin):
            continue
        owner = text_of[begin]
        order = np.argsort(key, kind="stable")
        begin, length, key, owner = begin[order], length[order], key[order], owner[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        state = 2 * np.repeat(several, np.diff(np.append(starts, len(key)))).astype(np.int64)
        state[starts[several]] = 1
        code = ((begin - begins[owner]) << 8) | (length << 2) | state
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.array(own, np.int64)[owner]), pa.array(code)], ["key", "t", "code"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _pieces, those of a key one after another: (t, code, key) of pieces that several texts have."""
    held = np.empty((3, 0), np.int64)
    known = None  # the last key of the batch before, where it is known to be shared
    for batch in batches:
        rows = np.concatenate([held, np.stack([np.asarray(batch.column(i)) for i in range(3)])], axis=1)
        if not rows.shape[1]:
            continue
        key, t, code = rows
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = (np.minimum.reduceat(t, starts) != np.maximum.reduceat(t, starts)) | (np.bitwise_or.reduceat((code & 3).astype(np.int64), starts) > 0)
        several[0] |= known is not None and key[0] == known
        hit = np.repeat(several, np.diff(np.append(starts, len(key))))
        # a last group that is not known to be shared is of one text, and waits for the next batch
        held = np.empty((3, 0), np.int64) if several[-1] else rows[:, starts[-1] :]
        known = key[-1] if several[-1] else None
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[hit]), pa.array(code[hit] >> 2), pa.array(key[hit])], ["t", "code", "key"])


def regions_of(at: np.ndarray, length: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Of the pieces of whole texts, in order: the columns of REGIONS: regions (run and end), their parts that stand earlier too (at is set), links (first is set)."""
    end = at + length
    begins = np.append(True, at[1:] != end[:-1] - SHINGLE)
    heads, tails = np.flatnonzero(begins), np.flatnonzero(np.append(begins[1:], True))
    region = np.cumsum(begins) - 1
    run = at[heads]
    own = np.flatnonzero(at != first)
    opens = np.append(True, at[own][1:] > end[own][:-1])[: len(own)]
    part_heads, part_tails = own[opens], own[np.append(opens[1:], True)[: len(own)]]
    # of every region and text of first occurrences one piece
    _, once = np.unique(np.stack([region[own], first[own] >> PLACE_BITS]), axis=1, return_index=True)
    once = own[once]
    sizes = (len(run), len(part_heads), len(once))

    def column(*parts: np.ndarray | None) -> pa.Array:
        return pa.concat_arrays([pa.nulls(n, pa.int64()) if part is None else pa.array(part) for n, part in zip(sizes, parts, strict=True)])

    return [
        column(run, run[region[part_heads]], run[region[once]]), column(None, at[part_heads], None), column(end[tails], end[part_tails], None),
        column(None, first[part_heads], None), column(None, (first + length)[part_tails], None), column(None, None, first[once]),
    ]


REGIONS = "run long, at long, end long, left long, right long, first long"


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, length, first), those of a text one after another in order: its regions, their parts and their links."""
    names = [f.split()[0] for f in REGIONS.split(", ")]
    rest = np.empty((3, 0), np.int64)

    def made(rows: np.ndarray) -> pa.RecordBatch:
        at, length, first = rows[:, np.append(True, rows[0, 1:] != rows[0, :-1])]  # a copy of the text in another task may repeat a piece
        return pa.RecordBatch.from_arrays(regions_of(at, length, first), names)

    for batch in batches:
        rows = np.concatenate([rest, np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])], axis=1)
        if not rows.shape[1]:
            continue
        whole = int(np.searchsorted(rows[0] >> PLACE_BITS, rows[0, -1] >> PLACE_BITS))  # the last text may go on
        rest = rows[:, whole:]
        if whole:
            yield made(rows[:, :whole])
    if rest.shape[1]:
        yield made(rest)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, asker) in order, asker -1: a run begins there: (asker, the run that holds its place)."""
    last = -1
    for batch in batches:
        at, asker = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(at):
            continue
        run = np.maximum.accumulate(np.where(asker < 0, at, -1))
        run = np.where(run < 0, last, run)
        last = run[-1]
        asks = asker >= 0
        yield pa.RecordBatch.from_arrays([pa.array(asker[asks]), pa.array(run[asks])], ["a", "b"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, text) without those whose t the task has had."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for t in batch.column(0).to_pylist():
            new.append(t not in seen)
            seen.add(t)
        yield batch if all(new) else batch.filter(pa.array(new))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, before, after: numbered places): the REACH words before a place, the nearest first, and from a place on."""
    for texts, before, after in text_slices(batches, ["text", "before", "after"]):
        at, back, near = [], [], []
        for text, fore, aft in zip(texts, before, after, strict=True):
            words = [w.decode() for w in words_of(text)]
            for number in fore:
                place = number & ((1 << PLACE_BITS) - 1)
                near.append(words[max(0, place - REACH) : place][::-1])
            for number in aft:
                place = number & ((1 << PLACE_BITS) - 1)
                near.append(words[place : place + REACH])
            at += [*fore, *aft]
            back += [True] * len(fore) + [False] * len(aft)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(back, pa.bool_()), pa.array(near, pa.list_(pa.string()))], ["at", "back", "near"])


def number_of(place: str) -> Column:
    return F.shiftright(place, PLACE_BITS)


def place_in(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _common(one: str, two: str) -> Column:
    """The length of the longest common beginning of two arrays (null: none)."""
    return F.coalesce(F.expr(f"array_max(filter(sequence(0, least(size({one}), size({two}))), i -> slice({one}, 1, i) = slice({two}, 1, i)))"), F.lit(0))


def shared_pieces(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """at, length and first (the first occurrence) of every piece that several texts have. texts: t, text; numbers: t and no, one row for each text."""
    cut = texts.mapInArrow(lean(_pieces), "key long, t long, code long")
    route = F.when(F.col("code").bitwiseAND(F.lit(3)) == 2, F.xxhash64("t", "code")).otherwise(F.col("key"))
    hits = cut.repartition(route).sortWithinPartitions("key", "t").mapInArrow(lean(_shared), "t long, code long, key long")
    at = F.shiftleft("no", PLACE_BITS) + F.shiftright("code", 6)
    found = hits.join(numbers.select("t", "no"), "t").select(at.alias("at"), F.col("code").bitwiseAND(F.lit(63)).cast("int").alias("length"), "key")
    found = materialize(found, "pieces")
    firsts = found.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return hub_join(found, firsts, "key", found.count()).select("at", "length", "first")


def grown_parts(parts: DataFrame, texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """at, back, other and grown: by how many words the parts (at, end, left, right) agree with their partners beyond their begin (back) and end."""

    def edge(own: str, other: str, back: bool) -> Column:
        return F.struct(F.col(own).alias("own"), F.col(other).alias("other"), F.lit(back).alias("back"))

    ends = parts.select(F.col("at").alias("part"), F.explode(F.array(edge("at", "left", True), edge("end", "right", False))).alias("e")).select("part", "e.*")
    sides = ends.select("part", "back", "other", F.explode(F.array(F.struct(F.col("own").alias("at"), F.lit(True).alias("mine")), F.struct(F.col("other").alias("at"), F.lit(False).alias("mine")))).alias("e"))
    asked = materialize(sides.select("part", "back", "other", "e.*"), "ends")
    counts = asked.groupBy("at", "back").agg(F.count("*").alias("n"))
    wanted = counts.withColumn("no", number_of("at")).join(numbers.select("no", "t"), "no")
    wanted = wanted.groupBy("t").agg(F.collect_list(F.when(F.col("back"), F.col("at"))).alias("before"), F.collect_list(F.when(~F.col("back"), F.col("at"))).alias("after"))
    said = texts.mapInArrow(lean(_once), "t long, text string").join(wanted, "t").select("text", "before", "after").mapInArrow(lean(_contexts), "at long, back boolean, near array<string>")
    said = materialize(said.groupBy("at", "back").agg(F.any_value("near").alias("near")).join(counts, ["at", "back"]), "contexts")
    met = hub_join(asked, said, ["at", "back"], asked.count()).groupBy("part", "back", "other")
    met = met.agg(F.max(F.when(F.col("mine"), F.col("near"))).alias("one"), F.max(F.when(~F.col("mine"), F.col("near"))).alias("two"))
    return materialize(met.select("part", "back", "other", _common("one", "two").alias("grown")), "grown")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, part, begin, end), those of a text one after another, regions (part null) before their parts: runs, cut where kept changes, without overlap."""
    text, region, parts, done, out = None, None, [], 0, []

    def close() -> None:
        nonlocal done
        if region is None:
            return
        run, begin, end = region
        begin, end = max(done, min([begin, *(b for b, _ in parts)])), max([end, *(e for _, e in parts)])
        if end - begin < MIN_RUN:
            return
        at = begin
        for low, high in sorted(parts):
            low, high = max(low, at), min(high, end)
            if low < high:
                if at < low:
                    out.append((run, at, low, True))
                if out and out[-1][0] == run and not out[-1][3] and out[-1][2] == low:
                    low = out.pop()[1]
                out.append((run, low, high, False))
                at = high
        if at < end:
            out.append((run, at, end, True))
        done = end

    def batch_of() -> pa.RecordBatch:
        run, begin, end, kept = zip(*out, strict=True)
        out.clear()
        low = (1 << PLACE_BITS) - 1
        return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array([b & low for b in begin], pa.int32()), pa.array([e - b for b, e in zip(begin, end, strict=True)], pa.int32()), pa.array(kept)], ["run", "start", "n_words", "kept"])

    for batch in batches:
        for run, part, begin, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part is None:
                close()
                if run >> PLACE_BITS != text:
                    text, done = run >> PLACE_BITS, 0
                region, parts = (run, begin, end), []
            else:
                parts.append((begin, end))
        if len(out) > 1:
            last = out.pop()  # a part that follows may join it
            yield batch_of()
            out.append(last)
    close()
    if out:
        yield batch_of()


def repeated_runs(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """no, start, n_words, class_id and kept of the runs of words that several texts share, cut where kept changes.

    A word is kept where no earlier occurrence is known, and else has an equal word
    at an earlier place, which is kept or has one itself; so of every passage one
    copy stays. A run and the runs of its pieces' first occurrences are one class,
    closed to components. Runs of fewer than MIN_RUN words are left out.
    """
    met = shared_pieces(texts, numbers)
    found = materialize(met.repartition(number_of("at")).sortWithinPartitions("at").mapInArrow(lean(_regions), REGIONS), "regions")
    regions, parts = found.where("at IS NULL AND end IS NOT NULL").select("run", "end"), found.where("at IS NOT NULL").select("run", "at", "end", "left", "right")
    asking = found.where("first IS NOT NULL").select(F.col("first").alias("at"), F.col("run").alias("asker"))
    rows = asking.union(regions.select(F.col("run").alias("at"), F.lit(-1).cast("long").alias("asker")))
    groups = connected_components(materialize(rows.repartition(number_of("at")).sortWithinPartitions("at", "asker").mapInArrow(lean(_linked), "a long, b long"), "links"))

    grown = grown_parts(parts, texts, numbers)
    sides = grown.groupBy("part").agg(F.max(F.when(F.col("back"), F.col("grown"))).alias("fore"), F.max(F.when(~F.col("back"), F.col("grown"))).alias("aft"))
    removed = parts.join(sides, parts["at"] == sides["part"]).select("run", "part", (F.col("at") - F.col("fore")).alias("begin"), (F.col("end") + F.col("aft")).alias("end"))
    # a first occurrence at a region's edge grows as far as the copy that grows furthest
    there = grown.groupBy("other", "back").agg(F.max("grown").alias("grown"))
    fore, aft = there.where("back").select(F.col("other").alias("run"), F.col("grown").alias("fore")), there.where("NOT back").select(F.col("other").alias("end"), F.col("grown").alias("aft"))
    whole = regions.join(fore, "run", "left").join(aft, "end", "left")
    whole = whole.select("run", F.lit(None).cast("long").alias("part"), (F.col("run") - F.coalesce("fore", F.lit(0))).alias("begin"), (F.col("end") + F.coalesce("aft", F.lit(0))).alias("end"))
    dealt = whole.union(removed).repartition(number_of("run")).sortWithinPartitions("run", "part")
    placed = dealt.mapInArrow(lean(_assembled), "run long, start int, n_words int, kept boolean")
    named = placed.join(groups, placed["run"] == groups["node"], "left")
    return named.select(number_of("run").alias("no"), "start", "n_words", F.coalesce("component", "run").alias("class_id"), "kept")
