"""Operator 3. Main text of pages by a host's suffix array.

The pages of a host are token streams: for every block its element and role,
then its words. The streams of a host, or of a bounded part of a large host,
are concatenated with a separator of its own after each page, and their suffixes
are sorted to a depth of RUN tokens by prefix doubling. Neighbours in that order
that agree on RUN tokens and stem from distinct pages are repeated substrings;
all positions under them are covered. Parts of a large host exchange the hashes of
their windows of RUN tokens, those inside marked blocks too where another part
leaves the same words open, so that a substring that two parts have once each is
covered in both, as in a host that is not cut.

A block that is covered by half is a host's boilerplate, the rest are the
page's unique runs. An exact check by the page's own markup follows, since
repetition alone can't tell a menu from an article that two pages share: blocks in
an article or main element stay even where other pages repeat them; blocks in
menus, headers, footers, asides, forms, adverts, notices and comments go even on a
host's only page. Blocks about which the markup says nothing, beside articles as
well, are the array's to decide.

Edge cases: null or empty html, and pages that hold only boilerplate, give an
empty text; a null url is a host of its own; null ids are kept; repeated rows
give repeated rows, but a page's exact twin on the same host also makes its
unmarked blocks repeated; other columns are ignored. A page is a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import materialize, table
from vexel.llm.html_blocks import BOILERPLATE, CONTENT, NEUTRAL, TextBlock, blocks_of
from vexel.llm.passages import gram_hashes, word_hashes

#: Tokens of a repeated substring (a power of two), and the covered share from which a block is boilerplate.
RUN, COVERED = 8, 0.5
#: Bytes of html whose suffixes one task sorts at once: a larger host is cut into parts of this size.
PART_BYTES = 1 << 20
#: Hosts larger than that which are broadcast at most.
BROADCAST_HOSTS = 100_000

SCHEMA = "page_id long, url string, text string, n_chars long"
WINDOWS = "host string, part int, window long"


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` tokens (a power of two), and each suffix's rank, equal where these tokens agree."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        step *= 2
    return order, rank


def repeated_positions(tokens: np.ndarray, page_of: np.ndarray, run: int = RUN) -> np.ndarray:
    """True at tokens under a substring of `run` tokens that stands in at least two pages. Negative tokens match nothing."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    order, rank = suffix_order(tokens, run)
    ordered, pages = rank[order], page_of[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    several = np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts)
    shared = np.zeros(n, bool)
    shared[order] = np.repeat(several, np.diff(np.append(starts, n)))
    # a window that meets a page's end is unique by that page's separator
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(shared)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + run, n), -1)
    return np.cumsum(change[:-1]) > 0


def token_stream(blocks: list[TextBlock]) -> tuple[list[str], list[tuple[int, int]]]:
    """A page's tokens, and where each block's begin and end."""
    tokens, spans = [], []
    for block in blocks:
        start = len(tokens)
        tokens.append(f"<{block.element} {block.role}>")
        tokens += block.text.split(" ")
        spans.append((start, len(tokens)))
    return tokens, spans


def window_hashes(tokens: list[str], run: int = RUN) -> np.ndarray:
    """The hash of every `run` neighbouring tokens."""
    return gram_hashes(word_hashes([t.encode() for t in tokens]), run).view(np.int64)


def main_texts(pages: list[list[TextBlock]], run: int = RUN, known: np.ndarray | None = None) -> list[str]:
    """The main text of each page of one host. known: hashes of windows that other parts of the host have."""
    vocabulary: dict[str, int] = {}
    tokens: list[int] = []
    page_of: list[int] = []
    spans: list[list[tuple[int, int]]] = []
    elsewhere: list[int] = []
    for p, blocks in enumerate(pages):
        words, own = token_stream(blocks)
        at = len(tokens)
        if known is not None and len(known):
            elsewhere += (at + np.flatnonzero(np.isin(window_hashes(words, run), known))).tolist()
        tokens.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        spans.append([(at + s, at + e) for s, e in own])
        tokens.append(-1 - p)
        page_of.extend([p] * (len(tokens) - len(page_of)))
    covered = repeated_positions(np.array(tokens, np.int64), np.array(page_of, np.int64), run) if len(pages) > 1 else np.zeros(len(tokens), bool)
    for at in elsewhere:
        covered[at : at + run] = True
    below = np.append(0, np.cumsum(covered))
    out = []
    for blocks, own in zip(pages, spans, strict=True):
        kept = []
        for block, (start, end) in zip(blocks, own, strict=True):
            repeated = below[end] - below[start] >= COVERED * (end - start)
            # the exact check by markup: the article stays whole, marked boilerplate goes
            if block.role == CONTENT or block.role != BOILERPLATE and not repeated:
                kept.append(block.text)
        out.append("\n".join(kept))
    return out


def _windows(open_: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, html) as windows of RUN tokens, each once for a host's part in a batch: those that meet a block that the markup leaves open, or the others."""
    for batch in batches:
        found: dict[tuple[str, int], list[np.ndarray]] = {}
        for host, part, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            blocks = blocks_of(page or "")
            if open_ and all(b.role != NEUTRAL for b in blocks):
                continue
            tokens, spans = token_stream(blocks)
            near = np.zeros(len(tokens), bool)
            for block, (start, end) in zip(blocks, spans, strict=True):
                if block.role == NEUTRAL:
                    near[max(0, start - RUN + 1) : end] = True
            hashes = window_hashes(tokens)
            found.setdefault((host, part), []).append(hashes[near[: len(hashes)] == open_])
        for (host, part), hashes in found.items():
            own = np.unique(np.concatenate(hashes))
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(own), pa.string()), pa.array([part] * len(own), pa.int32()), pa.array(own)], ["host", "part", "window"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, page_id, url, html, windows), those of a host's part one after another, that with windows first."""
    key, rows, pages, known = None, [], [], None

    def close() -> pa.RecordBatch:
        texts = main_texts(pages, known=known)
        ids, urls = zip(*rows, strict=True)
        rows.clear()
        pages.clear()
        columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    for batch in batches:
        for i in range(batch.num_rows):
            now = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if now != key:
                if rows:
                    yield close()
                key, known = now, None
            if batch.column(5)[i].is_valid:
                known = np.asarray(batch.column(5)[i].values)
            else:
                rows.append((batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                pages.append(blocks_of(batch.column(4)[i].as_py() or ""))
    if rows:
        yield close()


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(host.alias("host"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    sizes = rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > PART_BYTES)
    large = materialize(sizes.select("host", F.ceil(F.col("bytes") / PART_BYTES).cast("int").alias("parts")), "hosts")
    few = large.count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(large) if few else large, "host", "left")
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = dealt.select("host", part.alias("part"), F.col("parts").isNotNull().alias("cut"), "page_id", "url", "html")
    # windows of open blocks that other parts of the host have too, in blocks of any role, given to each part that has them open
    cut = dealt.where("cut").select("host", "part", "html")
    opened = materialize(cut.mapInArrow(partial(_windows, True), WINDOWS).distinct(), "windows")
    hosts = opened.select("host").distinct()
    others = cut.join(F.broadcast(hosts) if few else hosts, "host", "left_semi").mapInArrow(partial(_windows, False), WINDOWS)
    others = others.join(opened.select("host", "window").distinct(), ["host", "window"], "left_semi").select("host", "part", "window")
    several = opened.union(others).distinct().groupBy("host", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    known = opened.join(several, ["host", "window"], "left_semi").groupBy("host", "part").agg(F.collect_list("window").alias("windows"))
    none = F.lit(None)
    known = known.select("host", "part", none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("html"), "windows")
    rows = dealt.select("host", "part", "page_id", "url", "html", none.cast("array<long>").alias("windows")).union(known)
    return rows.repartition("host", "part").sortWithinPartitions("host", "part", F.col("windows").isNull()).mapInArrow(_extract, SCHEMA)


def op3_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
