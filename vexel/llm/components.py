"""Connected components by alternating large-star and small-star rounds.

Edges are pairs of longs. Each round is one grouping for each star, whose
neighbourhood minimum is aggregated before the shuffle. A node with very many
neighbours, as the stars themselves make, gets its minimum by broadcast
(`hub_join`), so no task gathers a node's neighbours. Between rounds every task
replaces the edges that it holds, in blocks of BLOCK_EDGES, by stars with the same
components. Edges that are one block at most, at first or after a round, are closed
by one task, in however many tasks they lie; only more of them take rounds. A
round's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import hub_join, lean, materialize

#: Edges that a task turns into stars together: 8 MB.
BLOCK_EDGES = 500_000


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of the edges (a, b) to the least node of its component, but for that node itself."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        low = np.minimum(rx, ry)[apart]
        np.minimum.at(root, np.maximum(rx, ry)[apart], low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _stars(batches: Iterator[pa.RecordBatch], block: int | None = None) -> Iterator[pa.RecordBatch]:
    """star_forest of every block of edges; up to `block` of them (BLOCK_EDGES) are one block."""
    block = block or BLOCK_EDGES

    def close() -> pa.RecordBatch:
        found = star_forest(*(np.concatenate([part[i] for part in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append([np.asarray(batch.column(i)) for i in (0, 1)])
        n += batch.num_rows
        if n >= block:
            yield close()
            held, n = [], 0
    if n:
        yield close()


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(lean(partial(_stars, block=BLOCK_EDGES)), "a long, b long")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its larger neighbours to the least node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return hub_join(both, least, "a", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = hub_join(edges, least, "a", n)
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node of an edge. edges: two long columns, in any order, loops and repeats allowed.

    Edges that Python makes are best written first: a task would run that Python and
    this one's side by side, and the executor keep a worker for each.

    Edge cases: edges with a null end are ignored; no edges give no rows.
    """
    a, b = edges.columns
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = materialize(_contracted(_contracted(known).distinct()), "edges")
    before = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        if now[0] <= BLOCK_EDGES:
            current = materialize(_contracted(current.coalesce(1)), "edges")
            break
        current = materialize(_contracted(_small_star(_large_star(current, now[0]), now[0])), "edges")
    # a star forest: every edge runs from a node to its component's least node
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
