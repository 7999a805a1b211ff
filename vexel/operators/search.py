"""Nearest neighbours: exact and int8 top-k for one query, and batches of queries.

Filters and column pruning reach the scan, and the top-k is taken in each
partition before rows move. One query is scored by column expressions, or, on
large tables, like batches of queries by matrix products over tiles of Arrow
batches; a task hands on its own k best only, and queries travel in blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import vectors as V

#: Bytes of query vectors, with their k best, in one broadcast block.
QUERY_BLOCK_BYTES = 8 << 20
#: Bytes of scores, or of vectors to be scored exactly, that a task holds at once; rows in a tile of scores.
TILE_BYTES, TILE_ROWS = 4 << 20, 1024
#: Fixed value: more than a matrix product of unit vectors differs from the exact score.
_MARGIN = 1e-9

COSINE, INT8 = "cosine", "int8"
EXPRESSION, ARROW = "expression", "arrow"


def scored(rows: DataFrame, query: Sequence[float], vector_col: str = "embedding", metric: str = COSINE, score_col: str = "score") -> DataFrame:
    """rows with the similarity (cosine, higher is nearer) or the distance (int8, lower is nearer) to the query."""
    vector, own = F.col(vector_col), V.literal(query)
    if metric == INT8:
        return rows.withColumn(score_col, V.int8_distance(V.quantize_int8(vector), V.quantize_int8(own)))
    if metric != COSINE:
        raise ValueError(f"unknown metric {metric!r}")
    norm = float(np.linalg.norm(np.asarray(query, np.float32).astype(np.float64)))
    return rows.withColumn(score_col, F.coalesce(F.try_divide(V.dot(vector, own), V.l2_norm(vector) * F.lit(norm)), F.lit(0.0)))


def best_first(metric: str, score_col: str = "score") -> Column:
    """Order of results; NaN scores last."""
    score = F.when(F.isnan(score_col), F.lit(None)).otherwise(F.col(score_col))
    return score.asc_nulls_last() if metric == INT8 else score.desc_nulls_last()


def top_k(rows: DataFrame, query: Sequence[float], k: int = 5, where: Column | None = None, vector_col: str = "embedding", tie_col: str = "row_num", metric: str = COSINE, kernel: str = EXPRESSION) -> DataFrame:
    """The k nearest of the rows that qualify, nearest first, with score and rank (from 0). Filters come before the ranking, so k rows come back whenever k qualify.

    kernel: "expression" scores by column functions, without Python; "arrow" by a
    matrix product over Arrow batches, which costs a worker's start and pays on
    large tables. It needs a unique long in tie_col: only that column and the
    vectors are read for the ranking, and the k rows are looked up afterwards.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    qualifying = rows if where is None else rows.where(where)
    if kernel == ARROW and metric == COSINE:
        own = qualifying.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid long, q array<float>")
        found = batch_top_k(qualifying, own, k, tie_col, "qid", vector_col, "q")
        # k rows: a proven bound for the broadcast
        best = rows.join(F.broadcast(found.select(tie_col, "score").orderBy(best_first(metric), F.asc(tie_col)).limit(k)), tie_col)
    elif kernel in (EXPRESSION, ARROW):
        best = scored(qualifying, query, vector_col, metric).orderBy(best_first(metric), F.asc(tie_col)).limit(k)
    else:
        raise ValueError(f"unknown kernel {kernel!r}")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(best_first(metric), F.asc(tie_col))) - 1)


def query_blocks(queries: DataFrame, id_col: str, vector_col: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and vectors in blocks of bounded size, read a partition at a time."""
    ids, rows, held = [], [], 0
    for row in queries.select(id_col, vector_col).toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        held += 8 * len(row[1]) + 16 * k
        if held >= QUERY_BLOCK_BYTES:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows, held = [], [], 0
    if rows:
        yield np.array(ids), np.array(rows, np.float64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first element to the last, so that equal vectors have equal ones wherever they stand."""
    return np.cumsum(a * b, axis=1)[:, -1]


class _Best:
    """Of some queries the k best rows so far: by cosine, as SQL computes it (NaN first, as Spark sorts), and ties by id."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k, self.seen = queries, k, 0
        self.unit, self.squares = _unit(queries), _dots(queries, queries)
        self.scores, self.ids = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Tiles of approximate scores leave the pairs to be scored exactly."""
        unit, squares, n = _unit(rows), _dots(rows, rows), len(rows)
        self.seen += n
        step = max(1, TILE_BYTES // (8 * n))
        for low in range(0, len(self.queries), step):
            near = self.unit[low : low + step] @ unit.T
            least = self.scores[low : low + step, -1] - _MARGIN
            open_ = ~(near < least[:, None])
            if n > self.k and open_.sum() > 4 * self.k * len(near):
                least = np.fmax(least, np.partition(near, n - self.k, axis=1)[:, n - self.k] - _MARGIN)
                open_ = ~(near < least[:, None])
            own, at = np.nonzero(open_)
            if len(own):
                self._merge(own + low, ids[at], self._exact(own + low, at, rows, squares))

    def _exact(self, own: np.ndarray, at: np.ndarray, rows: np.ndarray, squares: np.ndarray) -> np.ndarray:
        out, step = np.zeros(len(own)), max(1, TILE_BYTES // (8 * rows.shape[1]))
        for low in range(0, len(own), step):
            q, r = own[low : low + step], at[low : low + step]
            norms = np.sqrt(self.squares[q] * squares[r])
            np.divide(_dots(self.queries[q], rows[r]), norms, out=out[low : low + step], where=norms > 0)
        return np.clip(out, -1.0, 1.0)

    def _merge(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        met = np.unique(own)
        own = np.concatenate([own, np.repeat(met, self.k)])
        ids, scores = np.concatenate([ids, self.ids[met].ravel()]), np.concatenate([scores, self.scores[met].ravel()])
        order = np.lexsort((ids, np.where(np.isnan(scores), -np.inf, -scores), own))
        own = own[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        kept = rank < self.k
        self.ids[own[kept], rank[kept]], self.scores[own[kept], rank[kept]] = ids[order][kept], scores[order][kept]


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", query_col: str = "qid", vector_col: str = "embedding", query_vector_col: str | None = None) -> DataFrame:
    """query_col, id, score and rank (from 0) of each query's k nearest rows by cosine."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = rows.sparkSession
    schema = f"{query_col} long, {id_col} long, score double"
    parts = []
    for ids, matrix in query_blocks(queries, query_col, query_vector_col or vector_col, k):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, own = shared.value
            best = _Best(own, k)
            for batch in batches:
                for low in range(0, batch.num_rows, TILE_ROWS):
                    part = batch.slice(low, TILE_ROWS)
                    best.add(np.asarray(part.column(0)), np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1))
            kept = min(k, best.seen)
            if kept:
                columns = [np.repeat(query_ids, kept), best.ids[:, :kept].ravel(), best.scores[:, :kept].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])], [query_col, id_col, "score"])

        parts.append(rows.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).mapInArrow(nearest, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    every = reduce(DataFrame.union, parts)
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), F.asc(id_col)))
    return every.withColumn("rank", rank - 1).where(F.col("rank") < k)
