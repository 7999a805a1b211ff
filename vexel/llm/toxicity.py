"""Operator 2. Toxicity of texts whose obfuscated words are restored first.

A character model is counted over all texts. With it every text's words are
restored (see deobfuscation), and a logistic model scores which words, and
beginnings of words, are present. The logistic model is fitted on at most
SAMPLE_ROWS labelled rows outside the held-out fifth; its candidate features are
the words and word beginnings that several toxic rows of the sample share.

Edge cases: null and empty texts have no features and get the intercept's score;
a null id is held out and never trained on; labels that are null, or without a
document, are not used; repeated label rows count once, conflicting ones as
toxic; without labels of both kinds every score is the share of toxic rows (0
without labels). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import materialize, table, text_slices
from vexel.llm.deobfuscation import CharModel, Restorer, trigram_counts

#: Labelled rows that the classifier is fitted on at most, and the features it keeps at most.
SAMPLE_ROWS = 20_000
MOST_FEATURES = 600
#: Lengths of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
FOLDS = 5
#: Standard deviations by which a feature must be more frequent in toxic rows than the sample lets expect.
EVIDENCE = 6


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))


def corpus_model(docs: DataFrame) -> CharModel:
    """The character model of all texts. docs: doc_id, text. At most 27 ** 3 counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 15, np.int64)
        for (texts,) in text_slices(batches, ["text"]):
            total += trigram_counts([t for t in texts if t])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    counts = np.zeros(1 << 15, np.int64)
    for gram, n in docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    return CharModel(counts)


def features_of(words: set[str]) -> set[str]:
    """Words as w:..., beginnings as p:..."""
    out = {f"w:{w}" for w in words if len(w) > 1}
    for n in BEGINNINGS:
        out.update(f"p:{w[:n]}" for w in words if len(w) > n)
    return out


@dataclass
class Classifier:
    intercept: float
    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.whole = {f[2:]: w for f, w in self.weights.items() if f[0] == "w"}
        self.starts = [(n, {f[2:]: w for f, w in self.weights.items() if f[0] == "p" and len(f) == n + 2}) for n in BEGINNINGS]

    def score(self, words: set[str]) -> float:
        total = self.intercept + sum(self.whole[w] for w in words & self.whole.keys())
        for n, weights in self.starts:
            if weights:
                total += sum(weights[p] for p in {w[:n] for w in words if len(w) > n} & weights.keys())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def choose(present: dict[str, int], toxic: dict[str, int], n: int, n_toxic: int) -> list[str]:
    """The features whose toxic share lies EVIDENCE standard deviations over the sample's, the strongest MOST_FEATURES.

    present, toxic: rows and toxic rows with the feature.
    """
    share = n_toxic / n

    def evidence(f: str) -> float:
        expected = present[f] * share
        return (toxic[f] - expected) / math.sqrt(expected * (1 - share) + 0.5)

    return [f for f in sorted(toxic, key=lambda f: (-evidence(f), f))[:MOST_FEATURES] if evidence(f) > EVIDENCE]


def fit(rows: list[tuple[int, list[int]]], names: list[str], steps: int = 400, l2: float = 0.1) -> Classifier:
    """Logistic regression. rows: label and the numbers of the features present."""
    y = np.array([r[0] for r in rows], np.float32)
    n, positive = len(y), float(y.sum()) if rows else 0.0
    if not 0 < positive < n:
        return Classifier(50.0 if n and positive == n else -50.0, {})
    x = np.zeros((n, len(names)), np.float32)
    for i, (_, row) in enumerate(rows):
        x[i, row] = 1
    w, b = np.zeros(len(names), np.float32), math.log(positive / (n - positive))
    squares, b_square = np.full(len(names), 1e-6, np.float32), 1e-6
    for _ in range(steps):
        error = y - 1 / (1 + np.exp(-(x @ w + b)))
        g, g_b = x.T @ error - l2 * w, float(error.sum())
        squares += g * g
        b_square += g_b * g_b
        w += 0.5 * g / np.sqrt(squares)
        b += 0.5 * g_b / math.sqrt(b_square)
    return Classifier(float(b), dict(zip(names, w.tolist(), strict=True)))


def train(docs: DataFrame, labels: DataFrame, model: CharModel) -> Classifier:
    """The classifier, from a sample of labelled rows outside the held-out fold. docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # bounded, so it may be broadcast
    sample = materialize(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-sample")
    shared = spark.sparkContext.broadcast(model)

    def counted(wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows have each feature; wanted: a broadcast set of features, or None for all."""
        restorer, total = Restorer(shared.value), Counter()
        for (texts,) in text_slices(batches, ["text"]):
            for text in texts:
                found = features_of(restorer.words(text or ""))
                total.update(found if wanted is None else found & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["feature", "n"])

    def counts(rows: DataFrame, wanted, least: int) -> dict[str, int]:
        summed = rows.select("text").mapInArrow(partial(counted, wanted), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        return {r["feature"]: r["n"] for r in summed.where(F.col("n") >= least).collect()}

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n = sizes.get(1, 0), sum(sizes.values())
    if not 0 < n_toxic < n:
        return fit([(label, []) for label, size in sizes.items() for _ in range(size)], [])
    # each in one of every 50 toxic rows of a bounded sample, and so bounded too
    toxic = counts(sample.where("toxic = 1"), None, max(3, n_toxic // 50))
    present = counts(sample, spark.sparkContext.broadcast(frozenset(toxic)), 1)
    names = choose(present, toxic, n, n_toxic)
    numbers = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def chosen_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, own = Restorer(shared.value), numbers.value
        for texts, labels in text_slices(batches, ["text", "toxic"]):
            rows = [sorted(own[f] for f in features_of(restorer.words(t or "")) & own.keys()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "features"])

    found = sample.select("text", "toxic").mapInArrow(chosen_of, "toxic int, features array<int>")
    return fit([(r["toxic"], r["features"]) for r in found.collect()], names)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = corpus_model(rows)
    classifier = train(rows, labels.select("doc_id", "toxic"), model)
    shared = spark.sparkContext.broadcast((model, classifier))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classifier = shared.value
        restorer = Restorer(model)
        for ids, texts in text_slices(batches, ["doc_id", "text"]):
            scores = [classifier.score(restorer.words(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
