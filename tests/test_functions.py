"""Text similarity, autocut, reranking and embedders in plain form."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vexel.functions.embedding import HashEmbedder, OnnxEmbedder, embed, embedding_model, extract_embeddings, masked_mean
from vexel.functions.text import cosine_of, hash_features, hash_features_batch, murmur3_32, partial_ratio
from vexel.operators.autocut import autocut, autocut_distances, autocut_scores
from vexel.operators.rerank import hybrid_rerank_results
from vexel.operators.search import _Best, batch_top_k, scored, top_k


def test_murmur_known_answers():
    assert murmur3_32(b"hello") == 0x248BFA47 and murmur3_32(b"The quick brown fox jumps over the lazy dog") == 0x2E4FF723
    assert murmur3_32(b"") == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    if not a or not b:
        return 0
    a, b = sorted((a, b), key=len)
    windows = [b[i : i + len(a)] for i in range(len(b) - len(a) + 1)] + [b[:i] for i in range(1, len(a))] + [b[-i:] for i in range(1, len(a))]
    best = max(2 * lcs(a, w) / (len(a) + len(w)) for w in windows)
    if len(a) == len(b):
        best = max([best] + [2 * lcs(b, w) / (len(b) + len(w)) for w in [a[:i] for i in range(1, len(a))] + [a[-i:] for i in range(1, len(a))]])
    return round(100 * best)


def test_partial_ratio_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, n))) for n in (12, 30))
        assert partial_ratio(a, b) == plain_ratio(a, b), (a, b)
    assert partial_ratio(None, "a") == 0 and partial_ratio("abc", "xxabcxx") == 100


def test_hash_features():
    v = hash_features("Blue  is cool")
    assert v == hash_features("blue is cool") and abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 64
    assert hash_features("") == [0.0] * 64 and math.isnan(cosine_of(hash_features(""), v))


def test_autocut_lists():
    assert autocut_scores([0.9, 0.88, 0.5, 0.49]) == [2, 3]
    assert autocut_scores([1.0, 0.8]) == [] and autocut_scores([0.9]) == [] and autocut_scores([]) == []
    assert autocut_distances([0.1, 0.11, 0.3]) == [2] and autocut_distances([0.0, 0.1]) == [1] and autocut_distances([0.0, 0.0]) == []


def test_autocut_frame_equals_lists(spark):
    rng = random.Random(2)
    rows = []
    for g in range(40):
        scores = sorted((rng.choice([0.0, rng.random()]) for _ in range(rng.randint(1, 6))), reverse=True)
        rows += [(g, r, s) for r, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "g long, rank int, score double")
    kept = {(r["g"], r["rank"]) for r in autocut(frame, group_cols=["g"]).collect()}
    wanted = set()
    for g in range(40):
        scores = [s for h, _, s in rows if h == g]
        wanted |= {(g, r) for r in range(len(scores)) if r not in autocut_scores(scores)}
    assert kept == wanted


def test_rerank_lists():
    sentences = ["the ocean is blue", "blue is cool", "stop", "green"]
    best, totals = hybrid_rerank_results(sentences, [0.4, 0.5, 0.1, 0.2], "blue is cool", k=2)
    assert best[0] == "blue is cool" and len(best) == 2 and totals[0] > totals[1]
    assert hybrid_rerank_results([], [], "x") == ([], [])
    assert hybrid_rerank_results(["a", "b"], ["bad", None], "x", k=1) == (["a"], ["bad"])
    assert hybrid_rerank_results(["a", "b", "a b"], [500.0, -3.0, 9.0], "zz", k=3, weights=(1, 0, 0))[0] == ["a", "a b", "b"]


def test_scores_of_odd_vectors(spark):
    frame = spark.createDataFrame([(0, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [3.0, 4.0]), (3, None)], "row_num long, embedding array<float>")
    got = {r["row_num"]: r["score"] for r in scored(frame, [3.0, 4.0]).collect()}
    assert got[0] == 0.0 and got[2] == pytest.approx(1.0)
    order = [r["row_num"] for r in top_k(frame, [3.0, 4.0], 4).orderBy("rank").collect()]
    assert order[0] == 2 and order[-1] == 1


def test_embedders(spark):
    states, mask = np.arange(12, dtype=float).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert masked_mean(states, mask).tolist() == [[2.0, 3.0, 4.0, 5.0]]
    own = HashEmbedder()
    frame = spark.createDataFrame([(0, "abc"), (1, None)], "id long, text string").select("id", embed(F.col("text"), own).alias("v"))
    got = {r["id"]: r["v"] for r in frame.collect()}
    assert np.allclose(got[0], extract_embeddings("abc", own)) and got[1] == [0.0] * 64
    with pytest.raises(ValueError):
        OnnxEmbedder("x", cpu_cores="2")
    with pytest.raises(ValueError):
        embedding_model()
    assert embedding_model(onnx_path="m.onnx", onnx_model_cpu_core_count=2).dimension == 512
    assert embedding_model(False, e5_model_size="small").dimension == 384


def test_kernels_agree(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    query = list(rows.where("vec_id = 3").first()["embedding"])
    plain, arrow = (top_k(rows, query, 12, F.col("label") < 7, tie_col="vec_id", kernel=kernel).orderBy("rank").collect() for kernel in ("expression", "arrow"))
    assert [(r["rank"], r["vec_id"], r["label"], round(r["score"], 9)) for r in plain] == [(r["rank"], r["vec_id"], r["label"], round(r["score"], 9)) for r in arrow]
    assert top_k(rows.limit(0), query, 3, tie_col="vec_id", kernel="arrow").count() == 0
    assert batch_top_k(rows, rows.limit(0).withColumnRenamed("vec_id", "qid"), 3).count() == 0
    for bad in ({"k": 0}, {"kernel": "other"}, {"metric": "other"}):
        with pytest.raises(ValueError):
            top_k(rows, query, tie_col="vec_id", **bad)


def test_hash_features_of_a_batch():
    """All texts together give what each gives alone."""
    rng = random.Random(12)
    texts = [None, "", "a", "  \n", "é\U0001f600中 x", *("".join(rng.choice("ab é中\U0001f600\t Z") for _ in range(rng.randint(0, 60))) for _ in range(80))]
    assert hash_features_batch(texts).tolist() == [hash_features(t) for t in texts] and hash_features_batch([]).shape == (0, 64)


def test_hash_features_of_long_texts_in_blocks(monkeypatch):
    """Texts longer than a block, whose n-grams cross its ends."""
    rng = random.Random(13)
    texts = [None, "", "ab", *("".join(rng.choice("ab é中\U0001f600\t Z") for _ in range(rng.randint(0, 200))) for _ in range(60))]
    for chars in (1, 7, 100):
        monkeypatch.setattr("vexel.functions.text._CHARS", chars)
        assert hash_features_batch(texts).tolist() == [hash_features(t) for t in texts]


def test_memory_of_hash_features_does_not_grow_with_the_texts():
    def peak(n):
        texts = [f"{i} " * 1000 for i in range(n)]
        tracemalloc.start()
        hash_features_batch(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(1000) < 1.2 * peak(250)


def test_embedder_gets_few_texts_at_once(spark):
    class Sizes:
        def load(self):
            return lambda texts: np.array([[len(texts), sum(map(len, texts))]] * len(texts), np.float32)

    rows = spark.range(0, 5000, 1, 1).select("id", F.when(F.col("id") < 4000, "x").otherwise(F.repeat(F.lit("y"), 20_000)).alias("text"))
    got = [r["v"] for r in rows.select(embed(F.col("text"), Sizes()).alias("v")).collect()]
    assert len(got) == 5000 and max(v[0] for v in got) == 512 and max(v[1] for v in got) <= 1 << 20


def test_memory_of_batch_search_does_not_grow_with_an_arrow_batch(spark, monkeypatch):
    rng, given = np.random.default_rng(4), []
    rows = spark.createDataFrame([(0, [0.0] * 8)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(3000, 8)).tolist())], "qid long, embedding array<float>")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, work, schema: given.append(work) or self.sparkSession.createDataFrame([], schema))
    batch_top_k(rows, queries)

    def peak(n):
        vectors = pa.array(list(rng.normal(size=(n, 8)).astype(np.float32)), pa.list_(pa.float32()))
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), vectors], ["vec_id", "embedding"])
        tracemalloc.start()
        found = [b for b in given[0](iter([batch, batch]))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(b.num_rows for b in found) == 3000 * 5
        return most

    assert peak(10_000) < 1.2 * peak(2_500)


def test_batch_search_of_equal_and_near_vectors(spark, monkeypatch):
    """Copies, multiples, ties, zero vectors, few rows and small tiles: ranks by the exact score, ties by id."""
    rng = np.random.default_rng(6)
    base = rng.integers(-2, 3, size=(30, 7)).astype(np.float32)
    base[0] = 0
    vectors = np.concatenate([base, base * 3, base, base + rng.normal(size=base.shape).astype(np.float32) * 1e-7, rng.normal(size=(80, 7)).astype(np.float32)])
    ids = rng.permutation(len(vectors)).tolist()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    queries = rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "qid")

    def cosine(a, b):
        d = na = nb = 0.0
        for x, y in zip(a.astype(float).tolist(), b.astype(float).tolist(), strict=True):
            d, na, nb = d + x * y, na + x * x, nb + y * y
        return max(-1.0, min(1.0, d / math.sqrt(na * nb))) if na * nb else 0.0

    by_id = dict(zip(ids, vectors, strict=True))
    scores = {q: sorted(((-cosine(by_id[q], v), i) for i, v in by_id.items())) for q in ids if q % 3 == 0}
    for k in (1, 6, 500):
        want = {(q, i, r, -s) for q, found in scores.items() for r, (s, i) in enumerate(found[:k])}
        assert {(r["qid"], r["vec_id"], r["rank"], r["score"]) for r in batch_top_k(rows, queries, k).collect()} == want
    for tile, size in ((1, 7), (4, 200), (5, 1 << 20)):
        best = _Best(np.stack([by_id[q] for q in scores]).astype(float), 6)
        monkeypatch.setattr("vexel.operators.search.TILE_BYTES", size)
        for low in range(0, len(ids), tile):
            best.add(np.array(ids[low : low + tile]), vectors[low : low + tile].astype(float))
        assert best.ids.tolist() == [[i for _, i in found[:6]] for found in scores.values()]
