import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from vexel.llm.quality import RULES, apply_rules, binomial_tail, calibrate, op8_risk_controlled_quality, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_base_columns_equal_brute_force(spark, small_dir, corpus_rows):
    text = dict(corpus_rows)
    rows = op8_risk_controlled_quality(spark, small_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        n, chars, symbols, dup, repeat = plain(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    scored, thresholds = score_quality(odd_docs, labels)
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and thresholds == []
    want = Counter(plain(r["text"]) for r in odd_docs.collect())
    assert Counter((r["m"]["n_words"], r["m"]["word_chars"], r["m"]["n_symbols"], r["m"]["n_dup_lines"], r["m"]["n_repeat_words"]) for r in rows) == want
    kept = apply_rules(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert apply_rules(no_docs, labels.limit(0)).count() == 0


def test_binomial_tail_is_exact():
    for n, x, p in ((10, 0, 0.1), (50, 3, 0.05), (200, 10, 0.025), (30, 30, 0.5)):
        exact = sum(comb(n, k) * Fraction(p) ** k * (1 - Fraction(p)) ** (n - k) for k in range(x + 1))
        assert binomial_tail(n, x, p) == pytest.approx(float(exact), rel=1e-9)


def signals(spark, rows):
    frame = spark.createDataFrame(rows, "stratum string, bad boolean, value double")
    return frame.select("stratum", "bad", *[(F.col("value") if rule == "symbol_share" else F.lit(0.0)).alias(rule) for rule in RULES])


def test_thresholds_catch_bad_rows_within_the_risk(spark):
    rows = [("a", False, 0.01)] * 2000 + [("a", True, 0.5)] * 300 + [("b", False, 0.01)] * 20 + [("b", True, 0.5)] * 300 + [(None, False, 0.3)] * 2000 + [(None, True, 0.32)] * 100
    found = {t.stratum: t for t in calibrate(signals(spark, rows))}
    assert set(found) == {"a", None} and found["a"].bad_rejected == 300 and found["a"].good_rejected == 0
    assert found[None].cutoff == 0.3 and found[None].good_rejected == 0  # 20 good rows of stratum b prove nothing


def test_false_rejection_stays_limited(spark):
    """Where good rows spread evenly over a signal, no certified cutoff rejects more than the allowed share of them."""
    rows = [("a", False, i / 5000) for i in range(5000)] + [("a", True, 0.999)] * 5000
    for t in calibrate(signals(spark, rows)):
        assert t.good_rejected / t.good <= 0.05


def test_catches_most_labelled_rows(spark, small_dir):
    folder = small_dir.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = op8_risk_controlled_quality(spark, folder).join(labels, "doc_id").where("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["n"] for r in judged.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, False), 0) <= 0.05 * n[(1, True)] and n[(0, False)] > 10 * n.get((0, True), 0)
