import random
import time
import zlib

import numpy as np
import pytest

from vexel.llm.deobfuscation import CharModel, Restorer, lattice, trigram_counts
from vexel.llm.toxicity import Classifier, op2_noisy_channel_toxicity, score_toxicity


@pytest.fixture(scope="module")
def model(corpus_rows):
    return CharModel(trigram_counts([t for _, t in corpus_rows]))


def test_counts_and_model(model):
    counts = trigram_counts(["ab", "É1"]).reshape(32, 32, 32)
    assert counts[0, 1, 2] == 1 and counts[1, 2, 0] == 1 and counts[0, 0, 5] == 1 and counts.sum() == 10 - 2
    assert np.allclose(np.exp(np.array(model.log)).sum(axis=2), 1)


def test_obfuscated_words_come_back(model):
    own = Restorer(model)
    for written, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("m0r0n", "moron"), ("p@thetic", "pathetic"), ("stuuuupid", "stupid"), ("$tupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("scuuum", "scum"), ("tr4sh!!", "trash")):
        assert word in own.words(f"the {written} of"), written
    assert own.words("plain words, only 42 (here)") == {"plain", "words", "only", "42", "here"}
    assert "moron" in own.restored("you M0R0N.").split("you ")[1]


def test_viterbi_is_the_best_path(model):
    from itertools import product

    for word in ("1d10t", "aab11", "x0o0x", "ttt1"):
        def total(path):
            a = b = 0
            score = 0.0
            for letters, cost in path:
                score += cost
                for c in letters:
                    score += model.log[a][b][ord(c) - 96]
                    a, b = b, ord(c) - 96
            return score + model.log[a][b][0]

        best = max(product(*lattice(word)), key=total)
        assert model.restore(word) == "".join(c for c, _ in best)


def test_held_out_accuracy(spark, small_dir):
    folder = small_dir.replace("0.01", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op2_noisy_channel_toxicity(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    assert sum(a == b == 1 for a, b in judged) >= 0.8 * sum(a for a, _ in judged)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None), (None, 1), (2, 0), (50, 1)], "doc_id long, toxic int")
    rows = score_toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows) and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert {r["predicted"] for r in score_toxicity(odd_docs, labels.limit(0)).collect()} == {0}
    assert score_toxicity(no_docs, labels).count() == 0


def test_learns_planted_words(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 6 == 0)
        words = [word() for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(["zorkling", "z0rkling", "zorrrkling", "quazzed"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    found = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in found if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


def test_classifier_of_nothing():
    assert Classifier(0.0, {}).score(set()) == 0.5


def test_long_obfuscated_words_come_back(model):
    own = Restorer(model)
    assert "stupid" in own.words("you st" + "u" * 60 + "pid") and "idiot" in own.words("1d" + "1" * 50 + "0t")
    assert "stupid" in own.restored("you st" + "u" * 60 + "pid")
    from time import time

    before = time()
    assert own.words("a1b2" * 5000) and time() - before < 20


def test_spaced_out_sentences_come_back(corpus_rows, model):
    own = Restorer(model)
    plain = "the idiot and the moron are stupid and pathetic scum in the trash"
    for gap in ("  ", "--"):
        written = gap.join(" ".join(w) for w in plain.split())
        assert len(plain) > 50 and {"idiot", "moron", "stupid", "pathetic"} <= own.words(written), own.words(written)
    assert {"idiot", "moron", "stupid"} <= set(own.restored(written).split())


def test_letters_of_other_scripts_come_back(model):
    restorer = Restorer(model)
    plain = "the people"
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in plain)
    styled = "".join(chr(0x1D41A + ord(c) - 97) if c != " " else c for c in plain)
    assert restorer.restored(wide) == restorer.restored(styled) == plain
    assert restorer.words(wide) == restorer.words(styled) == {"the", "people"}
    assert restorer.words("реорle") == {"people"} and restorer.restored("a реорle!") == "a people!"
    assert restorer.words("мама и море") == {"мама", "и", "море"}  # one script: as it is


def test_one_run_of_letters_takes_linear_time(model):
    restorer = Restorer(model)
    for unit in ("x", "aaabbb", "1xxx"):
        began = time.perf_counter()
        restorer.words(unit * (200_000 // len(unit)))
        assert time.perf_counter() - began < 6, unit
