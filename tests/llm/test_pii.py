import random
import re
from hashlib import sha256

import numpy as np
import pytest

from vexel.llm import crf
from vexel.llm.pii import KINDS, all_spans, base_spans, find_pii, joined, labelled_sentences, luhn, op7_crf_pii, redact, redacted, secret_spans, train_model

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    return train_model(labelled_sentences())


def test_base_equals_the_patterns(corpus_rows, texts):
    rng = random.Random(2)
    given = [t for _, t in corpus_rows] + [t or "" for t in texts] + ["".join(rng.choice("ab.@1.2 -+()95%٣é") for _ in range(60)) for _ in range(4000)]
    for text in given:
        assert base_spans(text) == plain(text)


def test_secrets_of_held_out_sentences(model):
    rows = labelled_sentences(200, seed=99)
    found = secret_spans([t for t, _, _ in rows], model)
    right = sum(f == ([(s, e)] if s >= 0 else []) for f, (_, s, e) in zip(found, rows, strict=True))
    assert right >= 190


def test_viterbi_is_the_best_path(model):
    from itertools import product

    for text, _, _ in labelled_sentences(30, seed=5):
        words = crf.TOKEN.findall(text)[:6]
        row = crf.features(words)
        x, _ = model.pad([row])
        scores = model.emit[x][0].sum(axis=1)

        def total(path, scores=scores):
            return model.start[path[0]] + sum(scores[t][k] for t, k in enumerate(path)) + sum(model.move[a][b] for a, b in zip(path, path[1:], strict=False))

        best = max(total(p) for p in product(range(3), repeat=len(words)))
        assert total(model.decode([row])[0]) == pytest.approx(best)


def test_table(spark, small_dir, corpus_rows):
    text = dict(corpus_rows)
    for r in op7_crf_pii(spark, small_dir).collect():
        base = plain(text[r["doc_id"]])
        assert r["base_sha256"] == sha256(joined(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(spans)
        secrets = [tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith("secret")]
        known = [m.span(m.lastindex) for m in re.finditer(r'password=([0-9a-f]+)|token = "([0-9a-f]+)"|(AKIA[A-Z0-9]{16})', text[r["doc_id"]])]
        assert set(known) <= set(secrets) and len(secrets) <= len(known) + 12


def test_odd_rows_and_redaction(spark, odd_docs, no_docs, model):
    assert find_pii(odd_docs, model).count() == odd_docs.count() and find_pii(no_docs, model).count() == 0 and find_pii(odd_docs, None).count() == odd_docs.count()
    clean = redact(odd_docs, model, length_col="n_chars")
    assert clean.columns == odd_docs.columns and clean.schema == odd_docs.schema and clean.count() == odd_docs.count()
    docs = spark.createDataFrame([(1, "mail a@b.co and 10.0.0.1, password=ab12cd34ef56 end", 1), (2, None, None)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in redact(docs, model, length_col="n_chars").collect()}
    assert rows[1]["text"] == "mail <EMAIL> and <IP>, password=<SECRET> end" and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] is None
    assert redacted("abcdef", [(1, 0, 3), (2, 1, 5)]) == "a<EMAIL>f"
    assert all_spans(["x 4111 1111 1111 1111"], model)[0][0] == [(2, 2, 21)] and train_model([]) is None


def test_secrets_without_digits_short_or_in_parts(model):
    rng = random.Random(3)
    filler = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    for secret in ("correcthorse", "aB3-xY9-kL2", "hunter2"):
        for text in (f"my password: {secret}", f"{filler} password: {secret} {filler}"):
            start = text.index(secret)
            assert secret_spans([text], model) == [[(start, start + len(secret))]], secret
    assert secret_spans([filler, "", "the password is not here, nor the key"], model) == [[], [], []]


def test_long_texts_decode_like_whole_ones(model):
    text = " ".join(t for t, _, _ in labelled_sentences(200, seed=8))
    words = crf.TOKEN.findall(text)
    whole = model.decode([crf.features(words)])[0]
    places = [m.span() for m in crf.TOKEN.finditer(text)]
    starts = [places[k][0] for k, label in enumerate(whole) if label == 1]
    assert len(words) > 1500 and [s for s, _ in secret_spans([text], model)[0]] == starts


def test_lexicon_scores_like_features(model):
    """Patterns of like characters give what the features of every single token give."""
    rng = random.Random(5)
    made = ["".join(rng.choice("abgzAZ09éÉßǅ中٣½²_-") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [crf.TOKEN.findall(" ".join([*made[k : k + 40], rng.choice(("password", "Token", "x")), "=", *made[k + 40 : k + 45]])) for k in range(0, 3000, 45)]
    found = crf.Lexicon(model).scores([w for words in texts for w in words], [len(words) for words in texts])
    x, lengths = model.pad([crf.features(words) for words in texts])
    whole = model.emit[x].sum(axis=2)
    assert np.allclose(found, np.concatenate([row[:n] for row, n in zip(whole, lengths, strict=True)]))
