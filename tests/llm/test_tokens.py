"""Operators 4 and 6 against the libraries."""

import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from vexel.llm.bpe import PATTERN, load_merge_file, load_ranks, merge_piece
from vexel.llm.bpe_codec import RecursiveCodec, encode_decode, op6_bpe_codec
from vexel.llm.token_counts import RaggedCounter, count_tokens, op4_token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def random_texts():
    rng = random.Random(4)
    alphabet = "ab \n\t\x1c\x1d\x85\xa0 ​᠎　é1²٣中😀'sllt"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(600)]


def test_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(JSON)
    given = [t or "" for t in texts] + random_texts() + ["a<|endoftext|>b <|endoftext|><|endoftext|>", "ab" * 3000, " " * 5000]
    assert RaggedCounter(JSON).count(given) == [len(e.ids) for e in library.encode_batch(given, add_special_tokens=False)]


def test_counts_of_a_table(spark, small_dir, corpus_rows):
    library = Tokenizer.from_file(JSON)
    want = {i: (len(t.encode()), len(e.ids)) for (i, t), e in zip(corpus_rows, library.encode_batch([t for _, t in corpus_rows], add_special_tokens=False), strict=True)}
    found = op4_token_counts(spark, small_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in found} == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)


def test_counts_of_odd_rows(odd_docs, no_docs):
    found = count_tokens(odd_docs, JSON)
    assert found.count() == odd_docs.count() and count_tokens(no_docs, JSON).count() == 0
    assert found.where("n_bytes = 0 AND n_tokens <> 0").count() == 0


def test_codec_of_a_table(spark, small_dir, corpus_rows, own):
    found = {r["doc_id"]: r for r in op6_bpe_codec(spark, small_dir).collect()}
    for i, text in corpus_rows:
        ids = own.encode_ordinary(text)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == sha256(text.encode()).hexdigest()


def test_codec_round_trip_of_odd_texts(spark, odd_docs, no_docs, own):
    rows = [(i, t) for i, t in enumerate(random_texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    found = encode_decode(frame, RANKS).collect()
    want = [t or "" for _, t in rows] + [r["text"] or "" for r in odd_docs.collect()]
    assert sorted(bytes(r["decoded"]) for r in found) == sorted(t.encode() for t in want)
    by_text = {bytes(r["decoded"]): r["ids"] for r in found}
    assert all(by_text[t.encode()] == ",".join(map(str, own.encode_ordinary(t))) for t in want)
    assert encode_decode(no_docs, RANKS).count() == 0


def test_one_piece_by_heap():
    byte_ids, merges, _ = load_merge_file(JSON)
    pairs = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
    rng = random.Random(0)
    for _ in range(200):
        ids = [byte_ids[ord(rng.choice("theaniors "))] for _ in range(rng.randint(0, 30))]
        slow = list(ids)
        while found := min(((pairs[p], i) for i, p in enumerate(zip(slow, slow[1:], strict=False)) if p in pairs), default=None):
            slow[found[1] : found[1] + 2] = [found[0][1]]
        assert merge_piece(ids, pairs.get) == slow


def test_bytes_come_from_the_ids():
    """One id changed in what a worker knows: the ids and the decoded bytes of just the texts with that word change."""
    codec = RecursiveCodec(RANKS)
    texts = ["some plain words", "other ones", "x" * 300 + " plain", "é" * 120_000]
    before = list(codec.run(texts))
    assert [raw for _, _, raw in before] == [t.encode() for t in texts]
    codec.known[" plain"] = codec.known[" words"]
    after = list(codec.run(texts))
    assert [raw.decode() for _, _, raw in after] == ["some words words", "other ones", "x" * 300 + " words", texts[3]]
    assert [a == b for a, b in zip(after, before, strict=True)] == [False, True, False, True]
