"""The pipeline's stages one after another, against plain versions, and the registered queries."""

from hashlib import sha256

import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from vexel.llm import registry
from vexel.llm.bpe import load_ranks
from vexel.llm.decontamination import Block
from vexel.llm.pii import all_spans, labelled_sentences, redacted, train_model
from vexel.llm.quality import score_quality
from vexel.llm.simhash import near_duplicates


def test_stages(spark, small_dir, corpus, corpus_rows):
    text = dict(corpus_rows)
    scored, _ = score_quality(corpus, spark.read.parquet(f"{small_dir}/labels.parquet"))
    left = {r["doc_id"] for r in scored.where("kept").collect()}
    classes = {}
    for r in near_duplicates(corpus.where(corpus["doc_id"].isin(sorted(left)))).collect():
        classes.setdefault(r["component_id"], []).append(r["doc_id"])
    left = {min(c) for c in classes.values()}
    block = Block([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()])
    left = sorted(i for i in left if not any(hit[1] >= 0.5 for hit in block.matches(text[i])))
    spans = all_spans([text[i] for i in left], train_model(labelled_sentences()))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, (_, found) in zip(left, spans, strict=True):
        clean = redacted(text[i], found)
        want[i] = (",".join(map(str, own.encode_ordinary(clean))), clean)
    rows = corpus_pipeline.run(spark, small_dir).collect()
    got = {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in rows}
    assert len(rows) == len(want) and got == {i: (sha256(a.encode()).hexdigest(), sha256(b.encode()).hexdigest()) for i, (a, b) in want.items()}


def test_stages_keep_columns(spark, small_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small_dir)
            assert out.columns == docs.columns
            out.count()


def test_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} and len(names) == 10
    assert names | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
