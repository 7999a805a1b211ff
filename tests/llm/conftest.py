import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
GOOD = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(120))


@pytest.fixture(scope="session")
def texts():
    """Texts that every operator must take: null, empty, blank, very long, repeated, odd characters."""
    return [None, "", "  \n\t ", LONG, GOOD, GOOD, "a", "\x00\x85 é\U0001f600\n\n", "x" * 20_000, "the the the the the the", "+" * 500 + "@" * 500 + "1." * 500]


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Those texts with null and repeated ids, null and clashing further columns."""
    rows = [(None if i == 4 else i % 7, t, None if i % 3 else "en", None, 1, 2.0, "s", i, True) for i, t in enumerate(texts)]
    rows += rows[3:5]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, row long, kept boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def corpus(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def corpus_rows(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
