import random
from collections import defaultdict

import pyarrow as pa

from vexel.llm import passages, substring_dedup
from vexel.llm.components import connected_components
from vexel.llm.simhash import Forest
from vexel.llm.substring_dedup import bands_for, find_repeats, op1_paragraph_minhash, paragraph_words, shingles, similar, without_words


def classes(rows):
    """(doc, start) -> class of the paragraphs that repeat, by shared shingles of all pairs; of equal texts the first counts."""
    firsts = {text: i for i, text in sorted(rows, key=lambda r: -r[0])}
    lines = [(i, start, b" ".join(words)) for text, i in firsts.items() for start, words in paragraph_words(text)]
    distinct = sorted({x[2] for x in lines})
    number, sets = {x: k for k, x in enumerate(distinct)}, [shingles(x) for x in distinct]
    by_shingle, forest = defaultdict(list), Forest()
    for k, own in enumerate(sets):
        forest.add()
        for s in own:
            by_shingle[s].append(k)
    for row in by_shingle.values():
        for a in row:
            if a != row[0] and similar(sets[a], sets[row[0]]):
                forest.join(a, row[0])
        for x in range(len(row)):
            for y in range(x):
                if len(row) < 50 and forest.root(row[x]) != forest.root(row[y]) and similar(sets[row[x]], sets[row[y]]):
                    forest.join(row[x], row[y])
    size = defaultdict(int)
    for _, _, x in lines:
        size[forest.root(number[x])] += 1
    return {(i, s): forest.root(number[x]) for i, s, x in lines if size[forest.root(number[x])] > 1}


def same_partition(a, b):
    return set(a) == set(b) and len(set(a.values())) == len(set(b.values())) == len({(a[k], b[k]) for k in a})


def test_table_equals_all_pairs(spark, small_dir, corpus_rows):
    rows = op1_paragraph_minhash(spark, small_dir).where("kind = 'paragraph'").collect()
    found = {(r["doc_id"], r["start"]): r["class_id"] for r in rows}
    assert same_partition(found, classes(corpus_rows))
    assert sum(r["kept"] for r in rows) == len(set(found.values()))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_passage_inside_other_text(spark):
    rng = random.Random(1)
    passage = words(rng, 55)
    rows = [(i, f"{words(rng, rng.randint(20, 60))} {passage} {words(rng, 40)}" if i % 4 == 0 else words(rng, 120)) for i in range(80)]
    found = find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(80) if i % 4 == 0} and {r["kind"] for r in found} == {"run"}
    assert {r["doc_id"] for r in found if r["kept"]} == {0}
    text = dict(rows)
    for r in found:
        own = text[r["doc_id"]].split()[r["start"] : r["start"] + r["n_words"]]
        assert " ".join(own) in passage and len(own) == r["n_words"] >= 15


def test_crowded_buckets(spark, monkeypatch):
    """Blocks of five rows, parts of seven, and a large group of near copies: the classes stay whole."""
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", 5)
    monkeypatch.setattr(substring_dedup, "PART_ROWS", 7)
    rng = random.Random(2)
    base = words(rng, 80).split()
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(80)] = "changed"
        rows.append((i, " ".join(own) if i < 40 else words(rng, 60)))
    everything = find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["start"]): r["class_id"] for r in everything if r["kind"] == "paragraph"}
    assert {r["doc_id"] for r in everything} >= set(range(38)) and same_partition(found, classes(rows))


def test_odd_rows(odd_docs, no_docs):
    found = find_repeats(odd_docs).collect()
    by_kind = {k: [r for r in found if r["kind"] == k] for k in ("paragraph", "run", "copy")}
    assert {r["n_words"] for r in by_kind["copy"]} == {120, 30_000} and len(by_kind["copy"]) == 5 and sum(r["kept"] for r in by_kind["copy"]) == 2
    assert all(r["doc_id"] is not None for r in found if r["kept"])
    assert not by_kind["run"] and {(r["start"], r["n_words"]) for r in by_kind["paragraph"]} <= {(0, 10)}
    assert find_repeats(no_docs).count() == 0


def test_bands_and_removal():
    assert bands_for() == 8 and 1 - (1 - 0.8**3) ** 8 >= 0.995
    assert without_words("a b c\nd e\n\nf", [(1, 1), (3, 2)]) == "a c\n\nf"


def test_lines_are_joined_to_paragraphs():
    text = "\n".join(" ".join(f"w{n}x{k}" for k in range(n)) for n in (30, 9, 7, 12, 40, 3))
    assert [(at, len(own)) for at, own in paragraph_words(text)] == [(0, 30), (30, 28), (58, 43)]
    assert [(at, len(own)) for at, own in paragraph_words("a b\n\nc d e")] == [(0, 5)] and paragraph_words("a b c d") == [] == paragraph_words(None)


def test_short_lines_and_halves(spark):
    """A passage in lines of 20 words, one over two lines, and one of which a document holds the first half only."""
    rng = random.Random(3)
    wrapped, across, halves = words(rng, 80).split(), words(rng, 55).split(), words(rng, 80).split()
    rows = []
    for i in range(6):
        lines = [words(rng, 20 + i)] + [" ".join(wrapped[k : k + 20]) for k in range(0, 80, 20)]
        rows.append((i, "\n".join([*lines, words(rng, 20)])))
        rows.append((10 + i, f"{words(rng, 9 + i)} x{i} {' '.join(across[:27])}\n{' '.join(across[27:])} y{i} {words(rng, 8)}"))
    rows += [(20 + i, f"{words(rng, 20)} x{i} {' '.join(halves[: 40 if i == 0 else 80])} y{i} {words(rng, 20)}") for i in range(3)]
    found = [r for r in find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["kind"] == "run"]
    spans = {(r["doc_id"], r["start"], r["n_words"], r["kept"]) for r in found}
    assert {(i, 20 + i, 80, i == 0) for i in range(6)} <= spans and {(10 + i, 10 + i, 55, i == 0) for i in range(6)} <= spans
    assert {s for s in spans if s[0] >= 20} == {(20, 21, 40, True), (21, 21, 40, False), (21, 61, 40, True), (22, 21, 80, False)}


def test_runs_against_all_windows(spark):
    """Against all windows of the texts: what is found is shared, what is shared over 26 words is found but for ten words at its ends (none, where the first occurrence has them), and of all words one stays."""
    rng = random.Random(6)
    pool = [words(rng, 90).split() for _ in range(6)]
    rows = []
    for i in range(70):
        own = words(rng, rng.randint(0, 40)).split()
        for _ in range(rng.randint(1, 3)):
            passage = rng.choice(pool)
            low = rng.randint(0, 60)
            own += passage[low : low + rng.randint(10, 80)] + words(rng, rng.randint(1, 20)).split()
        rows.append((i, " ".join(own)))

    def windows(size):
        where = defaultdict(set)
        for i, text in rows:
            own = text.split()
            for k in range(len(own) - size + 1):
                where[tuple(own[k : k + size])].add((i, k))
        return {w: at for w, at in where.items() if len({i for i, _ in at}) > 1}

    def covered(size):
        return {(i, k + d) for at in windows(size).values() for i, k in at for d in range(size)}

    found = [r for r in find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["kind"] == "run"]
    words_found = [(r["doc_id"], k) for r in found for k in range(r["start"], r["start"] + r["n_words"])]
    assert len(words_found) == len(set(words_found))
    inner = {(i, k + d) for at in windows(26).values() for i, k in at for d in range(10, 16)}
    assert inner <= set(words_found) <= covered(15) and len(covered(26) - set(words_found)) < 0.2 * len(covered(26))
    gone = {(r["doc_id"], k) for r in found if not r["kept"] for k in range(r["start"], r["start"] + r["n_words"])}
    left = {w for i, text in rows for k, w in enumerate(text.split()) if (i, k) not in gone}
    assert left == {w for _, text in rows for w in text.split()}


def test_runs_are_whole_passages(spark):
    """Any place and line breaks, every word, one class for copies of different extent, and the first copy of every part stays."""
    rng = random.Random(4)
    passage = words(rng, 51).split()
    broken = " ".join(passage[:20]) + "\n" + "\n".join(" ".join(passage[k : k + 4]) for k in range(20, 51, 4))
    rows, want = [], set()
    for i in range(60):
        lead = rng.randint(20, 60)
        rows.append((60 - i, f"{words(rng, lead - 1)} before{i} {broken if i % 2 else ' '.join(passage)} after{i} {words(rng, 9)}"))
        want.add((60 - i, lead, 51, i == 59))
    head, tail = words(rng, 30), words(rng, 30)
    texts = [f"{words(rng, 19)} a {head} b {words(rng, 20)}", f"{words(rng, 19)} c {tail} d {words(rng, 20)}", f"{words(rng, 9)} e {head} {tail} f {words(rng, 10)}", f"{words(rng, 4)} g {head} {tail}"]
    rows += [(100 + k, text) for k, text in enumerate(texts)]
    found = [r for r in find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["kind"] == "run"]
    assert {(r["doc_id"], r["start"], r["n_words"], r["kept"]) for r in found if r["doc_id"] <= 60} == want
    assert len({r["class_id"] for r in found if r["doc_id"] <= 60}) == 1 and len({r["class_id"] for r in found if r["doc_id"] >= 100}) == 1
    covered = {d: {k for r in found if r["doc_id"] == d for k in range(r["start"], r["start"] + r["n_words"])} for d in range(100, 104)}
    assert covered == {100: set(range(20, 50)), 101: set(range(20, 50)), 102: set(range(10, 70)), 103: set(range(5, 65))}
    left = [without_words(text, [(r["start"], r["n_words"]) for r in found if r["doc_id"] == 100 + k and not r["kept"]]) for k, text in enumerate(texts)]
    assert left[:2] == texts[:2] and len(left[3].split()) == 5


def test_links_of_runs_are_written_before_they_are_joined(spark, monkeypatch):
    """Else tasks run two Python steps side by side, and executors keep a worker for each."""
    plans = []

    def watched(edges):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return connected_components(edges)

    monkeypatch.setattr(passages, "connected_components", watched)
    rng = random.Random(9)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    shared = words(60)
    docs = spark.createDataFrame([(i, f"{words(30)} {shared} {words(30)}") for i in range(3)], "doc_id long, text string")
    assert [r["n_words"] for r in find_repeats(docs).where("kind = 'run'").collect()] == [60] * 3
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_rest_of_a_bucket_is_compared_at_once(monkeypatch):
    """The links of one comparison after another, without one: near copies, other texts, short ones, components, and two parts."""
    rng = random.Random(10)
    bases = [words(rng, 40).split() for _ in range(3)]
    rows = []
    for n in range(160):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(40)] = f"x{rng.randrange(9)}"
        rows.append((7, 0, n % 2, n >= 60, n, n // 2, " ".join(own[: rng.choice([2, 5, 38, 40])]).encode()))
    rows.sort(key=lambda r: r[:5])
    want = []
    for part in (0, 1):
        forest = Forest()
        for _ in range(80):
            forest.add()
        asked = [r for r in rows if r[2] == part and not r[3]]
        for a in (r for r in rows if r[2] == part and r[3]):
            for b in asked:
                if forest.root(a[5]) != forest.root(b[5]) and similar(shingles(a[6]), shingles(b[6])):
                    forest.join(a[5], b[5])
                    want.append((a[4], b[4]))
    one_by_one = []
    monkeypatch.setattr(substring_dedup, "similar", lambda *pair: one_by_one.append(pair) or similar(*pair))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 50], strict=True)], ["bucket", "block", "part", "asks", "para", "component", "text"]) for i in range(0, 160, 50)]
    found = [tuple(r.values()) for batch in substring_dedup._verify_rest(0.8, iter(batches)) for r in batch.to_pylist()]
    assert found == want and len(want) > 20 and not one_by_one
