import random

from vexel.llm import decontamination
from vexel.llm.decontamination import Block, contaminated, drop_contaminated, op5_string_tiling, tiles, words_of


def plain_tiling(p, t, least=5):
    mp, mt, total = [0] * len(p), [0] * len(t), 0
    while True:
        best, found = least - 1, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [1] * best
                total += best


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        v = rng.choice([2, 3, 8])
        p, t = [rng.randrange(v) for _ in range(rng.randint(5, 35))], [rng.randrange(v) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.7:
            k = rng.randint(1, len(p))
            t = t[:10] + p[k:] + t[10:20] + p[:k] + t[20:]
        assert sum(x.length for x in tiles(p, t)) == plain_tiling(p, t)


def test_table_equals_all_pairs(spark, small_dir, corpus_rows):
    items = [(r["item_id"], words_of(r["text"])) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in op5_string_tiling(spark, small_dir).collect()}
    want, seeds = set(), {}
    for item, words in items:
        for k in range(len(words) - 4):
            seeds.setdefault(tuple(words[k : k + 5]), set()).add(item)
    by_id = dict(items)
    for doc, text in corpus_rows:
        words = words_of(text)
        for item in set().union(*(seeds.get(tuple(words[k : k + 5]), set()) for k in range(len(words) - 4))):
            if plain_tiling(by_id[item], words) >= 0.5 * len(by_id[item]):
                want.add((doc, item))
    assert found == want and want


def test_reordered_and_clean(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)  # several blocks
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    other = "one two three four five six seven eight nine ten"
    moved = "noise " + " ".join(item.split()[6:]) + ". Then: " + " ".join(item.split()[:6]).upper() + " end"
    docs = spark.createDataFrame([(1, moved), (2, "alpha beta gamma delta nothing else here"), (3, f"{other} and {other}"), (None, item), (1, moved)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (8, other), (9, "too short"), (None, None), (7, item)], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"], round(r["coverage"], 2), r["n_tiles"]) for r in contaminated(docs, benchmark).collect())
    assert found == [(0, 7, 1.0, 1)] * 2 + [(1, 7, 1.0, 2)] * 4 + [(3, 8, 1.0, 1)]
    assert [r["doc_id"] for r in drop_contaminated(docs, benchmark).collect()] == [2]
    assert contaminated(odd_docs, benchmark).count() == 0 and drop_contaminated(odd_docs, benchmark).count() == odd_docs.count()
    assert contaminated(no_docs, benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0
    assert drop_contaminated(odd_docs, benchmark).columns == odd_docs.columns


def test_block_of_nothing():
    assert list(Block([]).matches("a b c d e f")) == [] and list(Block([(1, "a b c d e")]).matches(None)) == []
