import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vexel.llm import components, simhash
from vexel.llm.components import connected_components, star_forest
from vexel.llm.simhash import BKTree, block_choices, blocks_for, components_of, fingerprint, keep_one_of_each, near_duplicates, op9_simhash_bktree


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    rows = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Index of the least member of each one's class, by all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints(texts, corpus_rows):
    for text in [*texts[:3], *texts[4:8], texts[9], *(t for _, t in corpus_rows[:60]), "A b C", "É a Z", "one two"]:
        assert fingerprint(text or "") == plain_print(text)


def test_table_equals_all_pairs(spark, small_dir, corpus_rows):
    found = {r["doc_id"]: r for r in op9_simhash_bktree(spark, small_dir).collect()}
    ids = sorted(i for i, _ in corpus_rows)
    text = dict(corpus_rows)
    prints = [fingerprint(text[i]) for i in ids]
    root = classes(prints)
    assert [found[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in ids] == [ids[r] for r in root]


def test_bk_tree_and_blocks():
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(100)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]
    for blocks in range(4, 8):
        masks = block_choices(blocks)
        for v in values[:50]:
            w = v
            for b in rng.sample(range(64), 3):
                w ^= 1 << b
            assert any(v & m == w & m for m in masks)
    assert blocks_for(10) == 4 and blocks_for(10**9) > 4


def test_crowded_buckets_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 7)
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = [rng.choice(seeds) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(400)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    found = {r["doc_id"]: r["component_id"] for r in components_of(rows).collect()}
    assert [found[i] for i in range(400)] == classes(prints)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(None, 1), (5, None), (300, 300)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in sorted(near):
        pending = [node] if node not in want else []
        while pending:
            at = pending.pop()
            if at not in want:
                want[at] = node
                pending += near[at]
    assert found == want
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("block", [2, 7, 500_000])
def test_components_of_blocks(spark, monkeypatch, block):
    """Paths, hubs and random edges of signed ends, however few edges a task holds together."""
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    rng = random.Random(block)
    names = [rng.getrandbits(64) - (1 << 63) for _ in range(160)]
    edges = [(names[i], names[i + 1]) for i in range(40)] + [(names[50], names[i]) for i in range(51, 90)] + [(names[90 + rng.randrange(70)], names[90 + rng.randrange(70)]) for _ in range(40)]
    whole = {n: n for edge in edges for n in edge}
    for _ in whole:  # plain rounds of least labels
        for x, y in edges:
            whole[x] = whole[y] = min(whole[x], whole[y])
    a, b = star_forest(*(np.array(c, np.int64) for c in zip(*edges, strict=True)))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {n: least for n, least in whole.items() if n != least}
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges[i : i + 3], strict=True)], ["a", "b"]) for i in range(0, len(edges), 3)]
    blocks = [part.to_pylist() for part in components._stars(iter(batches))]
    parts = [tuple(e.values()) for block_edges in blocks for e in block_edges]
    assert all(x > y for x, y in parts) and (len(blocks) == 1) == (block == 500_000)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == whole
    again = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(parts, "a long, b long")).collect()}
    assert again == whole


def test_edges_of_one_block_take_no_rounds(spark, monkeypatch):
    """In however many tasks they lie, one closes them; more edges than a block take rounds until they are one."""
    rounds = []
    large_star = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges, n: rounds.append(n) or large_star(edges, n))
    rng = random.Random(8)
    order = rng.sample(range(300), 300)  # a path in no order, so that a task's edges are scattered pieces of it
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001)], "a long, b long")
    whole = {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}
    monkeypatch.setattr(components, "BLOCK_EDGES", 300)
    assert {r["node"]: r["component"] for r in connected_components(edges.repartition(7)).collect()} == whole and rounds == []
    monkeypatch.setattr(components, "BLOCK_EDGES", 100)
    assert {r["node"]: r["component"] for r in connected_components(edges.repartition(7)).collect()} == whole and rounds


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and near_duplicates(no_docs).count() == 0
    groups = defaultdict(set)
    for r in rows:
        groups[r["fp"]].add(r["component_id"])
    assert all(len(g) == 1 for g in groups.values())
    kept = keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(classes([fingerprint(r["text"] or "") for r in odd_docs.collect()])))
    assert keep_one_of_each(no_docs).count() == 0


def test_rows_kept_though_scans_are_cut_otherwise(spark, tmp_path, monkeypatch):
    """Between the two uses of the rows the table's partitions change, as when an executor is lost."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(40)]
    docs = [(i, texts[i % 40]) for i in range(60)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(docs, "doc_id long, text string").repartition(6).write.parquet(path)
    name, real = "spark.sql.files.maxPartitionBytes", simhash.components_of
    before = spark.conf.get(name)

    def moved(*given):
        out = real(*given)
        spark.conf.set(name, "4096")
        return out

    monkeypatch.setattr(simhash, "components_of", moved)
    try:
        found = simhash.keep_one_of_each(spark.read.parquet(path)).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(r["doc_id"] for r in found) == list(range(40))


def test_links_are_written_before_they_are_joined(spark, monkeypatch):
    """Else tasks run two Python steps side by side, and executors keep a worker for each."""
    plans = []

    def watched(edges):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return connected_components(edges)

    monkeypatch.setattr(simhash, "connected_components", watched)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in simhash.near_duplicates(docs).collect()) == [1, 1, 3]
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
