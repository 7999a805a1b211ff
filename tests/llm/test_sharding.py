import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from vexel.llm.sharding import HashTree, assign_shards, op10_hash_tree_sharding


def test_table(spark, small_dir, corpus_rows):
    rows = op10_hash_tree_sharding(spark, small_dir).collect()
    text = dict(corpus_rows)
    assert len(rows) == len(corpus_rows)
    slots = {}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key" and 0 <= r["shard"] < 40
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r["grown_shard"] == 40 for r in rows)
    assert 0.3 * len(rows) / 41 < moved < 3 * len(rows) / 41


def test_tree_follows_weights_and_moves_inside_what_changed(spark):
    keys = spark.range(20_000)
    weights = {0: 3.0, 5: 0.0}
    before, after = HashTree(12, weights=weights), HashTree(12, weights={**weights, 2: 2.0})

    def placed(tree):
        return {r["id"]: (r["region"], r["rack"], r["shard"]) for r in tree.descend(keys, "id").collect()}

    a, b, c = placed(before), placed(after), placed(before.grown())
    n = Counter(s for _, _, s in a.values())
    assert n[5] == 0 and math.isclose(n[0] / n[1], 3, rel_tol=0.2) and math.isclose(n[0] / n[2], 3, rel_tol=0.2)
    moved = [(a[k], b[k]) for k in a if a[k] != b[k]]
    assert moved and {y[0] for _, y in moved} == {2}  # into the region of shard 2 only
    assert {y for x, y in moved if x[0] == 2 and x[1] != y[1]} == {(2, 0, 2), (2, 0, 10)} and {y[2] for x, y in moved if x[:2] == y[:2]} == {2}
    assert {c[k][2] for k in a if a[k] != c[k]} == {12} and HashTree(12, added=0).grown().layout()[4] == {0: {12: 1.0}}
    assert all((g, r) == (s % 4, s // 4 % 2) for g, r, s in a.values())


def test_descent_by_level(spark):
    """Region, then rack, then shard by the least draw of each level; draws of other subtrees don't matter."""
    tree = HashTree(16, weights={3: 2.5, 9: 0.5})
    layout = tree.layout()
    paths = [f"/{g}" for g in layout] + [f"/{g}/{r}" for g in layout for r in layout[g]] + [f"/{g}/{r}/{s}" for g in layout for r in layout[g] for s in layout[g][r]]
    drawn = spark.range(300).select("id", *[F.xxhash64("id", F.lit(p)).alias(p) for p in paths])
    for row in tree.descend(drawn, "id").collect():
        def draw(path, weight, row=row):
            return -math.log((((row[path] & (2**64 - 1)) >> 11) + 0.5) / 2**53) / weight

        region = min(layout, key=lambda g: draw(f"/{g}", sum(w for rack in layout[g].values() for w in rack.values())))
        rack = min(layout[region], key=lambda r: draw(f"/{region}/{r}", sum(layout[region][r].values())))
        assert (row["region"], row["rack"], row["shard"]) == (region, rack, min(layout[region][rack], key=lambda s: draw(f"/{region}/{rack}/{s}", layout[region][rack][s])))
    # moving weight between shards of one rack leaves every key's region and rack alone
    shifted = HashTree(16, weights={**tree.weights, 0: 1.5, 8: 0.5})
    both = [{r["id"]: r for r in t.descend(spark.range(5000), "id").collect()} for t in (tree, shifted)]
    moved = [(both[0][k]["shard"], both[1][k]["shard"]) for k in both[0] if both[0][k] != both[1][k]]
    assert set(moved) == {(8, 0)}


def test_odd_rows(odd_docs, no_docs):
    rows = assign_shards(odd_docs, HashTree(3)).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 and {r["text_crc32"] for r in rows if r["size"] == 16} == {0}
    assert assign_shards(no_docs, HashTree(3)).count() == 0
