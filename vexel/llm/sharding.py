"""Operator 10. Sharding by a hierarchical weighted hash tree (law ``key``).

Regions hold racks, racks hold shards. A key goes down the tree: at each level
every child of the node reached makes a weighted hash draw, ``-ln(u) / weight``
with ``u`` from the hash of key and the child's path and the summed weight of its
subtree, and the least draw wins. Nothing is drawn below a child that lost.

When weights change, draws change only along the paths to them: keys move into or
out of the region whose sum changed, inside it the rack, inside that the shard,
and nowhere else. A shard that is added to a tree in use is a region of its own
with one rack, so all that moves, moves into it.

Slots are dealt without gaps in two steps, so that no task holds a shard: rows
of a shard are spread over blocks, blocks are counted, and a row's slot is its
block's offset plus its rank within the block.

Edge cases: a null id is a key like any other (all such rows share a shard); a
null text has size 16 and checksum 0; equal ids share a shard and get different
slots; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.llm.common import materialize, table

ROW_OVERHEAD = 16
#: Rows that one task ranks at once, on average.
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class HashTree:
    """Shard i stands in region i mod regions and rack (i div regions) mod racks; each of the `added` last ones in a region of its own."""

    shards: int
    regions: int = 4
    racks: int = 2
    weights: dict[int, float] = field(default_factory=dict)
    added: int = 0

    def grown(self) -> HashTree:
        return replace(self, shards=self.shards + 1, added=self.added + 1)

    def layout(self) -> dict[int, dict[int, dict[int, float]]]:
        """Region -> rack -> shard -> weight, of shards of positive weight."""
        tree: dict[int, dict[int, dict[int, float]]] = {}
        planned = self.shards - self.added
        for i in range(self.shards):
            if (weight := float(self.weights.get(i, 1.0))) > 0:
                region, rack = (i % self.regions, i // self.regions % self.racks) if i < planned else (self.regions + i - planned, 0)
                tree.setdefault(region, {}).setdefault(rack, {})[i] = weight
        return tree

    def descend(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with region, rack and shard."""
        layout = self.layout()
        if not layout:
            raise ValueError("the tree has no shard of positive weight")

        def drawn(path: str, weight: float, child: int) -> Column:
            unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(1 << 53)
            return F.struct((-F.log(unit) / weight).alias("draw"), F.lit(child).alias("child"))

        def least(path: str, children: dict[int, float]) -> Column:
            """The child with the least draw; the only one wins without."""
            if len(children) == 1:
                return F.lit(next(iter(children)))
            return F.array_min(F.array(*[drawn(f"{path}/{c}", w, c) for c, w in children.items()])).getField("child")

        def where(chosen: Column, found: dict[int, Column]) -> Column:
            """Only the branch taken is evaluated."""
            out = F
            for value, column in found.items():
                out = out.when(chosen == value, column)
            return out

        sums = {g: {r: sum(shards.values()) for r, shards in racks.items()} for g, racks in layout.items()}
        rows = rows.withColumn("region", least("", {g: sum(racks.values()) for g, racks in sums.items()}))
        rows = rows.withColumn("rack", where(F.col("region"), {g: least(f"/{g}", racks) for g, racks in sums.items()}))
        shard = where(F.col("region"), {g: where(F.col("rack"), {r: least(f"/{g}/{r}", shards) for r, shards in racks.items()}) for g, racks in layout.items()})
        return rows.withColumn("shard", shard)


def assign_shards(docs: DataFrame, tree: HashTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, region, rack, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = tree.grown().descend(own, "doc_id").select("doc_id", "size", "text_crc32", F.col("shard").alias("grown_shard"))
    placed = tree.descend(placed, "doc_id").withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    blocks = max(1, -(-placed.count() // (tree.shards * BLOCK_ROWS)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "row"))
    ranked = placed.withColumn("rank", rank)
    slots = ranked.join(offsets, ["shard", "block"])
    return slots.select("doc_id", "size", "text_crc32", "region", "rack", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard")


SHARDS = 40


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), HashTree(SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
