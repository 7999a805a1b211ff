"""Row numbers and shard placement without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.scratch import materialize

#: Bits of a row's place inside its partition, below the partition's number (fixed by Spark).
_PLACE_BITS = 33
#: Shards whose free places are summed up together.
_SPAN = 10_000


def with_positions(rows: DataFrame, order_by: list[str], position_col: str = "position") -> DataFrame:
    """rows with their place, from 0, in the order of the columns (nulls first; ties in any order).

    One range exchange sorts the rows; they are written once with their
    partition and their place in it, and both the partitions' sizes and the rows
    come from what was written. So later readers see one numbering, whatever
    columns they read and however tasks are cut or repeated. The sizes, one for
    each partition, are all that is broadcast.
    """
    placed = rows.repartitionByRange(*[F.asc(c) for c in order_by]).sortWithinPartitions(*[F.asc(c) for c in order_by])
    written = materialize(placed.withColumn("__place", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__place", _PLACE_BITS)
    sizes = written.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", _before(F.col("__n"), Window.orderBy("__part")).alias("__offset"))
    shifted = written.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return shifted.withColumn(position_col, F.col("__offset") + F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("__part", "__place", "__offset")


def _before(amount: Column, window: Window) -> Column:
    """The sum of the rows before, in the window's order."""
    return F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def append_shards(rows: DataFrame, shard_size: int, position_col: str = "position", shard_col: str = "shard_id") -> DataFrame:
    """Shards of an empty store: each filled before the next."""
    return rows.withColumn(shard_col, F.floor(F.col(position_col) / shard_size).cast("int"))


def first_fit(new: DataFrame, counts: DataFrame, shard_size: int, position_col: str = "position", shard_col: str = "shard_id") -> DataFrame:
    """new (positions from 0) with the first shard that has room: holes in the order of shards, then new shards.

    counts: shard id and rows n of every shard there is. Free places become rows,
    as many as new rows at most, and meet the new rows by their number. Holes are
    summed up in groups of _SPAN shards, so no task orders all shards.
    """
    room = F.coalesce(F.sum(F.greatest(F.lit(shard_size) - F.col("n"), F.lit(0))), F.lit(0))
    following, free = counts.agg(F.coalesce(F.max(shard_col) + 1, F.lit(0)), room).first()
    later = following + F.floor((F.col(position_col) - free) / shard_size)
    if not free:
        return new.withColumn(shard_col, later.cast("int"))
    total = new.count()
    span = F.floor(F.col(shard_col) / _SPAN)
    holes = counts.where(F.col("n") < shard_size).select(F.col(shard_col).alias("__shard"), span.alias("__span"), (F.lit(shard_size) - F.col("n")).alias("__free"))
    spans = holes.groupBy("__span").agg(F.sum("__free").alias("__sum"))
    spans = spans.select("__span", _before(F.col("__sum"), Window.orderBy("__span")).alias("__base"))
    start = F.col("__base") + _before(F.col("__free"), Window.partitionBy("__span").orderBy("__shard"))
    begun = holes.join(F.broadcast(spans), "__span").select("__shard", "__free", start.alias("__from")).where(F.col("__from") < total)
    places = begun.select("__shard", F.explode(F.sequence("__from", F.least(F.col("__from") + F.col("__free"), F.lit(total)) - 1)).alias("__number"))
    placed = new.join(places, new[position_col] == places["__number"], "left")
    return placed.withColumn(shard_col, F.coalesce("__shard", later).cast("int")).drop("__shard", "__number")
