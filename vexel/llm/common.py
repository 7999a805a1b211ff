"""What the corpus operators share: table access, the shared scratch folder, batches of bounded size."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.scratch import materialize, scratch_dir

__all__ = ["fresh", "hub_join", "lean", "materialize", "salted_join", "scratch_dir", "ship", "table", "text_blocks", "text_slices"]

#: Rows of an Arrow batch that Python code holds as objects at once, and the bytes of text after which a slice ends.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20
#: Keys that hub_join broadcasts at most, and the rows that a key has at least to be one.
HUB_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each SparkContext, so that their Python workers can import it anywhere."""
    context = spark.sparkContext
    if not getattr(context, "_vexel_shipped", False):
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='vexel-')}/vexel", "zip", root, "vexel")
        context.addPyFile(archive)
        context._vexel_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by Spark's own reader, so that any store Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _heavy(total: int) -> int:
    """The rows of a key beyond which it is a hub: there can't be more than HUB_ROWS such keys."""
    return max(HUB_ROWS, total // HUB_ROWS)


def hub_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """rows joined with keyed, which has one row of numbers for each key and in n the rows of that key; total: rows, or more.

    Keys of more rows than HUB_ROWS, and than total / HUB_ROWS, meet their rows by
    broadcast; there can't be more than HUB_ROWS such keys. The others are shuffled.
    """
    keys, limit = [key] if isinstance(key, str) else key, _heavy(total)
    named = [c for c in keyed.columns if c not in (*keys, "n")]
    if total <= limit:
        return rows.join(keyed.drop("n"), keys)
    heavy = keyed.where(F.col("n") > limit).select(*keys, *[F.col(c).alias(f"__{c}") for c in named], F.lit(True).alias("__heavy"))
    met = rows.join(F.broadcast(heavy), keys, "left")
    ours = met.where("__heavy").select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in named])
    rest = met.where("__heavy IS NULL").select(*rows.columns).join(keyed.where(F.col("n") <= limit).drop("n"), keys)
    return ours.union(rest.select(*rows.columns, *named))


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, salt_by: str, total: int) -> DataFrame:
    """The same where keyed holds texts: hubs are cut by the hash of the column salt_by, and keyed's rows of hubs repeated for each cut; only hubs' keys are broadcast."""
    limit = _heavy(total)
    if total <= limit:
        return rows.join(keyed, key)
    hubs = F.broadcast(materialize(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__cuts")), "hubs"))
    cuts = F.coalesce("__cuts", F.lit(1))
    cut = rows.join(hubs, key, "left").withColumn("__salt", F.pmod(F.xxhash64(salt_by), cuts).cast("int")).drop("__cuts")
    repeated = keyed.join(hubs, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("__cuts")
    return cut.join(repeated, [key, "__salt"]).drop("__salt")


def give_back() -> None:
    """Return this process's free memory to the system: Arrow's, and where the C library is glibc its."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _run_lean(work: Callable[[Iterator], Iterator], batches: Iterator) -> Iterator:
    yield from work(batches)
    give_back()


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work for mapInArrow, that gives memory back when a task ends: its Python worker lives on beside tasks that need the memory."""
    return partial(_run_lean, work)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_blocks(batches: Iterator, columns: list[str], most_bytes: int) -> Iterator[list[list]]:
    """The slices of text_slices put together to blocks of about most_bytes."""
    block: list[list] = [[] for _ in columns]
    held = 0
    for part in text_slices(batches, columns):
        for own, new in zip(block, part, strict=True):
            own.extend(new)
        held += sum(len(x) for own in part for x in own if isinstance(x, str))
        if held >= most_bytes:
            yield block
            block, held = [[] for _ in columns], 0
    if block[0]:
        yield block


def text_slices(batches: Iterator, columns: list[str], most_rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """Arrow batches as lists of Python values, cut so that a slice holds few rows or few bytes of text."""
    for batch in batches:
        n, start = batch.num_rows, 0
        places = [batch.schema.get_field_index(c) for c in columns]
        while start < n:
            rows = min(most_rows, n - start)
            part = batch.slice(start, rows)
            while rows > 1 and part.get_total_buffer_size() and _bytes(part) > SLICE_BYTES:
                rows //= 2
                part = batch.slice(start, rows)
            yield [part.column(p).to_pylist() for p in places]
            start += rows


def _bytes(part) -> int:
    return part.nbytes
