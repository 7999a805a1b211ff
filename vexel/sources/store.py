"""Vector tables: versioned Parquet with snapshot reads, appends, deletes by tombstone, capacity shards and search.

A version is a small manifest that lists data and tombstone folders; a commit
writes its files first and then creates the new manifest, which fails if another
writer took its number, so readers always see a whole version and a failed write
changes nothing. An insert writes only its own rows and a delete only its row
numbers. Where MERGE_FOLDERS small inserts have gathered, the next one rewrites
these as one folder; compact() rewrites all. Writers of one table share a lock;
readers take none.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.operators.autocut import autocut as cut_results
from vexel.operators.placement import append_shards, first_fit, with_positions
from vexel.operators.rerank import WEIGHTS, hybrid_rerank, hybrid_rerank_results
from vexel.operators.search import COSINE, INT8, top_k
from vexel.plans.filters import METADATA, Filter, Tagged, compile_filters, decode_metadata, encode_metadata

SCHEMA = T.StructType([
    T.StructField("row_num", T.LongType()), T.StructField("unique_id", T.StringType()), T.StructField("id_type", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", METADATA), T.StructField("source", T.StringType()), T.StructField("shard_id", T.IntegerType()),
])
#: Rows of one shard unless a table says otherwise (fixed value).
SHARD_SIZE = 5000
#: Data folders of fewer than SMALL_ROWS rows that a version lists before they are written together.
MERGE_FOLDERS, SMALL_ROWS = 32, 100_000


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    dimension: int | None = None
    next_row: int = 0
    data: tuple[str, ...] = ()
    deletes: tuple[str, ...] = field(default=())
    sizes: tuple[int, ...] = field(default=())  # rows of each data folder


def id_key(unique_id: Any) -> tuple[str, str]:
    """An id as text and its type, so that 1 and "1" differ and 1 and 1.0 don't."""
    if isinstance(unique_id, str):
        return unique_id, "str"
    if isinstance(unique_id, (bool, int)) or isinstance(unique_id, float) and unique_id.is_integer():
        return str(int(unique_id)), "int"
    return repr(unique_id), type(unique_id).__name__


def id_value(text: str, kind: str) -> Any:
    return int(text) if kind == "int" else float(text) if kind == "float" else text


class VectorTable:
    """A collection of (unique id, vector, metadata). sharded: capacity shards, short metadata is padded; else one shard, short metadata is an error."""

    def __init__(self, spark: SparkSession, path: str, sharded: bool = True, shard_size: int = SHARD_SIZE, metric: str = COSINE) -> None:
        if shard_size <= 0:
            raise ValueError("shard_size must be positive")
        self.spark, self.path, self.sharded, self.shard_size, self.metric = spark, path.rstrip("/"), sharded, shard_size, metric
        self.lock = threading.Lock()
        self.manifest = self._load()

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> VectorTable:
        return cls(spark, path, **options)

    # storage

    def _fs(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _load(self) -> Manifest:
        fs, folder = self._fs(f"{self.path}/_versions")
        if not fs.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        versions = sorted((int(n.split(".")[0]) for n in names if n.endswith(".json")), reverse=True)
        for version in versions:
            text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/_versions/{version:010d}.json").collect())
            try:
                loaded = json.loads(text)
            except json.JSONDecodeError:
                continue  # a writer died before it was whole; its number stays taken
            return Manifest(**{**loaded, **{k: tuple(loaded[k]) for k in ("data", "deletes", "sizes")}, "version": versions[0]})
        return Manifest(version=versions[0] if versions else 0)

    def _commit(self, manifest: Manifest) -> None:
        """Create the manifest under its number, if nobody has done so."""
        fs, folder = self._fs(f"{self.path}/_versions")
        fs.mkdirs(folder)
        _, name = self._fs(f"{self.path}/_versions/{manifest.version:010d}.json")
        try:
            out = fs.create(name, False)
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
            out.close()
        except Exception as error:
            raise RuntimeError(f"version {manifest.version} of {self.path} was committed by another writer") from error
        self.manifest = manifest

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _rows(self, folder: str) -> int:
        return self.spark.read.parquet(f"{self.path}/{folder}").count()

    def _merged(self, manifest: Manifest) -> Manifest:
        """The manifest with its small folders written as one, once they are many."""
        small = [d for d, n in zip(manifest.data, manifest.sizes, strict=True) if n < SMALL_ROWS]
        if len(small) < MERGE_FOLDERS:
            return manifest
        folder = self._write(self._read(small).coalesce(1 + sum(manifest.sizes) // (8 * SMALL_ROWS)), "data")
        large = [(d, n) for d, n in zip(manifest.data, manifest.sizes, strict=True) if n >= SMALL_ROWS]
        kept = [*large, (folder, self._rows(folder))]
        return replace(manifest, data=tuple(d for d, _ in kept), sizes=tuple(n for _, n in kept))

    def to_df(self, manifest: Manifest | None = None) -> DataFrame:
        """The live rows of a version (the current one)."""
        manifest = manifest or self.manifest
        if not manifest.data:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self._read(manifest.data)
        if manifest.deletes:
            gone = self.spark.read.schema("row_num long").parquet(*[f"{self.path}/{d}" for d in manifest.deletes])
            rows = rows.join(gone, "row_num", "left_anti")
        return rows.select(*SCHEMA.names)

    def _read(self, folders: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{d}" for d in folders])

    def compact(self) -> None:
        """Rewrite the live rows as one data folder, with row numbers closed up in order."""
        with self.lock:
            rows = with_positions(self.to_df().drop("shard_id").withColumnRenamed("row_num", "old"), ["old"], "row_num").drop("old")
            rows = append_shards(rows, self.shard_size if self.sharded else 1 << 31, "row_num").select(*SCHEMA.names)
            n = self.count()
            data = (self._checked(rows, n),) if n else ()
            self._commit(replace(self.manifest, version=self.manifest.version + 1, next_row=n, data=data, deletes=(), sizes=(n,) if n else ()))

    def _checked(self, rows: DataFrame, n: int) -> str:
        """A data folder with the rows, which must be n."""
        folder = self._write(rows, "data")
        if (written := self._rows(folder)) != n:
            raise RuntimeError(f"{written} rows were written where {n} were expected; nothing is committed")
        return folder

    persist_to_disk = compact

    # introspection

    def count(self) -> int:
        return self.to_df().count()

    def __len__(self) -> int:
        return self.count()

    @property
    def embedding_size(self) -> int | None:
        return self.manifest.dimension

    def shard_map(self) -> DataFrame:
        """shard_id and its rows n."""
        return self.to_df().groupBy("shard_id").agg(F.count("*").alias("n"))

    def presence_index(self) -> DataFrame:
        """Metadata key and the number of rows that have it."""
        return self.to_df().select(F.explode(F.map_keys("metadata")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))

    def get_vector(self, unique_id: Any) -> list[float]:
        text, kind = id_key(unique_id)
        found = self.to_df().where((F.col("unique_id") == text) & (F.col("id_type") == kind)).select("embedding").take(1)
        if not found:
            raise ValueError("Unique ID does not exist.")
        return list(found[0][0])

    # changes

    def store_embedding(self, unique_id: Any, embedding: Sequence[float], metadata_dict: Mapping[str, Any] | None = None, text: str | None = None) -> None:
        self.store_embeddings_batch([unique_id], [embedding], [metadata_dict or {}], None if text is None else [text])

    def store_embeddings_batch(self, unique_ids: Sequence[Any], embeddings: Sequence[Sequence[float]], metadata_dicts: Sequence[Mapping[str, Any]] = (), texts: Sequence[str] | None = None) -> None:
        """Insert rows, all or none."""
        if len(unique_ids) != len(embeddings):
            raise ValueError("The number of unique IDs and embeddings must match.")
        if metadata_dicts and len(metadata_dicts) != len(unique_ids) and not (self.sharded and len(metadata_dicts) < len(unique_ids)):
            raise ValueError("The number of unique IDs and metadata dictionaries must match.")
        if not unique_ids:
            return
        metadata = [*metadata_dicts, *([{}] * (len(unique_ids) - len(metadata_dicts)))]
        keys = [id_key(u) for u in unique_ids]
        if len(set(keys)) != len(keys):
            raise ValueError("A unique ID stands twice in the batch.")
        vectors = [[float(x) for x in e] for e in embeddings]
        dimension = self.manifest.dimension or len(vectors[0])
        if any(len(v) != dimension for v in vectors):
            raise ValueError(f"Every embedding must have {dimension} elements.")
        rows = [(i, *key, vector, encode_metadata(m), None if texts is None else texts[i]) for i, (key, vector, m) in enumerate(zip(keys, vectors, metadata, strict=True))]
        schema = T.StructType([T.StructField("position", T.LongType()), *SCHEMA.fields[1:-1]])
        self._insert(self.spark.createDataFrame(rows, schema), len(rows), dimension)

    def insert_frame(self, rows: DataFrame, id_col: str, vector_col: str, metadata_col: str | None = None, text_col: str | None = None) -> None:
        """Insert the rows of a DataFrame, in the order of their ids, all or none. metadata_col: a map of tagged values."""
        kind = "str" if isinstance(rows.schema[id_col].dataType, T.StringType) else "int"
        own = rows.select(
            F.col(id_col).cast("string").alias("unique_id"), F.lit(kind).alias("id_type"), F.col(vector_col).cast("array<float>").alias("embedding"),
            (F.col(metadata_col) if metadata_col else F.create_map()).cast(METADATA).alias("metadata"), (F.col(text_col) if text_col else F.lit(None).cast("string")).alias("source"),
            F.col(id_col).alias("__order"),
        )
        checks = own.agg(F.count("*").alias("n"), F.countDistinct("unique_id").alias("ids"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if checks["n"] != checks["ids"]:
            raise ValueError("A unique ID is missing or stands twice in the batch.")
        if not checks["n"]:
            return
        dimension = self.manifest.dimension or checks["low"]
        if not checks["low"] == checks["high"] == dimension:
            raise ValueError(f"Every embedding must have {dimension} elements.")
        self._insert(with_positions(own, ["__order"]).drop("__order"), checks["n"], dimension)

    def _insert(self, new: DataFrame, n: int, dimension: int) -> None:
        with self.lock:
            live = self.to_df()
            taken = new.select("unique_id", "id_type").join(live.select("unique_id", "id_type"), ["unique_id", "id_type"], "left_semi").take(1)
            if taken:
                raise ValueError(f"Unique ID already exists: {taken[0][0]}")
            size = self.shard_size if self.sharded else 1 << 31
            placed = first_fit(new, live.groupBy("shard_id").agg(F.count("*").alias("n")), size)
            rows = placed.withColumn("row_num", F.col("position") + self.manifest.next_row).select(*SCHEMA.names)
            data = self._checked(rows, n)
            m = self._merged(self.manifest)
            self._commit(replace(m, version=m.version + 1, dimension=dimension, next_row=m.next_row + n, data=(*m.data, data), sizes=(*m.sizes, n)))

    def delete_embedding(self, unique_id: Any) -> None:
        self.delete_embeddings_batch([unique_id])

    def delete_embeddings_batch(self, unique_ids: Any) -> None:
        """Delete rows, all or none."""
        ids = list(unique_ids) if isinstance(unique_ids, (list, tuple, set)) else [unique_ids]
        if not ids:
            raise ValueError("No unique IDs provided.")
        keys = sorted({id_key(u) for u in ids})
        wanted = self.spark.createDataFrame(keys, "unique_id string, id_type string")
        with self.lock:
            gone = self.to_df().join(wanted, ["unique_id", "id_type"], "left_semi").select("row_num")
            if gone.count() != len(keys):
                raise ValueError("Unique ID does not exist.")
            m = self.manifest
            self._commit(replace(m, version=m.version + 1, deletes=(*m.deletes, self._write(gone, "deletes"))))

    def migrate_from(self, other: VectorTable) -> None:
        """Take over all rows of another table, in the order of their row numbers."""
        rows = other.to_df().select(F.col("row_num").alias("__order"), "unique_id", "id_type", "embedding", "metadata", "source")
        n = rows.count()
        if n:
            self._insert(with_positions(rows, ["__order"]).drop("__order"), n, other.embedding_size)

    # search

    def search(self, embedding: Sequence[float], metadata_filter: Filter = None, exclude_filter: Filter = None, or_filters: Filter = None, k: int = 5, autocut: bool = False, **options: Any) -> DataFrame:
        """rank, unique_id, id_type, score, metadata and source of the nearest rows that qualify."""
        where = compile_filters(Tagged("metadata"), metadata_filter, exclude_filter, or_filters, **options)
        found = top_k(self.to_df(), embedding, k, where, metric=self.metric)
        found = cut_results(found, ascending=self.metric == INT8) if autocut else found
        return found.select("rank", "unique_id", "id_type", "score", "metadata", "source").orderBy("rank")

    def find_most_similar(self, embedding: Sequence[float], metadata_filter: Filter = None, exclude_filter: Filter = None, or_filters: Filter = None, k: int = 5, autocut: bool = False, **options: Any) -> tuple[list, list, list]:
        """Ids, scores and metadata of the same, as lists."""
        rows = self.search(embedding, metadata_filter, exclude_filter, or_filters, k, autocut, **options).collect()
        return [id_value(r["unique_id"], r["id_type"]) for r in rows], [r["score"] for r in rows], [decode_metadata(r["metadata"]) for r in rows]

    def hybrid_search(self, embedding: Sequence[float], query: str, k: int = 5, candidates: int = 20, weights: Sequence[float] = WEIGHTS, **filters: Any) -> DataFrame:
        """The nearest rows, reranked by the text that was stored with them."""
        found = self.search(embedding, k=candidates, **filters).withColumnRenamed("source", "text")
        return hybrid_rerank(found, query, k, weights)

    hybrid_rerank_results = staticmethod(hybrid_rerank_results)
