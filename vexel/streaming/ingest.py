"""Structured Streaming ingest: every micro-batch becomes one commit of a vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexel.sources.store import VectorTable


def ingest(stream: DataFrame, target: VectorTable, checkpoint: str, id_col: str, vector_col: str, text_col: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start inserting a stream's rows.

    Rows that a source delivers twice count once and ids that are already there
    are left alone, so a batch may be repeated; one id with different content in
    a batch is an error, as in any batch insert. Rows without an id are ignored.
    """
    columns = [c for c in (id_col, vector_col, text_col) if c]

    def commit(batch: DataFrame, _: int) -> None:
        fresh = batch.select(*columns).where(F.col(id_col).isNotNull()).dropDuplicates()
        known = target.to_df().select("unique_id")
        target.insert_frame(fresh.join(known, fresh[id_col].cast("string") == known["unique_id"], "left_anti"), id_col, vector_col, text_col=text_col)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
