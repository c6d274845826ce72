"""Incremental ingest: a stream of documents kept as a newest-wins table of passages (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mnemix.sources import ingest


def ingest_stream(docs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's passages to the Parquet table, tagged by batch; a batch that is run again replaces itself.

    docs: (doc_seq, text, source). current() gives the newest definition of each id.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest.newest_wins(ingest.passages(batch)).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, table: str) -> DataFrame:
    return ingest.newest_wins(spark.read.parquet(table), order=("batch", "doc_seq", "passage_seq")).drop("batch")
