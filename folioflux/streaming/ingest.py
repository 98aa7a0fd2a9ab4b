"""A file stream into a store: each micro-batch is one ingest, and repeats of a batch change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflux.functions import text as T
from folioflux.sources.store import Store


def ingest_stream(spark: SparkSession, source: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files of (source_uri, text) that arrive below source go into the store.

    A batch that is run again after a failure is left alone by the store, as its texts
    are unchanged; of rows with the same source_uri in a batch the smallest text stays.
    """
    rows = spark.readStream.schema("source_uri string, text string").parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        docs = batch.where("source_uri is not null and text is not null").groupBy("source_uri").agg(F.min("text").alias("text"))
        docs = docs.select(T.stable_doc_id(F.col("source_uri")).alias("doc_id"), "source_uri", "text", F.parse_json(F.lit("{}")).alias("metadata"))
        store.ingest(docs)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
