"""Idempotent ingest of a stream of documents into a store of points: each micro-batch is compared with the metadata, embedded, written and versioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions import text as X
from tessella.operators import chunking, search
from tessella.operators.point_store import PointStore
from tessella.sources import elements

DOCUMENT = "doc_id string, collection string, source string, content_type string, text string, sent_at timestamp"


def chunked(documents: DataFrame) -> DataFrame:
    """The chunks of documents (collection, doc_id, text, source, content_type), by type."""
    keyed = documents.withColumn("_key", F.to_json(F.struct("collection", "doc_id")))
    parsed = elements.parse(keyed.select(F.col("_key").alias("doc_id"), "text", "source", "content_type")).drop("warning")
    chunks = chunking.chunk(parsed, "markdown_structure").withColumn("_key", F.col("doc_id")).drop("doc_id")
    return chunks.join(keyed.select("_key", "collection", "doc_id", "source"), "_key").drop("_key")


def embedded(chunks: DataFrame) -> DataFrame:
    """The stand-in for an embedding model."""
    return chunks.withColumn("embedding", search.hashed_embedding("content"))


def ingest_batch(batch: DataFrame, number: int, store: str, embed=embedded, layout: DataFrame | None = None) -> None:
    """One micro-batch into a PointStore: points with vectors and payload, versions and metadata of what is new or changed.

    Only buckets that the batch's documents fall into are read and rewritten; a batch that is run again changes nothing.
    Of rows of one document the last sent counts, and of those sent together the one of the greatest content hash. A
    version's time is the document's sent_at, or the batch's number where it has none, so that a rerun gives the same.
    """
    w = Window.partitionBy("doc_id", "collection").orderBy(F.desc("sent_at"), F.desc("content_hash"))
    named = batch.withColumns({"doc_id": F.coalesce("doc_id", X.doc_id("text")), "collection": F.coalesce("collection", F.lit("default")), "content_hash": X.content_hash(F.coalesce("text", F.lit("")))})
    latest = named.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    at = F.coalesce(F.col("sent_at"), F.timestamp_seconds(F.lit(number)))
    PointStore(batch.sparkSession, store).ingest(latest, chunked, embed, at, number, layout)


def start(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Watch a folder of Parquet files and ingest what arrives; ends when all that is there has been read."""
    stream = spark.readStream.schema(DOCUMENT).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of an event stream by type and tumbling window; what is later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
