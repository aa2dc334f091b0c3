"""Streaming ingestion: files of documents -> clean, chunk -> store, exactly once per (document, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import ids
from lodeweave.functions import text as tx
from lodeweave.operators import chunking
from lodeweave.sources.store import ChunkStore

DOCUMENTS = "tenant_id string, document_id string, text string, at timestamp"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh_documents(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cleaned rows with their digest; repeats of (tenant, document, content) within the watermark are dropped."""
    clean = stream.withColumn("text", tx.tidy_blanks(tx.repair_lines(tx.repair_characters(F.coalesce("text", F.lit(""))))))
    clean = clean.withColumn("digest", ids.digest(F.col("text"), None)).withWatermark("at", delay)
    return clean.dropDuplicatesWithinWatermark(["tenant_id", "document_id", "digest"])


def run_ingest(stream: DataFrame, store: ChunkStore, checkpoint: str, sizes: chunking.Sizes = chunking.Sizes()):
    """Start the query; each batch replaces the slices of its documents, so a replayed batch changes nothing."""

    def write(batch: DataFrame, _epoch: int) -> None:
        batch = batch.persist()
        made = chunking.chunk_documents(batch, sizes).join(batch.select("tenant_id", "document_id", "digest"), ["tenant_id", "document_id"]).persist()  # once, however many tenants
        for tenant in [r["tenant_id"] for r in batch.select("tenant_id").distinct().collect()]:  # a batch's tenants
            own = F.col("tenant_id") == tenant
            store.replace_documents(tenant, batch.where(own), made.where(own))
        made.unpersist()
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Event counts and sums per event-time window and type, late rows dropped after the delay."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def job_progress(items: DataFrame) -> DataFrame:
    """Per job: processed, succeeded ('unchanged' counts), failed, chunks and progress, from item rows (job_id, total, status, chunks)."""
    x = items.groupBy("job_id").agg(
        F.first("total").alias("total"), F.count("*").alias("processed"), F.count_if(F.col("status").isin("success", "unchanged")).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.sum("chunks").alias("chunks"),
    )
    done = F.when(F.col("total") > 0, F.round(F.col("processed") / F.col("total"), 4)).otherwise(1.0)
    state = F.when(F.col("processed") < F.col("total"), "running").when(F.col("succeeded") == 0, "failed").otherwise("completed")
    return x.withColumn("progress", done).withColumn("state", state)


def evicted_jobs(jobs: DataFrame, keep: int) -> DataFrame:
    """Jobs to forget so that keep remain: the oldest finished ones; running jobs never go. jobs: (job_id, finished_at)."""
    w = Window.partitionBy(F.col("finished_at").isNull()).orderBy("finished_at", "job_id")  # a bounded history
    excess = jobs.agg(F.greatest(F.lit(0), F.count("*") - keep).alias("excess"))
    ranked = jobs.withColumn("nth", F.row_number().over(w)).where("finished_at is not null")
    return ranked.crossJoin(F.broadcast(excess)).where("nth <= excess").select("job_id", "finished_at")


def evicted_entries(entries: DataFrame, limit: int) -> DataFrame:
    """Cache entries to drop, least recently used first, so that the sizes of the others fit limit; the newest always stays.

    entries: (name, used_at, size), a bounded catalogue."""
    w = Window.orderBy(F.desc("used_at"), F.desc("name"))
    kept = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("__kept", kept).withColumn("__nth", F.row_number().over(w)).where((F.col("__kept") > limit) & (F.col("__nth") > 1)).drop("__kept", "__nth")
