"""Uploads as a stream of files, jobs with a status, event counts by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files

#: What a job may be.
STATUSES = ("queued", "processing", "completed", "partial", "failed", "cancelled")


def uploads(spark: SparkSession, path: str, capacity: int = 64) -> DataFrame:
    """New files under ``path``; a trigger takes ``capacity`` of them at most, and the rest wait."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", capacity).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = files.extension(name)
    return stream.select(
        F.sha2(F.col("path"), 256).alias("job_id"), name.alias("filename"), F.col("length").alias("size_bytes"), "modificationTime", "content",
        files.detect_format(ext, F.lit(None).cast("string"), files.magic(F.col("content"))).alias("format"), files.upload_error(name, F.col("length")).alias("error"),
    )


def run(stream: DataFrame, process: Callable[[DataFrame], DataFrame], jobs_path: str, out_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Process each micro-batch: results go to ``out_path`` and a job row each to ``jobs_path``.

    ``process`` takes the accepted rows and returns (job_id, ...). Both tables are written under the
    batch's number, so a batch that runs again replaces what it wrote.
    """

    def work(batch: DataFrame, number: int) -> None:
        batch.persist()
        good = batch.where("error IS NULL")
        where, failed = f"{out_path}/batch={number}", {}
        try:
            process(good).write.mode("overwrite").parquet(where)
        except Exception:
            # a failure is one job's: each is tried alone, as many as a trigger takes
            ids = [r["job_id"] for r in good.select("job_id").distinct().toLocalIterator()]
            written = False
            for job in ids:
                try:
                    process(good.where(F.col("job_id") == job)).write.mode("append" if written else "overwrite").parquet(where)
                    written = True
                except Exception as e:
                    failed[job] = str(e)[:500]
        why = F.create_map(*(F.lit(x) for pair in failed.items() for x in pair))[F.col("job_id")] if failed else F.lit(None).cast("string")
        rows = good.select("job_id", "filename", why.alias("error")).unionByName(batch.where("error IS NOT NULL").select("job_id", "filename", "error"))
        rows = rows.select("job_id", "filename", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error")
        rows.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{jobs_path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def job_states(spark: SparkSession, jobs_path: str) -> DataFrame:
    """The latest row of each job."""
    from ..operators.metrics import latest

    return latest(spark.read.parquet(jobs_path), "job_id", "updated_at")


def event_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; an extension, for batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("count"), F.sum("value").alias("sum"))
