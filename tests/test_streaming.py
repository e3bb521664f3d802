from pyspark.sql import functions as F

from docspark.streaming import batcher, jobs


def test_uploads_become_jobs(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("привет")
    (inbox / "b.exe").write_bytes(b"x")
    process = lambda rows: rows.select("job_id", F.decode("content", "UTF-8").alias("text"))
    query = jobs.run(jobs.uploads(spark, str(inbox), 1), process, str(tmp_path / "jobs"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    states = {r["filename"]: (r["status"], r["error"]) for r in jobs.job_states(spark, str(tmp_path / "jobs")).collect()}
    assert states == {"a.txt": ("completed", None), "b.exe": ("failed", "UNSUPPORTED_FILE_TYPE")}
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["привет"]


def test_batches_close_at_their_size_or_time(spark, tmp_path):
    folder = tmp_path / "requests"
    schema = "model string, request_id string, payload string"
    spark.createDataFrame([("m", str(i), f"p{i}") for i in range(10)], schema).coalesce(1).write.json(str(folder))
    stream = spark.readStream.schema(schema).json(str(folder))
    out = batcher.batched(stream, lambda texts: [f"{t}/{len(texts)}" for t in texts], size=4, wait_ms=1)
    query = out.writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.sql("SELECT * FROM batches").count() == 10:
                break
    finally:
        query.stop()
    rows = {r["request_id"]: r["result"] for r in spark.sql("SELECT * FROM batches").collect()}
    assert len(rows) == 10 and sorted(r.split("/")[1] for r in rows.values()) == ["2", "2"] + ["4"] * 8


def test_event_counts_by_window(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:04:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-01 00:06:00', 'a', 4.0D")
    assert sorted((r["count"], r["sum"]) for r in jobs.event_counts(rows).collect()) == [(1, 4.0), (2, 3.0)]
