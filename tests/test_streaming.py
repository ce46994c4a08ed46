from quillspark.operators.chunk import Sizes, split_text
from quillspark.streaming import jobs


def test_index_new_files(spark, tmp_path):
    rows = [("/a", 1, "2024-01-01"), ("/b", 1, "2024-01-01"), ("/b", 1, "2024-01-01")]
    listing = spark.createDataFrame(rows, "path string, size long, mtime string").withColumn("mtime", __import__("pyspark.sql.functions", fromlist=["to_timestamp"]).to_timestamp("mtime"))
    listing.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    done = listing.where("path = '/a'")
    query = jobs.index_new_files(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda: done, lambda df: df.write.mode("append").parquet(out))
    query.awaitTermination(60)
    assert [r.path for r in spark.read.parquet(out).collect()] == ["/b"]


def test_task_states(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "pending"), (1, 2, "failed"), (2, 3, "completed")], "task long, seq long, status string")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = jobs.task_states(stream).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select * from states").collect()} == {(1, "failed", 1), (2, "completed", 0)}


def test_break_chunks():
    s = Sizes(150, 30, 30, 300)
    text = " ".join(f"Sentence number {i} ends here." for i in range(12))
    parts = split_text(text, s)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b[0] < a[1] and c.strip() for a, b in zip(parts, parts[1:]) for c in (a[2],))
    assert split_text("short", s) == [(0, 5, "short")] and split_text("", s) == []
