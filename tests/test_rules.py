"""Rules of the operators on small cases, worked out by hand or by loops."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunk, rag
from quillspark.operators.chunk import Sizes, split_text
from quillspark.sources import files
from quillspark.streaming import jobs

SMALL = Sizes(150, 30, 30, 300)


def test_windows_end_at_chinese_sentences():
    text = "".join(f"這是第{'一二三四五六七八九十'[i % 10]}句話這裡有一些文字。" for i in range(30))
    parts = split_text(text, SMALL)
    assert len(parts) > 2 and all(c.endswith("。") for *_, c in parts)
    listed = "、".join(["甲乙丙丁戊己庚"] * 60)
    assert all(c.endswith("、") for *_, c in split_text(listed, SMALL)[:-1])


def test_windows_end_at_sentences_not_in_numbers():
    text = "This is the first sentence. This is the second sentence. This is the third sentence. This is the fourth sentence. This is the fifth sentence."
    (a, b, first), *_ = split_text(text + " " + text, SMALL)
    assert (a, first[-1]) == (0, ".") and b <= 150
    numbers = "x" * 130 + " 1,000" + "0" * 200
    assert split_text(numbers, SMALL)[0][2] == "x" * 130
    assert split_text("word " * 200, SMALL)[0][:2] == (0, 150)
    assert [x[0] for x in split_text("y" * 400, SMALL)] == [0, 120, 240, 360]


def test_best_kind_of_break_wins():
    text = "a" * 125 + "\n\n" + "b" * 5 + ". " + "c" * 300
    assert split_text(text, SMALL)[0][2] == "a" * 125
    text = "a" * 121 + "? bb" + ". " + "c" * 4 + "! " + "d" * 300
    assert split_text(text, SMALL)[0][2].endswith("bb.")


@pytest.mark.parametrize("n", [4, 100])
def test_even_sample(spark, n):
    sizes = [*range(1, 40), 101, 113, 147, 199, 200, 201, 333, 999, 1000, 1001, 1234, 2048, 2999]
    rows = spark.createDataFrame([(s,) for s in sizes], "doc_id int").select("doc_id", F.col("doc_id").alias("total_chunks"), F.explode(F.sequence(F.lit(0), F.col("doc_id") - 1)).alias("chunk_index"))
    got = {}
    for r in rag.even_sample(rows, n).collect():
        got.setdefault(r.doc_id, []).append(r.chunk_index)
    for s in sizes:
        want = list(range(s)) if s <= n else [math.floor(i * (s / n)) for i in range(n)]
        assert sorted(got[s]) == want, s


def test_folders_and_names(spark):
    rows = spark.createDataFrame([("/home/.me/docs/a.txt",), ("/home/.me/docs/.git/a.txt",), ("/home/.me/docs/Cache/x/a.txt",), ("/srv/.x/a.txt",)], "path string")
    skipped = lambda *roots: [r[0] for r in rows.select(files.skipped_folder(F.col("path"), ("cache",), roots)).collect()]
    assert skipped("/home/.me/docs", "/home") == [False, True, True, True]
    assert skipped("/home") == [True, True, True, True]
    names = spark.createDataFrame([("/a/Thumbs.db",), ("/a/thumbs.DB",), ("/a/b.DB",)], "path string")
    assert [r[0] for r in names.select(files.skipped_file(F.col("path"), names=("Thumbs.db",), supported=(".db",))).collect()] == [True, True, False]


def test_scan_of_a_tree(spark, tmp_path):
    for name in ("a.PDF", "sub/b.txt", "sub/deep/c.tar.gz"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * len(name))
    got = {r.path.rpartition("/")[2]: r for r in files.scan(spark, [str(tmp_path)], with_hash=True).collect()}
    assert {k: (r.size, r.extension) for k, r in got.items()} == {"a.PDF": (5, ".pdf"), "b.txt": (9, ".txt"), "c.tar.gz": (17, ".gz")}
    assert all(len(r.sha256) == 64 and r.mtime is not None for r in got.values())
    assert all(r.sha256 is None for r in files.scan(spark, [str(tmp_path)]).collect())


def test_newer_version_is_handed_over(spark, tmp_path):
    rows = [("/a", 1, "2024-01-01"), ("/b", 1, "2024-01-01"), ("/b", 2, "2024-01-02"), ("/c", 3, "2024-01-03"), ("/c", 3, "2024-01-02")]
    listing = spark.createDataFrame(rows, "path string, size long, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    for order in (F.asc("size"), F.desc("size")):
        here = tmp_path / str(order)
        listing.orderBy("path", order).coalesce(1).write.parquet(str(here / "in"))
        done, seen = listing.where("size = 1 or path = '/c' and mtime < '2024-01-03'"), []
        work = lambda df: seen.extend((r.path, r.size) for r in df.collect())
        jobs.index_new_files(spark, str(here / "in"), str(here / "cp"), lambda: done, work).awaitTermination(60)
        assert sorted(seen) == [("/b", 2), ("/c", 3)]


class State:
    """A stand-in for the state of one key."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.timeout = value, None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_timeout_keeps_the_place_in_the_log():
    import pandas as pd

    state = State()
    step = lambda *events: next(iter(jobs.task_step((7,), iter([pd.DataFrame(events, columns=["seq", "status"])]) if events else iter([]), state, 1000))).iloc[0].tolist()
    assert step((5, "processing"), (2, "failed")) == [7, "processing", 1] and state.timeout == 1000
    state.hasTimedOut = True
    assert step() == [7, "pending", 1] and state.timeout is None
    state.hasTimedOut = False
    assert step((3, "completed")) == [7, "pending", 1]  # older than what the state has seen
    assert step((6, "completed")) == [7, "completed", 1]


def test_duplicates_on_a_stream_are_suppressed(spark, tmp_path):
    rows = [("/a", "t", "2024-01-01 00:00:00"), ("/a", "t", "2024-01-01 00:05:00"), ("/a", "u", "2024-01-01 00:05:00"), ("/b", "t", "2024-01-01 00:06:00")]
    tasks = spark.createDataFrame(rows, "file_path string, task_type string, added_at string").withColumn("added_at", F.to_timestamp("added_at"))
    tasks.write.parquet(str(tmp_path / "in"))
    stream = jobs.suppress_duplicates(spark.readStream.schema(tasks.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.file_path, r.task_type) for r in spark.sql("select * from once").collect()) == [("/a", "t"), ("/a", "u"), ("/b", "t")]


def test_intents(spark):
    cases = {
        "combien de livres dans ~/books ?": "factual", "liste-moi les fichiers PDF de ~/Documents/": "factual", "how many files do you have in /srv?": "factual",
        "Quels fichiers sont indexés dans ~/Downloads ?": "factual", "est-ce que tu as des documents en chinois ?": "factual", "résume-moi ce livre": "summarize",
        "fais-moi un résumé complet de ce livre": "summarize", "Summarize the entire report_2025.pdf": "summarize", "explique-moi le fonctionnement": "rag", "": "rag",
        None: "rag", "Que dit ce document sur les délais ?": "rag", "counter listing": "rag", "count and summarise": "summarize",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "prompt string")
    assert {r.prompt: r.intent for r in rows.select("prompt", T.intent(F.col("prompt")).alias("intent")).collect()} == cases


def test_marks_take_terms_as_they_are(spark):
    rows = spark.createDataFrame([("a.c abc A.C éa.c a.c!",)], "t string")
    assert rows.select(T.highlight(F.col("t"), "a.c")).first()[0] == "<em>a.c</em> abc <em>A.C</em> éa.c <em>a.c</em>!"


def test_normalised_scores(spark):
    rows = spark.createDataFrame([(0.4, 0, 9), (3.0, 0, 9), (-1.0, 0, 9), (None, 3, 4), (None, 0, 1)], "s double, r int, n int")
    assert [r[0] for r in rows.select(T.normalised_score(F.col("s"), F.col("r"), F.col("n"))).collect()] == [0.4, 0.25, 0.5, 0.25, 1.0]


def test_chunk_results_and_rechunk(spark):
    docs = spark.createDataFrame([(1, "word " * 400), (2, " "), (3, "short"), (4, None)], "doc_id long, content string")
    assert {r.doc_id: (r.chunks, r.success, r.error) for r in chunk.chunk_results(docs).collect()} == {
        1: (2, True, None), 2: (0, False, "Empty document text"), 3: (1, True, None), 4: (0, False, "Empty document text"),
    }
    old = chunk.fixed_chunks(spark.createDataFrame([(1, "old " * 1000), (3, "old three"), (9, "nine")], "doc_id long, content string"))
    new, outcome = chunk.rechunk(docs, old)
    assert sorted((r.doc_id, r.chunk_index) for r in new.collect()) == [(1, 0), (1, 1), (3, 0), (9, 0)]
    assert {r.doc_id: (r.removed, r.written, r.estimate) for r in outcome.collect()} == {1: (3, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
