"""Operators without SQL, and bounds, on small cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import filters, index, rag, search, vectors
from quillspark.plans import answers
from quillspark.sources import files
from quillspark.streaming import jobs


@pytest.mark.parametrize("bad", [dict(query=""), dict(query="x" * 1001), dict(limit=0), dict(limit=101), dict(offset=-1), dict(mode="best"), dict(sort="color")])
def test_request_bounds(bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        filters.Request(**({"query": "ok"} | bad))


def test_request_takes_what_is_in_bounds():
    r = filters.Request("q" * 1000, limit=100, offset=10**6, mode="semantic", sort="title")
    assert (r.limit, r.mode, r.filters) == (100, "semantic", filters.Filter())


def test_filters_of_missing_values(spark):
    rows = [(1, None, None, None, None, None), (2, "text", "en", ".TXT", "/A/Docs/x", "2024-05-01T10:00:00"), (3, "text", "en", ".md", "/b", "nonsense")]
    docs = spark.createDataFrame(rows, "id long, category string, language string, file_type string, path string, created_at string")
    ids = lambda f: sorted(r.id for r in docs.where(f.on()).collect())
    assert ids(filters.Filter()) == [1, 2, 3]
    assert ids(filters.Filter(category="text", language="en")) == [2, 3]
    assert ids(filters.Filter(file_types=(".txt",))) == [2]
    assert ids(filters.Filter(path_contains="a/DOCS")) == [2]
    assert ids(filters.Filter(date_after="2024-06-01")) == [1, 3]
    assert ids(filters.Filter(date_before="2024-06-01")) == [1, 2, 3]


def test_approximate_neighbours_reach_nine_in_ten(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        e = spark.read.parquet(f"{sf}/embeddings.parquet")
        rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector"))
        want = {(r.query_id, r.id) for r in vectors.knn(q, rows, 10).collect()}
        got = {(r.query_id, r.id) for r in answers.v8_approximate_knn(spark, sf).collect()}
        assert len(want & got) >= 0.9 * len(want), (sf, len(want & got), len(want))
        cells = vectors.fit_cells(rows, 24)
        assert vectors.assign_cells(rows, cells).count() == rows.count()


def test_neighbours_of_equal_and_missing_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(9, 0, -1)] + [(20, None), (21, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>").repartition(4)
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, qvector array<float>")
    assert [(r.query_id, r.id, r.rank) for r in vectors.knn(q, v, 3).orderBy("rank").collect()] == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3)]
    assert vectors.knn(q, v.limit(0), 3).count() == 0 and vectors.knn(q.limit(0), v, 3).count() == 0


def test_embeddings(spark):
    rows = spark.createDataFrame([("One two TWO",), ("two one two",), (" ",), (None,), ("x " * 50_000,)], "t string")
    a, b, blank, none, long = (r[0] for r in rows.select(vectors.embed(F.col("t"))).collect())
    assert a == b and not any(blank) and not any(none) and len(a) == vectors.DIMENSIONS
    assert abs(sum(x * x for x in a) - 1) < 1e-6 and sorted(map(abs, long))[-1] == 1


def brute_nearness(query, attributes):
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    asked, total = list(dict.fromkeys(words(query))), 0
    for a, b in zip(asked, asked[1:]):
        gaps = [abs(i - j) for t in attributes for i, x in enumerate(words(t)) for j, y in enumerate(words(t)) if x == a and y == b]
        total += min([8, *gaps])
    return total


def test_nearness(spark):
    docs = {1: ("t", "red fox jumps over a lazy dog"), 2: ("red", "fox x x x x jumps x dog x jumps"), 3: ("t", "dog jumps fox red"), 4: ("fox jumps", "red " * 9 + "fox")}
    rows = spark.createDataFrame([(i, *x) for i, x in docs.items()], "id long, title string, content string")
    queries = {1: "red fox jumps dog", 2: "dog", 3: "fox red"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    got = search.keyword_search(q, search.postings(rows, ("title", "content")), 10, proximity=True).collect()
    full = [r for r in got if r.words == len(queries[r.query_id].split())]
    assert len(full) > 6
    for r in full:
        assert r.proximity == brute_nearness(queries[r.query_id], docs[r.id])
    order = lambda n: [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == n and r.words == len(queries[n].split())]
    assert order(3) == [4, 1, 3, 2]  # by the gap, then by the better attribute
    by_title = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id long, key string")
    for descending, want in ((False, [2, 1, 4, 3]), (True, [4, 1, 2, 3])):
        found = search.keyword_search(spark.createDataFrame([(2, "dog")], "query_id long, query string"), search.postings(rows.withColumn("title", F.lit("t")), ("title", "content")), 10, sort=by_title, descending=descending)
        assert [r.id for r in found.orderBy("rank").collect()] == [i for i in want if i != 4]


def test_states_of_snapshots(spark, tmp_path):
    folder, schema = f"{tmp_path}/state", "path string, size long"
    assert files.load_state(spark, folder, schema).count() == 0
    for n, rows in enumerate(([("/a", 1)], [("/a", 2), ("/b", 1)])):
        files.save_state(spark.createDataFrame(rows, schema), folder, n)
        assert sorted(map(tuple, files.load_state(spark, folder, schema).collect())) == rows
    files.clear_state(spark, folder, schema, 2)
    assert files.load_state(spark, folder, schema).count() == 0


def test_summaries_as_they_come(spark, tmp_path):
    schema = "doc_id long, part int, text string"
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    seen = []
    for rows in ([(1, 0, "a"), (2, 0, "x")], [(1, 1, "b")], [(1, 0, "A"), (3, 0, "new")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.summary_stream(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination(60)
        seen.append({r.doc_id: r.text for r in jobs.read_summaries(spark, out).collect()})
    assert seen == [{1: "a", 2: "x"}, {1: "a\n\nb", 2: "x"}, {1: "A\n\nb", 2: "x", 3: "new"}]


def test_index_job_again(spark):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x] or [], "path string")
    texts = spark.createDataFrame([("a", "t", None), ("b", " ", None), ("c", "t", "bad"), ("d", "t", None)], "path string, text string, error string")
    run = lambda **k: {r.path: r.outcome for r in index.index_files(rows("a", "b", "c", "d", "d", "e"), rows("a", "a"), rows("z"), texts, **k).collect()}
    assert run() == {"a": "skipped", "b": "failed", "c": "failed", "d": "indexed", "e": "failed"}
    assert run(force=True)["a"] == "indexed"
    assert index.outcome_counts(spark.createDataFrame([], "outcome string")).first().success_rate == 0.0


def test_paths_and_names(spark):
    paths = {"~/a/b/": "/home/user/a/b", "see /x/y.": "/x/y", r"on C:\dir\f, ok": r"C:\dir\f", "none": None, "/": None}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.x for r in rows.select("p", rag.prompt_path(F.col("p")).alias("x")).collect()} == paths
    names = {"résume-moi Ergonomie des interfaces - Dunod.pdf": "résume-moi Ergonomie des interfaces - Dunod.pdf", "« Titre » svp": "Titre", "summarize my life?": "my life", "hello": None}
    rows = spark.createDataFrame([(p,) for p in names], "p string")
    assert {r.p: r.x for r in rows.select("p", rag.document_name(F.col("p")).alias("x")).collect()} == names


def test_failed_parts_leave_a_mark(spark):
    chunks = spark.createDataFrame([(1, i, 12, f"c{i}") for i in range(12)] + [(2, 0, 1, "only")], "doc_id long, chunk_index int, total_chunks int, content string")
    write = lambda t: F.when(~t.startswith("c5"), F.upper(t))
    got = {r.doc_id: (r.parts, r.summary) for r in rag.summaries(chunks, write).collect()}
    assert got[2] == (1, "ONLY") and got[1][0] == 3 and "[PART 2 FAILED]" in got[1][1] and got[1][1].startswith("C0\n\nC1")
