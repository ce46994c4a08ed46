"""Operators that were made to hold for any size: against plain versions, on hot keys and on long texts."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunk, extract, filters, index, language, rag, search, tasks, vectors
from quillspark.plans import streams
from quillspark.streaming import jobs


def plain_windows(text, s):
    step, n = s.size - s.overlap, 1
    if len(text) > s.size:
        n = -(-(len(text) - s.size) // step) + 1
    if n > 1 and len(text) - (n - 1) * step < s.least:
        n -= 1
    return [(i, n, i * step, e := len(text) if i == n - 1 else min(i * step + s.size, len(text)), text[i * step : e]) for i in range(n)] if text else []


@pytest.mark.parametrize("sizes", [chunk.Sizes(50, 10, 10, 100), chunk.Sizes(50, 30, 10, 100), chunk.Sizes(7, 6, 1, 9), chunk.Sizes(9, 0, 4, 9)])
def test_fixed_windows(spark, sizes):
    dice = random.Random(1)
    texts = {i: "".join(dice.choices("abc dé日𝒳.", k=n)).strip().replace("  ", "") for i, n in enumerate([0, 1, 6, 7, 8, 49, 50, 51, 60, 89, 90, 91, 100, 130, 131, 300])}
    texts = {i: re.sub(" {2,}", " ", t) for i, t in texts.items()}
    docs = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, content string")
    got = sorted(tuple(r)[1:] for r in chunk.fixed_chunks(docs, sizes).collect())
    assert got == sorted((i, *w) for i, t in texts.items() for w in plain_windows(t, sizes))
    n = {r.doc_id: r.chunks for r in chunk.chunk_results(docs, sizes).collect()}
    assert n == {i: len(plain_windows(t, sizes)) for i, t in texts.items()} | {99: 0}


def test_a_long_text_is_cut_in_time_in_proportion(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdé fghi. "), 350_000).alias("content"))
    chunk.fixed_chunks(docs.withColumn("content", F.lit("warm up"))).collect()
    start = time.perf_counter()
    assert chunk.fixed_chunks(docs).agg(F.count(F.lit(1))).first()[0] == len(plain_windows("x" * 4_199_999, chunk.Sizes()))
    assert time.perf_counter() - start < 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_typos_meet_by_deletions(spark, tmp_path):
    dice = random.Random(5)
    words = {"".join(dice.choices("aeinrst", k=dice.randint(1, 14))) for _ in range(3000)}

    def typed(w):
        w = list(w)
        for _ in range(dice.randint(0, 3)):
            at, kind = dice.randrange(len(w) + 1), dice.randrange(3)
            w[at : at + (kind > 0)] = [] if kind == 1 else ["x"]
        return "".join(w) or "y"

    asked = {typed(w) for w in dice.sample(sorted(words), 60)}
    spark.createDataFrame([(w,) for w in words], "term string").write.parquet(f"{tmp_path}/v")
    vocabulary = spark.read.parquet(f"{tmp_path}/v")
    terms = spark.createDataFrame([(1, i, t) for i, t in enumerate(sorted(asked))], "query_id long, qpos int, qterm string")
    order = sorted(asked)
    got = {(order[r.qpos], r.term, r.edits) for r in search.matched_terms(terms, vocabulary).collect()}
    most = lambda t: 2 if len(t) >= 8 else 1 if len(t) >= 4 else 0
    want = {(t, w, e) for t in asked for w in words if abs(len(w) - len(t)) <= most(t) and (e := edits(w, t)) <= most(t)}
    assert got == want and len(want) > 50
    long = terms.where(F.length("qterm") >= 4).select("qterm", search.typo_budget(F.col("qterm")).alias("budget"))
    assert search.candidate_words(long, vocabulary).count() < 0.01 * len(words) * len(asked)


def test_a_search_cuts_the_corpus_once(spark):
    docs = spark.createDataFrame([(i, "t", f"word{i % 7} the the rest{i}") for i in range(300)], "id long, title string, content string")
    posted = search.postings(docs, ("title", "content"))
    queries = spark.createDataFrame([(i, f"word{i} the") for i in range(7)], "query_id long, query string")
    first = search.keyword_search(queries, posted, 3).collect()
    entries = posted.entries
    assert entries.count() == 300 * 4  # a row per document and word
    assert search.keyword_search(queries, posted, 3).collect() == first and posted.entries is entries
    # hits are summed up in their buckets: only the best of each are shuffled
    plan = search.keyword_search(queries, posted, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def test_approximate_search_reads_few_vectors(spark):
    for sf, most in (("/root/testdata/sf0.1", 0.1), ("/root/testdata/sf0.01", 0.15)):
        e = spark.read.parquet(f"{sf}/embeddings.parquet")
        rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector"))
        built = vectors.build_index(rows)
        n = rows.count()
        assert len(built.cells.centres) == int(n**0.5) and built.codes.count() == n
        want = {(r.query_id, r.id) for r in vectors.knn(q, rows, 10).collect()}
        got = vectors.approximate_knn(q, built, 10, probes=0.65, candidates=5).collect()
        assert len(want & {(r.query_id, r.id) for r in got}) >= 0.9 * len(want)
        assert 10 * 5 <= most * n  # the vectors of a query's codes that are read
    one = vectors.build_index(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<float>"))
    found = vectors.approximate_knn(spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, qvector array<float>"), one, 3).collect()
    assert [(r.query_id, r.id, r.distance) for r in found] == [(7, 1, 0.0)]
    none = vectors.build_index(rows.limit(0))
    assert vectors.approximate_knn(q, none, 3).count() == 0


def test_one_hot_cell_has_many_files(spark):
    rows = spark.range(2000).select("id", F.array(*(F.lit(float(i)) for i in range(16))).cast("array<float>").alias("vector"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        built = vectors.build_index(rows, vectors.IndexSettings(file_rows=100))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert built.codes.select(F.input_file_name()).distinct().count() > 1


def test_runs_of_one_worker_in_many_pieces(spark):
    dice = random.Random(8)
    log = [(w, i, dice.choice(["failed", "failed", "failed", "completed"])) for w, n in ((1, 3000), (2, 5), (3, 1)) for i in range(n)]
    log += [(4, i, "failed") for i in range(700)] + [(5, 0, None)]
    events = spark.createDataFrame([(w, i, 1_000_000 * i, s) for w, i, s in log], "task long, seq long, us long, status string").withColumn("ts", F.timestamp_micros("us"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.task: r.longest for r in tasks.error_runs(events, "failed").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = {}
    for w, _, s in log:
        run = want.setdefault(w, [0, 0])
        run[0] = run[0] + 1 if s == "failed" else 0
        run[1] = max(run)
    assert got == {w: x[1] for w, x in want.items()}


def test_paths_below_any_prefix(spark):
    dice = random.Random(2)
    paths = ["/" + "/".join(dice.choices(["a", "b", "ab", "é", "日本"], k=dice.randint(1, 4))) for _ in range(300)] + [None, "", "/a\U0001f600"]
    prefixes = ["/", "", "/a", "/ab", "/a/", "/é", "/zz", "/a\U0001f600", "/日", "x", None, "/a"]
    docs = spark.createDataFrame([(p, f"t{i}") for i, p in enumerate(paths)], "path string, title string")
    asked = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    want = {p: sorted(x for x in paths if x is not None and x.startswith(p)) for p in set(prefixes) - {None}}
    assert {r.prefix: r.n for r in rag.counts_below(asked, docs).collect()} == {p: len(x) for p, x in want.items()}
    lists = {}
    for r in sorted(rag.lists_below(asked, docs, 4).collect(), key=lambda r: r.place):
        lists.setdefault(r.prefix, []).append(r.path)
    assert lists == {p: x[:4] for p, x in want.items() if x}


def test_stems_in_paths(spark):
    dice = random.Random(3)
    paths = ["/" + "".join(dice.choices("abcDE/é", k=dice.randint(1, 12))) for _ in range(400)]
    stems = {p.lower()[i : i + n] for p in paths[:40] for i, n in ((1, 1), (1, 2), (2, 3), (1, 6))} | {"", "zzz", "qq"}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.stem: r.path for r in index.paths_with(spark.createDataFrame([(s,) for s in stems], "stem string"), rows).collect()}
    assert got == {s: min(x) for s in stems if s and (x := [p for p in paths if s in p.lower()])}


def test_keys_of_json_at_any_depth(spark):
    texts = {1: '{"a": {"b": [1, {"c": null}]}}', 2: "[]", 3: "3", 4: "", 5: None, 6: '{"a": 1}]', 7: "1, 2", 8: '1, "x": 2', 9: '{"a": 1} x', 10: "[" * 30 + '{"k": 1}' + "]" * 30, 11: "nul", 12: '  {"é": 1, "b": {}} '}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: (r["keys"], r.error) for r in extract.json_keys(rows).collect()}
    bad = (None, "invalid JSON")
    assert got == {1: (3, None), 2: (0, None), 3: (0, None), 4: bad, 5: bad, 6: bad, 7: bad, 8: bad, 9: bad, 10: (1, None), 11: bad, 12: (2, None)}


def test_languages_of_texts_that_were_not_learned_from(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"))
    model = language.learn(d.where("id % 3 <> 0"), language.Settings(sample=60))
    rest = d.where("id % 3 = 0 AND length(text) >= 50")
    told = rest.join(language.tell(rest.select("id", "text"), model).withColumnRenamed("language", "told"), "id")
    right, wrong, none = told.selectExpr("count_if(told = language)", "count_if(told <> language)", "count_if(told is null)").first()
    assert right > 0.95 * (right + wrong + none) and wrong < 0.03 * (right + wrong)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "日本語"), (5, "zxqj " * 50)], "id long, text string")
    assert all(r.language is None for r in language.tell(odd, model).collect())
    assert language.tell(odd.limit(0), model).count() == 0


def plain_central(text, most=3):
    found = rag.sentences(text)
    bags = [Counter(re.findall(r"[^\W_]+", s.lower())) for s in found]
    n = len(bags)
    df = Counter(w for b in bags for w in b)
    weighted = [{w: c * np.log(1 + n / df[w]) for w, c in b.items()} for b in bags]
    norm = [sum(x * x for x in b.values()) ** 0.5 for b in weighted]
    links = [[0 if i == j or not norm[i] * norm[j] else sum(x * weighted[j].get(w, 0) for w, x in weighted[i].items()) / norm[i] / norm[j] for j in range(n)] for i in range(n)]
    p = [1 / n] * n
    for _ in range(50):
        p = [0.15 / n + 0.85 * sum(p[i] * (links[i][j] / sum(links[i]) if sum(links[i]) else 1 / n) for i in range(n)) for j in range(n)]
    best = sorted(range(n), key=lambda i: (-round(p[i], 9), i))[:most]
    return " ".join(found[i] for i in sorted(best))


def test_summaries_take_central_sentences(spark):
    dice = random.Random(6)
    text = " ".join(" ".join(dice.choices([f"word{i}" for i in range(30)], k=8)).capitalize() + "." for _ in range(25)) + " One lone line of its own words!"
    assert rag.central_text(text) == plain_central(text)
    assert rag.central_text(" ") is None and rag.central_text(None) is None and rag.central_text("One.") == "One."
    chunks = spark.createDataFrame([(1, i, 250, f"Chunk number {i} says this and that. It ends with words of chunk {i}.") for i in range(250)], "doc_id long, chunk_index int, total_chunks int, content string")
    got = rag.summaries(chunks, rag.central_sentences()).first()
    taken = [f"Chunk number {i} says this and that. It ends with words of chunk {i}." for i in (int(k * 2.5) for k in range(100))]
    parts = [plain_central("\n\n".join(taken[k : k + 5])) for k in range(0, 100, 5)]
    assert got.parts == 20 and got.summary == plain_central("\n\n".join(parts))


def test_stuck_tasks_and_a_restart(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [
        [(1, 1, at(0), "processing"), (2, 2, at(5), "processing"), (3, 3, at(9), "failed")],
        [(2, 5, at(400), "completed"), (3, 4, at(8), "pending"), (4, 6, at(500), "processing")],
        [(5, 7, at(700), "failed"), (5, 8, at(700), "processing")],
    ]
    batches = [spark.createDataFrame(x, "task long, seq long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp")) for x in rows]
    source, out, checkpoint = (str(tmp_path / x) for x in "soc")
    schema, seen = batches[0].schema, []

    def start():
        return jobs.versions(jobs.task_machine(spark.readStream.schema(schema).parquet(source)), out, checkpoint)

    with jobs.state_store(spark):
        for b in batches:
            jobs.drain(source, [b], start)
            seen.append({r.task: (r.status, r.failures) for r in jobs.read_versions(spark, out, jobs.TaskProcessor.SCHEMA, "task").collect()})
    assert seen[0] == {1: ("processing", 0), 2: ("processing", 0), 3: ("failed", 1)}
    assert seen[1][2] == ("completed", 0) and seen[1][4] == ("processing", 0)
    # the log is 600 s past the start of 1, which is pending again, but not past that of 4
    assert seen[2] == {1: ("pending", 0), 2: ("completed", 0), 3: seen[2][3], 4: ("processing", 0), 5: ("processing", 1)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_request_faults_say_what_a_request_says(spark):
    rows = [("ok", 10, 0, "hybrid", None), ("", 0, -1, "best", "color"), ("x" * 1001, 101, 5, None, "title"), (None, None, None, None, None), ("x" * 1000, 100, 0, "semantic", "created_at")]
    got = [r.faults for r in filters.request_faults(spark.createDataFrame(rows, "query string, limit int, offset int, mode string, sort string")).collect()]
    for (query, limit, offset, mode, sort), said in zip(rows, got):
        try:
            filters.Request(query or "", 10 if limit is None else limit, offset or 0, mode or "hybrid", sort)
            assert said is None
        except ValueError as e:
            assert str(e) == said


def test_slices_hold_every_row(spark):
    rows = spark.range(50).select("id", F.timestamp_seconds("id").alias("ts"))
    assert sum(s.count() for s in streams._slices(rows, "ts")) == 50 and [s.count() for s in streams._slices(rows.limit(0), "ts")] == [0, 0, 0]
