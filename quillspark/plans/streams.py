"""Queries that drain streams over whole tables in several runs, and the language model; each with the SQL of its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import language, rag
from ..operators.tables import shared_dir
from ..streaming import jobs
from .catalogue import _SQL, _chunks, _docs, _log, _tasks, query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _slices(rows: DataFrame, ts: str, n: int = 3) -> list[DataFrame]:
    """``rows`` by time, in ``n`` parts of equal spans."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    step = ((high or 0) - (low or 0)) // n + 1
    return [rows.where(F.floor((us - F.lit(low or 0)) / step) == k) for k in range(n)]


@query("""SELECT path, max(mtime) AS mtime, count(DISTINCT mtime) AS versions FROM (SELECT path, doc_id AS mtime FROM docs UNION ALL SELECT path, doc_id + 1 FROM docs WHERE doc_id % 7 = 0) GROUP BY path""", "docs")
def r1_r2_incremental_index(spark, sf):
    """Three listings come one after another: most files, newer versions of some, and all files as they were at first. Each
    run indexes what it has not indexed yet."""
    source, out, checkpoint = (_folder(spark, x) for x in ("listings", "indexed", "checkpoint"))
    d = _docs(spark, sf)
    at = lambda n: F.timestamp_seconds(n).alias("mtime")
    listing = lambda rows, more=0: rows.select("path", F.col("n_chars").alias("size"), at(F.col("doc_id") + more))
    d.select("path", F.col("n_chars").alias("size"), at(F.col("doc_id"))).limit(0).write.parquet(out)
    indexed = lambda: spark.read.schema(jobs.FILES).parquet(out)
    work = lambda rows: rows.select("path", "size", "mtime").write.mode("append").parquet(out)
    batches = listing(d.where("doc_id % 13 <> 0")), listing(d.where("doc_id % 7 = 0"), 1), listing(d)
    jobs.drain(source, batches, lambda: jobs.index_new_files(spark, source, checkpoint, indexed, work))
    return indexed().groupBy("path").agg(F.unix_seconds(F.max("mtime")).alias("mtime"), F.count_distinct("mtime").alias("versions"))


@query("""SELECT task, CASE WHEN status = 'processing' AND epoch_ms(last) + 600000 < (SELECT epoch_ms(max(ts)) FROM log) THEN 'pending' ELSE status END AS status, started_at, failures
FROM (SELECT task, arg_max(status, (ts, seq)) AS status, max(ts) AS last, max(CASE WHEN status = 'processing' THEN ts END) AS started_at, count(*) FILTER (status = 'failed') AS failures FROM log GROUP BY 1)""", "log")
def r3_task_machine(spark, sf):
    """The last state of every task, from its events as they come; what is stuck in processing is pending again."""
    source, out, checkpoint = (_folder(spark, x) for x in ("events", "states", "checkpoint"))
    log = _log(spark, sf)
    start = lambda: jobs.versions(jobs.task_machine(spark.readStream.schema(log.schema).parquet(source)), out, checkpoint)
    with jobs.state_store(spark):
        jobs.drain(source, _slices(log, "ts"), start)
    return jobs.read_versions(spark, out, jobs.TaskProcessor.SCHEMA, "task").select("task", "status", F.timestamp_micros("started_us").cast("timestamp_ntz").alias("started_at"), "failures")


@query("SELECT DISTINCT file_path, task_type FROM tasks", "tasks")
def r4_suppressed_duplicates(spark, sf):
    """Tasks as they come, without those that repeat another; the time within which they do spans the table."""
    source, out, checkpoint = (_folder(spark, x) for x in ("tasks", "single", "checkpoint"))
    rows = _tasks(spark, sf).select("file_path", "task_type", F.col("added_at").cast("timestamp").alias("added_at"))
    stream = lambda: jobs.suppress_duplicates(spark.readStream.schema(rows.schema).parquet(source), "3650 days")
    jobs.drain(source, _slices(rows, "added_at"), lambda: jobs.versions(stream(), out, checkpoint, "append"))
    return spark.read.schema("file_path long, task_type string").parquet(out).select("file_path", "task_type")


@query("""SELECT doc_id, count(*) AS parts, md5(string_agg(t, chr(10) || chr(10) ORDER BY part)) AS text FROM (
 SELECT doc_id, chunk_index // 5 AS part, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM chunks GROUP BY ALL) GROUP BY doc_id""", "chunks")
def r5_summaries_as_they_come(spark, sf):
    """Parts of summaries come in three runs: drafts of every other part, these parts as they are, and the rest."""
    source, out, checkpoint = (_folder(spark, x) for x in ("parts", "summaries", "checkpoint"))
    rows = rag.grouped_parts(_chunks(spark, sf))
    even = F.col("part") % 2 == 0
    batches = rows.where(even).withColumn("text", F.lit("draft")), rows.where(even), rows.where(~even)
    jobs.drain(source, batches, lambda: jobs.summary_stream(spark.readStream.schema(rows.schema).parquet(source), out, checkpoint))
    return jobs.read_summaries(spark, out).select("doc_id", "parts", F.md5("text").alias("text"))


_GRAMS = r"""regexp_replace(lower(substr(coalesce(text, ''), 1, 5000)), '[^\p{L}]+', ' ', 'g')"""
_SQL["grams"] = rf"""plain AS (SELECT doc_id, lang, ' ' || {_GRAMS} || ' ' AS t FROM documents),
 cut AS (SELECT doc_id, lang, unnest(list_filter(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), lambda g: regexp_matches(g, '\p{{L}}'))) AS gram FROM plain),
 learned AS (SELECT doc_id FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= 400),
 seen AS (SELECT lang AS language, gram, count(*) AS n FROM cut WHERE doc_id IN (SELECT doc_id FROM learned) GROUP BY ALL),
 rates AS (SELECT *, n / sum(n) OVER (PARTITION BY language) AS rate FROM seen),
 model AS (SELECT gram, language, round(1000 * ln(1 + rate / sum(rate) OVER (PARTITION BY gram) / 0.02))::BIGINT AS weight FROM rates),
 sums AS (SELECT doc_id, language, sum(weight)::BIGINT AS weight FROM cut JOIN model USING (gram) GROUP BY ALL),
 best AS (SELECT doc_id, list(weight ORDER BY weight DESC, language DESC) AS w, arg_max(language, (weight, language)) AS language FROM sums GROUP BY 1),
 told AS (SELECT doc_id, language, (w[1] - coalesce(w[2], 0)) // n AS lead FROM best JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY 1) USING (doc_id))"""


@query("SELECT doc_id, CASE WHEN lead >= 100 THEN language END AS language FROM documents LEFT JOIN told USING (doc_id)", "grams")
def x6_language_sequences(spark, sf):
    """The language of every document by a model of letter sequences, learned from 400 documents of each language."""
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("content").alias("text"), F.col("lang").alias("language"))
    found = language.tell(d, language.learn(d))
    return found.select(F.col("id").alias("doc_id"), "language")
