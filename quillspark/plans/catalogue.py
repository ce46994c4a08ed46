"""Queries over the given tables, each with its SQL twin.

``documents`` stands for the corpus: a path and an extension are derived from doc_id and source, so that
filters by path, type and category have something to do. Events stand for tasks and their log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, index, rag, search, tasks, vectors
from ..operators.tables import materialise
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EXTENSIONS = (".pdf", ".docx", ".txt", ".md", ".py", ".jpg", ".csv", ".zip")
STOP = ("the", "of", "and", "to", "in", "la", "de", "le", "der", "die")
SYNONYMS = (("thes", 1, "invoice"), ("thes", 2, "bill"), ("that", 1, "this"), ("with", 1, "avec"), ("with", 2, "mit"), ("with", 3, "con"), ("with", 4, "using"))

_SQL = {
    "docs": f"""docs AS (SELECT doc_id, text AS content, lang, source, n_chars,
  list_value({", ".join(f"'{e}'" for e in EXTENSIONS)})[CAST(doc_id % 8 AS INT) + 1] AS ext,
  '/corpus/' || source || '/' || doc_id || list_value({", ".join(f"'{e}'" for e in EXTENSIONS)})[CAST(doc_id % 8 AS INT) + 1] AS path
  FROM documents)""",
    "tasks": """tasks AS (SELECT event_id AS id, user_id AS file_path, props AS task_type, ts AS added_at,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
  CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority, k % 5 AS retry_count,
  CASE WHEN k % 7 = 0 THEN NULL ELSE ts END AS started_at
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))""",
    "log": """log AS (SELECT user_id AS task, event_id AS seq, ts,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events)""",
    "snaps": """old AS (SELECT path, n_chars AS size, doc_id AS mtime FROM docs WHERE doc_id % 11 <> 0),
 new AS (SELECT path, n_chars AS size, doc_id + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM docs WHERE doc_id % 13 <> 0)""",
    "norm": r"""norm AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""",
}
_SQL["chunks"] = _SQL["norm"] + """, sized AS (SELECT doc_id, t, length(t) AS len FROM norm WHERE t <> ''),
 counted AS (SELECT *, CASE WHEN len <= 1536 THEN 1 ELSE CAST(ceil((len - 1536) / 1386.0) AS INT) + 1 END AS n0 FROM sized),
 fixed AS (SELECT *, CASE WHEN n0 > 1 AND len - (n0 - 1) * 1386 < 300 THEN n0 - 1 ELSE n0 END AS n FROM counted),
 spread AS (SELECT *, CAST(unnest(range(n)) AS INT) AS i FROM fixed),
 chunks AS (SELECT doc_id, i AS chunk_index, CAST(n AS INT) AS total_chunks, CAST(i * 1386 AS INT) AS offset_start,
  CAST(CASE WHEN i = n - 1 THEN len ELSE least(i * 1386 + 1536, len) END AS INT) AS offset_end,
  substr(t, i * 1386 + 1, CASE WHEN i = n - 1 THEN len ELSE least(i * 1386 + 1536, len) END - i * 1386) AS content,
  doc_id || '_' || lpad(CAST(i AS VARCHAR), 5, '0') AS chunk_id FROM spread)"""
#: DuckDB's edit distance counts bytes; the letters of the tables beyond ASCII stand for capitals there, which no term has.
_BYTES = lambda c: f"translate({c}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
_BUDGET = "(CASE WHEN length(qterm) >= 8 THEN 2 WHEN length(qterm) >= 4 THEN 1 ELSE 0 END)"
_SQL["terms"] = rf"""post AS (SELECT doc_id AS id, attr, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS term FROM
  (SELECT doc_id, 0 AS attr, source AS t FROM documents UNION ALL SELECT doc_id, 1, coalesce(text, '') FROM documents)),
 qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS qterm FROM benchmark WHERE item_id % 50 = 0),
 vocab AS (SELECT DISTINCT term FROM post),
 words AS (SELECT query_id, qterm, term, levenshtein({_BYTES("term")}, {_BYTES("qterm")}) AS edits FROM vocab JOIN qt
  ON abs(length(term) - length(qterm)) <= {_BUDGET} AND levenshtein({_BYTES("term")}, {_BYTES("qterm")}) <= {_BUDGET}),
 hit AS (SELECT query_id, id, qterm, min(edits) AS edits, min(attr) AS attr FROM post JOIN words USING (term) GROUP BY ALL),
 found AS (SELECT query_id, id, count(*) AS words, CAST(sum(edits) AS BIGINT) AS typos, min(attr) AS attribute, count(*) FILTER (edits = 0) AS exact FROM hit GROUP BY ALL),
 ft AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, typos, attribute, exact DESC, id) AS rank FROM found QUALIFY rank <= 20)"""
_DISTANCE = "list_sum(list_transform(list_zip(v.vector, q.vector), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


def _nearest(name: str, corpus: str, asked: str) -> str:
    return f"""{name} AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
  SELECT q.id AS query_id, v.id AS id, round({_DISTANCE}, 9) AS distance FROM {corpus} v CROSS JOIN {asked} q) QUALIFY rank <= 20)"""


_SQL["near"] = "vecs AS (SELECT vec_id AS id, embedding AS vector FROM embeddings), qvecs AS (SELECT * FROM vecs WHERE id % 50 = 0),\n " + _nearest("sem", "vecs", "qvecs")


def _embedded(name: str, rows: str) -> str:
    """SQL of the embedding of ``rows`` (id, t): id, vector."""
    return rf"""{name}_w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS w FROM {rows}),
 {name}_p AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {vectors.DIMENSIONS} AS b, sum(1 - 2 * (('0x' || substr(md5(w), 9, 1))::INT % 2)) AS s FROM {name}_w GROUP BY ALL),
 {name}_n AS (SELECT id, greatest(sqrt(sum(s * s)::DOUBLE), 1e-12) AS norm FROM {name}_p GROUP BY id),
 {name} AS (SELECT r.id, list(CAST(coalesce(p.s / n.norm, 0) AS FLOAT) ORDER BY g.b) AS vector FROM {rows} r CROSS JOIN range({vectors.DIMENSIONS}) g(b)
  LEFT JOIN {name}_p p ON p.id = r.id AND p.b = g.b LEFT JOIN {name}_n n ON n.id = r.id GROUP BY r.id)"""


_SQL["embedded"] = """texts AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), asked AS (SELECT item_id AS id, coalesce(text, '') AS t FROM benchmark WHERE item_id % 50 = 0),
 """ + _embedded("dvec", "texts") + ",\n " + _embedded("qvec", "asked")
_SQL["meant"] = _SQL["embedded"] + ",\n " + _nearest("sem", "dvec", "qvec")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8).cast("int") + 1)
    d = d.select("doc_id", F.col("text").alias("content"), "lang", "source", "n_chars", ext.alias("ext"))
    return d.withColumn("path", F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), "ext"))


def _status() -> F.Column:
    e = F.col("event_type")
    return F.when(e == "view", "pending").when(e == "click", "processing").when(e == "purchase", "completed").when(e == "error", "failed").otherwise("cancelled")


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    p = F.col("k") % 3
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("file_path"), F.col("props").alias("task_type"), F.col("ts").alias("added_at"), _status().alias("status"),
        F.when(p == 0, "high").when(p == 1, "normal").otherwise("low").alias("priority"), (F.col("k") % 5).alias("retry_count"), F.when(F.col("k") % 7 != 0, F.col("ts")).alias("started_at"),
    )


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), "ts", _status().alias("status"))


def _snapshots(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = d.where("doc_id % 11 <> 0").select("path", F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    moved = F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return old, d.where("doc_id % 13 <> 0").select("path", F.col("n_chars").alias("size"), moved.alias("mtime"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.fixed_chunks(_docs(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _items(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """query_id, query: the benchmark's items whose id is divisible by 50, with all of their text."""
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return q if every else q.where("query_id % 50 = 0")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))


def _semantic(spark: SparkSession, sf: str, k: int = 20, every: bool = False) -> DataFrame:
    q = _items(spark, sf, every).select("query_id", vectors.embed(F.col("query")).alias("qvector"))
    rows = _corpus(spark, sf).select("id", vectors.embed(F.col("content")).alias("vector"))
    return vectors.knn(q, materialise(spark, rows, "embedded"), k)


def _fulltext(spark: SparkSession, sf: str, k: int = 20, every: bool = False) -> DataFrame:
    return search.keyword_search(_items(spark, sf, every), search.postings(_corpus(spark, sf), ("title", "content")), k)


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def query(sql: str, *parts: str):
    """Registers a query, with its SQL below the named common table expressions; an empty text: none."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + ",\n".join(_SQL[p] for p in parts) + "\n" if parts else "") + sql
        return f

    return add


# Sources ---------------------------------------------------------------------------------------------


@query("""SELECT path, len(list_filter(string_split(rest, '/')[1:-2], lambda x: starts_with(x, '.') OR lower(x) = 'src3')) > 0 AS skipped FROM (
SELECT '/home/.hidden' || path AS path, CASE WHEN doc_id % 2 = 0 THEN substr(path, 9) ELSE '/home/.hidden' || path END AS rest FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN path ELSE '/other' || path END AS path FROM docs))""", "docs")
def s2_folder_predicate(spark, sf):
    """Of two roots, the first lies in a hidden folder; files elsewhere are judged by all of their folders."""
    path = F.concat(F.lit("/home/.hidden"), F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/other"), "path")))
    return _docs(spark, sf).select(path.alias("path")).select("path", files.skipped_folder(F.col("path"), ("SRC3",), ("/home/.hidden/corpus", "/data")).alias("skipped"))


@query("SELECT path, ext IN ('.csv', '.zip', '.py') OR doc_id IN (2, 3) AS skipped FROM docs", "docs")
def s3_file_predicate(spark, sf):
    return _docs(spark, sf).select("path", files.skipped_file(F.col("path"), names=("2.TXT", "3.Md"), excluded=(".CSV",)).alias("skipped"))


@query("SELECT doc_id, sha256(coalesce(content, '')) AS sha256 FROM docs", "docs")
def s4_fingerprint(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))


@query("""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.mtime <> n.mtime THEN 'modified' ELSE 'unchanged' END AS change
FROM old o FULL JOIN new n ON o.path = n.path""", "docs", "snaps")
def s6_snapshot_diff(spark, sf):
    return files.diff(*_snapshots(_docs(spark, sf)))


@query("""SELECT count(*) AS scanned, count(*) FILTER (ext IN ('.zip', '.py')) AS skipped, CAST(sum(n_chars) AS BIGINT) AS bytes FROM docs""", "docs")
def s7_scan_counters(spark, sf):
    d = _docs(spark, sf).withColumn("skip", files.skipped_file(F.col("path")))
    return d.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("skip").alias("skipped"), F.sum("n_chars").alias("bytes"))


@query("SELECT ext AS extension, count(*) AS files FROM docs GROUP BY 1", "docs")
def s9_extension_counts(spark, sf):
    return _docs(spark, sf).groupBy(T.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT r.doc_id, CASE WHEN r.doc_id % 5 = 0 THEN 'not absolute' WHEN n.path IS NULL THEN 'missing' ELSE 'queued' END AS status
FROM docs r LEFT JOIN new n ON r.path = n.path""", "docs", "snaps")
def s10_ingest_requests(spark, sf):
    d = _docs(spark, sf)
    asked = d.select("doc_id", "path", F.when(F.col("doc_id") % 5 == 0, F.substr("path", F.lit(2))).otherwise(F.col("path")).alias("asked"))
    there = _snapshots(d)[1].select("path", F.lit(True).alias("there"))
    status = F.when(~F.col("asked").startswith("/"), "not absolute").when(F.col("there").isNull(), "missing").otherwise("queued")
    return asked.join(there, "path", "left").select("doc_id", status.alias("status"))


# Extraction and metadata -------------------------------------------------------------------------------


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(content, ''), '[^\s]+')) AS words, length(content) - length(replace(content, chr(10), '')) + 1 AS lines FROM docs""", "docs")
def x5_word_and_line_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count(F.col("content")).alias("words"), T.line_count(F.col("content")).alias("lines"))


_PROFILES = (("en", "the"), ("en", "of"), ("en", "and"), ("fr", "le"), ("fr", "la"), ("fr", "et"), ("de", "der"), ("de", "und"), ("de", "die"), ("es", "el"), ("es", "los"), ("es", "que"), ("es", "y"))


_SQL["profiles"] = "profiles(language, term) AS (VALUES " + ", ".join(map(str, _PROFILES)) + r"""),
 w AS (SELECT doc_id, unnest(regexp_extract_all(lower(substr(coalesce(content, ''), 1, 5000)), '[\p{L}\p{N}]+')) AS term FROM docs),
 told AS (SELECT doc_id, language, count(*) AS n FROM w JOIN profiles USING (term) GROUP BY ALL)"""


@query("""SELECT doc_id, coalesce(l, 'unknown') AS language FROM docs LEFT JOIN (SELECT doc_id, arg_max(language, (n, language)) AS l FROM told GROUP BY 1) USING (doc_id)""", "docs", "profiles")
def x6_language(spark, sf):
    d = _docs(spark, sf)
    p = F.broadcast(spark.createDataFrame(_PROFILES, "language string, term string"))
    n = d.select("doc_id", F.explode(T.terms(F.substring("content", 1, 5000))).alias("term")).join(p, "term").groupBy("doc_id", "language").count()
    best = n.groupBy("doc_id").agg(F.max_by("language", F.struct("count", "language")).alias("language"))
    return d.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("language", F.lit("unknown")).alias("language"))



@query("""SELECT doc_id, string_agg('[' || i || '] ' || trim(p), chr(10) ORDER BY i) AS body FROM (
SELECT doc_id, unnest(string_split(coalesce(content, ''), chr(10))) AS p, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) AS i FROM docs) WHERE trim(p) <> '' GROUP BY doc_id""", "docs")
def x7_sections(spark, sf):
    parts = _docs(spark, sf).select("doc_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "p")).where("trim(p) <> ''")
    body = F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: F.concat(F.lit("["), (x["i"] + 1).cast("string"), F.lit("] "), F.trim(x["p"])))
    return parts.groupBy("doc_id").agg(F.array_join(body, "\n").alias("body"))


@query("""SELECT doc_id, count(*) AS pages, count(*) FILTER (n > 10) AS with_text, round(avg(n), 6) AS mean_chars,
 sum(n) < 50 OR count(*) FILTER (n > 10) / count(*) < 0.3 OR avg(n) < 100 OR (count(*) FILTER (i % 5 = 0) / count(*) > 0.8 AND count(*) FILTER (n > 10) / count(*) < 0.5) AS needs_ocr FROM (
SELECT doc_id, length(unnest(string_split(coalesce(content, ''), chr(10)))) AS n, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) - 1 AS i FROM docs) GROUP BY doc_id""", "docs")
def x9_page_triage(spark, sf):
    pages = _docs(spark, sf).select("doc_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "p")).select("doc_id", "i", F.length("p").alias("n"))
    a = pages.groupBy("doc_id").agg(F.count("n").alias("pages"), F.count_if(F.col("n") > 10).alias("with_text"), F.avg("n").alias("mean"), F.sum("n").alias("total"), F.count_if(F.col("i") % 5 == 0).alias("images"))
    cover, images = F.col("with_text") / F.col("pages"), F.col("images") / F.col("pages")
    needs = (F.col("total") < 50) | (cover < 0.3) | (F.col("mean") < 100) | ((images > 0.8) & (cover < 0.5))
    return a.select("doc_id", "pages", "with_text", F.round("mean", 6).alias("mean_chars"), needs.alias("needs_ocr"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def x10_compact_dates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", T.compact_date(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"))).alias("iso"))


@query("""SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (user_id % 90 + (event_id % 60) / 60.0::DOUBLE + value / 3600), 9) AS degrees FROM events""")
def x11_positions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    side = F.when(F.col("event_id") % 2 == 0, "S").otherwise("N")
    return e.select("event_id", F.round(T.dms_to_decimal(F.col("user_id") % 90, F.col("event_id") % 60, F.col("value"), side), 9).alias("degrees"))


@query("""SELECT doc_id, sha256(path) AS id, CASE WHEN doc_id % 3 = 0 THEN 'About ' || source ELSE CAST(doc_id AS VARCHAR) END AS title, CASE ext WHEN '.pdf' THEN 'document' WHEN '.docx' THEN 'document' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text'
 WHEN '.py' THEN 'code' WHEN '.jpg' THEN 'image' WHEN '.csv' THEN 'spreadsheet' ELSE 'other' END AS category FROM docs""", "docs")
def x13_x15_identity(spark, sf):
    p = F.col("path")
    return _docs(spark, sf).select("doc_id", F.sha2(p, 256).alias("id"), T.title(p, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("About "), "source")).when(F.col("doc_id") % 3 == 1, "")).alias("title"), T.category(T.extension(p)).alias("category"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '{"lang":"' || lang || '","source":"' || source || '"}' ELSE '{"lang":"' || lang || '"}' END AS metadata FROM docs""", "docs")
def x16_metadata(spark, sf):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    return _docs(spark, sf).select("doc_id", F.to_json(F.map_filter(m, lambda k, v: v.isNotNull())).alias("metadata"))


# Index maintenance -------------------------------------------------------------------------------------


@query("""SELECT path, size, mtime FROM new UNION ALL SELECT path, size, mtime FROM old WHERE path NOT IN (SELECT path FROM new)""", "docs", "snaps")
def i4_upsert(spark, sf):
    old, new = _snapshots(_docs(spark, sf))
    return index.upsert(old, new, "path", "mtime")


@query("SELECT path FROM new WHERE path NOT IN (SELECT path FROM old)", "docs", "snaps")
def i2_pending(spark, sf):
    old, new = _snapshots(_docs(spark, sf))
    return index.pending(new, old, "path").select("path")


@query("SELECT path, size FROM old WHERE path NOT IN (SELECT path FROM docs WHERE doc_id % 4 = 0)", "docs", "snaps")
def i7_delete(spark, sf):
    d = _docs(spark, sf)
    return index.without(_snapshots(d)[0], d.where("doc_id % 4 = 0"), "path").select("path", "size")


@query("""SELECT 'source' AS field, source AS value, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM docs GROUP BY ALL UNION ALL SELECT 'total', NULL, count(*) FROM docs""", "docs")
def i10_table_stats(spark, sf):
    return index.group_counts(_docs(spark, sf), "source", "lang")


@query("""SELECT 'content' AS field, count(content) AS n FROM docs UNION ALL SELECT 'lang', count(lang) FROM docs UNION ALL SELECT 'path', count(path) FROM docs""", "docs")
def i11_field_distribution(spark, sf):
    return index.field_counts(_docs(spark, sf), "content", "lang", "path")


@query("SELECT doc_id FROM docs WHERE trim(coalesce(content, '')) = '' OR doc_id % 50 = 0", "docs")
def i15_blank_documents(spark, sf):
    d = _docs(spark, sf).withColumn("content", F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("content")))
    return d.where(F.trim(F.coalesce("content", F.lit(""))) == "").select("doc_id")


@query("""SELECT count(o.path) AS fulltext, count(n.path) AS vectors, count(*) FILTER (n.path IS NULL) AS missing, count(*) FILTER (o.path IS NULL) AS surplus,
CAST(floor(100 * count(n.path) / count(o.path)) AS BIGINT) AS percent FROM old o FULL JOIN new n USING (path)""", "docs", "snaps")
def i18_sync(spark, sf):
    return index.sync(*_snapshots(_docs(spark, sf)), "path")


@query("SELECT chunk_id FROM chunks WHERE doc_id % 13 = 0", "chunks")
def i20_orphan_chunks(spark, sf):
    d = _docs(spark, sf)
    return _chunks(spark, sf).join(d.where("doc_id % 13 <> 0").select("doc_id"), "doc_id", "left_anti").select("chunk_id")


# Chunking ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, t AS text FROM norm", "norm")
def c1_normalise(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalise_text(F.col("content")).alias("text"))


@query("SELECT chunk_id, doc_id, chunk_index, total_chunks, offset_start, offset_end, content FROM chunks", "chunks")
def c2_c4_fixed_chunks(spark, sf):
    return _chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index", "total_chunks", "offset_start", "offset_end", "content")


def _breaks_sql() -> str:
    """The chain of windows that end at breaks, one of each text in a step; a break is found in the reversed tail."""
    ends = ", ".join("CASE WHEN strpos(tail, reverse({0})) > 0 THEN e0 - strpos(tail, reverse({0})) + 1 END".format("'" + b.replace("\n", "' || chr(10) || '") + "'") for b in chunk.BREAKS)
    return rf"""windows AS (SELECT doc_id, t, length(t) AS n, 0 AS step, 0 AS start, 0 AS stop, '' AS part, 0 AS chunk, -1 AS last_start, 0 AS last_len, 0 AS own FROM norm WHERE t <> ''
 UNION ALL SELECT doc_id, t, n, step + 1, CASE WHEN c > 0 AND stop - 150 > f THEN stop - 150 ELSE stop END, stop, part, c, f, CASE WHEN part = '' THEN last_len WHEN joins THEN last_len + 1 + length(part) ELSE length(part) END, start
 FROM (SELECT *, CASE WHEN part = '' OR joins THEN chunk ELSE chunk + 1 END AS c, CASE WHEN part = '' OR joins THEN last_start ELSE start END AS f
 FROM (SELECT *, chunk > 0 AND length(part) < 300 AND last_len + length(part) + 1 <= 3072 AS joins FROM (SELECT * REPLACE (regexp_replace(substr(t, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS part)
 FROM (SELECT * REPLACE (CASE WHEN e0 < n THEN coalesce({ends}, e0) ELSE n END AS stop) FROM (SELECT *, reverse(substr(t, greatest(start, e0 - 307) + 2, e0 - greatest(start, e0 - 307) - 1)) AS tail
 FROM (SELECT *, least(start + 1536, n) AS e0 FROM windows WHERE stop < n)))))))"""


_SQL["windows"] = "RECURSIVE " + _SQL["norm"] + ",\n " + _breaks_sql()


@query("""SELECT *, count(*) OVER (PARTITION BY doc_id)::INT AS total_chunks, doc_id || '_' || lpad(chunk_index::VARCHAR, 5, '0') AS chunk_id FROM (
SELECT doc_id, (chunk - 1)::INT AS chunk_index, min(own)::INT AS offset_start, max(stop)::INT AS offset_end, string_agg(part, ' ' ORDER BY step) AS content FROM windows WHERE part <> '' GROUP BY doc_id, chunk)""", "windows")
def c2_c3_break_chunks(spark, sf):
    return chunk.break_chunks(_docs(spark, sf))


@query("SELECT doc_id, count(*) AS chunks, CAST(sum(length(content) // 3) AS BIGINT) AS tokens FROM chunks GROUP BY doc_id", "chunks")
def c5_c10_chunk_counts(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.count("chunk_id").alias("chunks"), F.sum(T.tokens_estimate(F.col("content"), 3)).alias("tokens"))


# Retrieval and fusion ------------------------------------------------------------------------------------


@query("SELECT query_id, id, round(distance, 6) AS distance, rank, round(1 / (1 + distance), 6) AS score FROM sem", "near")
def v2_document_knn(spark, sf):
    found = search.knn(*_vectors(spark, sf), 20)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank", F.round("score", 6).alias("score"))


@query("""SELECT * FROM (SELECT id, round(unnest(vector)::DOUBLE, 6) AS value, unnest(range(len(vector)))::INT AS place FROM dvec) WHERE value <> 0""", "embedded")
def v1_embeddings(spark, sf):
    """The vector of every document, a row for each place that is not zero."""
    v = _corpus(spark, sf).select("id", vectors.embed(F.col("content")).alias("v"))
    return v.select("id", F.posexplode("v").alias("place", "x")).where("x <> 0").select("id", "place", F.round(F.col("x").cast("double"), 6).alias("value"))


@query("""SELECT query_id, id, round(CASE WHEN distance <= 2 THEN greatest(0, 1 - distance / 2) ELSE 1 / (1 + distance) END, 6) AS score FROM sem
WHERE CASE WHEN distance <= 2 THEN greatest(0, 1 - distance / 2) ELSE 1 / (1 + distance) END >= 0.3""", "near")
def v5_chunk_knn(spark, sf):
    found = search.knn(*_vectors(spark, sf), 20, T.chunk_score, 0.3)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT query_id, id, words, typos, attribute, exact, rank FROM ft", "terms")
def f3_keyword_ranking(spark, sf):
    return _fulltext(spark, sf).select("query_id", "id", "words", "typos", "attribute", "exact", "rank")


_FUSED = """, merged AS (SELECT coalesce(s.query_id, f.query_id) AS query_id, coalesce(s.id, f.id) AS id, s.rank AS s, f.rank AS f, coalesce(f.shown, 0) AS shown
 FROM sem s FULL JOIN (SELECT *, 1 - rank / count(*) OVER (PARTITION BY query_id) AS shown FROM ft) f ON s.query_id = f.query_id AND s.id = f.id),
 fused AS (SELECT *, s IS NOT NULL AND f IS NOT NULL AS in_both, (coalesce(1 / (60 + s), 0) * 0.6 + coalesce(1 / (60 + f), 0) * 0.4) * CASE WHEN s IS NOT NULL AND f IS NOT NULL THEN 1.3 ELSE 1 END AS r FROM merged),
 ranked AS (SELECT query_id, id, round(r / max(r) OVER (PARTITION BY query_id), 4) AS score, round(r, 6) AS rrf, in_both, round(shown, 4) AS fulltext_score,
 row_number() OVER (PARTITION BY query_id ORDER BY round(r, 12) DESC, id) AS rank FROM fused)"""
_SQL["fused"] = _SQL["meant"] + ",\n" + _SQL["terms"] + _FUSED


@query("SELECT query_id, id, score, rrf, in_both, fulltext_score, rank FROM ranked WHERE rank <= 10", "fused")
def h5_hybrid_search(spark, sf):
    return search.page(search.fuse_ranks(_semantic(spark, sf), _fulltext(spark, sf)), 0, 10)


@query("SELECT query_id, id, rank FROM ranked WHERE rank BETWEEN 11 AND 20", "fused")
def h10_second_page(spark, sf):
    return search.page(search.fuse_ranks(_semantic(spark, sf), _fulltext(spark, sf)), 10, 10).select("query_id", "id", "rank")


@query("""SELECT query_id, id, round(least(1.0, CASE WHEN a > 0 AND b > 0 THEN (0.6 * a + 0.4 * b) * 1.1 ELSE 0.6 * a + 0.4 * b END), 4) AS score FROM (
SELECT query_id, id, coalesce(1 / (1 + s.distance), 0) AS a, coalesce(1 / f.rank, 0) AS b FROM sem s FULL JOIN ft f USING (query_id, id))""", "meant", "terms")
def h6_weighted_fusion(spark, sf):
    return search.fuse_scores(_semantic(spark, sf), _fulltext(spark, sf).withColumn("score", 1 / F.col("rank")))


@query("""SELECT query_id, id, rank FROM sem UNION ALL SELECT query_id, f.id, coalesce(m, 0) + row_number() OVER (PARTITION BY query_id ORDER BY f.rank) FROM ft f
LEFT JOIN (SELECT query_id, max(rank) AS m FROM sem GROUP BY 1) USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM sem s WHERE s.query_id = f.query_id AND s.id = f.id)""", "meant", "terms")
def h9_append_new(spark, sf):
    return search.append_new(_semantic(spark, sf), _fulltext(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


# All items of the benchmark as queries, not only those whose id is divisible by 50: too many for the SQL.


@query("")
def v2_document_knn_whole(spark, sf):
    return search.knn(*_vectors(spark, sf), 20).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank", F.round("score", 6).alias("score"))


@query("")
def v5_chunk_knn_whole(spark, sf):
    return search.knn(*_vectors(spark, sf), 20, T.chunk_score, 0.3).select("query_id", "id", F.round("score", 6).alias("score"))


@query("")
def f3_keyword_ranking_whole(spark, sf):
    return _fulltext(spark, sf, every=True).select("query_id", "id", "words", "typos", "attribute", "exact", "rank")


@query("")
def h5_hybrid_search_whole(spark, sf):
    """Items through both legs, and vectors of ids divisible by 50, which have no text, through the vector leg alone;
    ``asked`` keeps them apart, as their ids have nothing to do with one another."""
    items = search.page(search.fuse_ranks(_semantic(spark, sf, every=True), _fulltext(spark, sf, every=True)), 0, 10)
    near = search.knn(*_vectors(spark, sf), 20).select("query_id", "id", "rank")
    given = search.page(search.fuse_ranks(near, near.limit(0)), 0, 10)
    return items.withColumn("asked", F.lit("text")).unionByName(given.withColumn("asked", F.lit("vector")))


@query("")
def h10_second_page_whole(spark, sf):
    return search.page(search.fuse_ranks(_semantic(spark, sf, every=True), _fulltext(spark, sf, every=True)), 10, 10).select("query_id", "id", "rank")


@query("")
def h6_weighted_fusion_whole(spark, sf):
    return search.fuse_scores(_semantic(spark, sf, every=True), _fulltext(spark, sf, every=True).withColumn("score", 1 / F.col("rank")))


@query("")
def h9_append_new_whole(spark, sf):
    return search.append_new(_semantic(spark, sf, every=True), _fulltext(spark, sf, every=True)).withColumn("rank", F.col("rank").cast("long"))


_SQL["synonyms"] = "syn(term, pos, synonym) AS (VALUES " + ", ".join(map(str, SYNONYMS)) + ")"


_SQL["queries"] = r"""n AS (SELECT item_id AS query_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM benchmark),
 s AS (SELECT query_id, unnest(list_filter(string_split(q, ' '), lambda x: x <> '' AND x NOT IN """ + str(STOP) + r""")) AS term, generate_subscripts(list_filter(string_split(q, ' '), lambda x: x <> '' AND x NOT IN """ + str(STOP) + r"""), 1) AS i FROM n),
 e AS (SELECT query_id, i, 0 AS pos, term FROM s UNION ALL SELECT query_id, i, pos, synonym FROM s JOIN syn USING (term) WHERE pos <= 3),
 u AS (SELECT query_id, term, min(i * 10 + pos) AS place, max(pos) AS p FROM e GROUP BY ALL)"""


@query("SELECT query_id, coalesce(string_agg(term, ' ' ORDER BY place), any_value(q)) AS terms, coalesce(max(p) > 0, false) AS expanded FROM n LEFT JOIN u USING (query_id) GROUP BY query_id", "synonyms", "queries")
def q4_expand_queries(spark, sf):
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.expand_queries(q, spark.createDataFrame(SYNONYMS, "term string, pos int, synonym string"), STOP)


# Context and conversations -------------------------------------------------------------------------------


@query("""SELECT doc_id AS query_id, chunk_index AS rank, CASE WHEN 40 + c <= 2000 THEN content ELSE substr(content, 1, CAST((l - 50) * 4 AS BIGINT)) || CASE WHEN length(content) > (l - 50) * 4 THEN '...' ELSE '' END END AS entry FROM (
SELECT *, 2000 - 40 - (c - t) AS l FROM (SELECT *, length(content) // 4 AS t, sum(length(content) // 4) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS c FROM chunks))
WHERE 40 + c <= 2000 OR (l >= 0 AND l - 50 > 100)""", "chunks")
def g5_token_budget(spark, sf):
    entries = _chunks(spark, sf).select(F.col("doc_id").alias("query_id"), F.col("chunk_index").alias("rank"), F.col("content").alias("entry"))
    return rag.budget(entries, 2000, 40)


@query("""SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'user' AND c.turn = m.t THEN 'CONTEXT ' || c.text ELSE c.text END AS text FROM conversations c
LEFT JOIN (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) m USING (conv_id)""")
def g7_enrich_last_user(spark, sf):
    chats = _chats(spark, sf)
    prompts = rag.last_user_turns(chats).select("conv_id", "turn", F.concat(F.lit("CONTEXT "), "prompt").alias("enriched"))
    return rag.replace_last_user(chats, prompts).select("conv_id", "turn", "role", "text")


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'system' AND turn = min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) THEN 'You have files.' || chr(10) || chr(10) || text ELSE text END AS text FROM conversations
UNION ALL SELECT conv_id, -1, 'system', 'You have files.' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0""")
def g8_system_context(spark, sf):
    return rag.with_system(_chats(spark, sf), "You have files.")


#: What is said before the text of a user's turn, one after the other: every sign of a wish, and none.
_WISHES = ["Please", "RÉSUME-moi ceci:", "count, then summarize", *(f"{x}ing" for x in T.SUMMARY), *(f"({x.upper()})" for x in T.FACTUAL)]
_SQL["prompts"] = r"""prompts AS (SELECT conv_id, turn, list_value(""" + ", ".join(f"'{x}'" for x in _WISHES) + rf""")[CAST((conv_id + turn) % {len(_WISHES)} AS INT) + 1] || ' ' || coalesce(text, '') AS prompt FROM conversations WHERE role = 'user'),
 said AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(lower(prompt), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS p FROM prompts)"""


@query(f"""SELECT conv_id, turn, CASE WHEN len(list_filter({list(T.SUMMARY)}, lambda x: contains(p, ' ' || x))) > 0 THEN 'summarize'
 WHEN len(list_filter({list(T.FACTUAL)}, lambda x: contains(p, ' ' || x || ' '))) > 0 THEN 'factual' ELSE 'rag' END AS intent FROM said""", "prompts")
def g12_intents(spark, sf):
    c = _chats(spark, sf).where("role = 'user'")
    wish = F.element_at(F.array(*map(F.lit, _WISHES)), ((F.col("conv_id") + F.col("turn")) % len(_WISHES)).cast("int") + 1)
    return c.select("conv_id", "turn", T.intent(F.concat(wish, F.lit(" "), F.coalesce("text", F.lit("")))).alias("intent"))


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM docs WHERE starts_with(path, '/corpus/src1') GROUP BY source", "docs")
def g14_count_below_prefix(spark, sf):
    return _docs(spark, sf).where(F.col("path").startswith("/corpus/src1")).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("size"))


@query("""SELECT doc_id, chunk_index FROM chunks WHERE total_chunks <= 4 UNION ALL
SELECT doc_id, CAST(floor(unnest([0, 1, 2, 3]) * (total_chunks / 4.0::DOUBLE)) AS INT) FROM chunks WHERE total_chunks > 4 AND chunk_index = 0""", "chunks")
def g19_even_sample(spark, sf):
    return rag.even_sample(_chunks(spark, sf), 4).select("doc_id", "chunk_index")


@query("SELECT doc_id, CAST(chunk_index // 5 AS INT) AS part, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY ALL", "chunks")
def g20_summary_parts(spark, sf):
    return rag.grouped_parts(_chunks(spark, sf))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def g23_sessions(spark, sf):
    return rag.sessions(_chats(spark, sf))


# Tasks and reports ---------------------------------------------------------------------------------------


@query("""SELECT n.file_path, n.task_type, min(n.id) AS id FROM tasks n WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM tasks p WHERE p.status = 'pending' AND p.file_path = n.file_path AND p.task_type = n.task_type) GROUP BY ALL""", "tasks")
def t2_enqueue(spark, sf):
    t = _tasks(spark, sf)
    return tasks.enqueue(t, t.where("status = 'failed'").select("file_path", "task_type", "id"))


@query("""SELECT file_path, arg_min(id, (CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, added_at, id)) AS id FROM tasks WHERE status = 'pending' GROUP BY 1""", "tasks")
def t3_next_tasks(spark, sf):
    return tasks.next_tasks(_tasks(spark, sf), "file_path")


@query("""SELECT task, arg_max(status, (ts, seq)) AS status, max(CASE WHEN status = 'processing' THEN ts END) AS started_at, count(*) FILTER (status = 'failed') AS failures FROM log GROUP BY 1""", "log")
def t4_latest_status(spark, sf):
    return tasks.latest_status(_log(spark, sf))


@query("""SELECT id, CASE WHEN status = 'failed' AND retry_count < 3 THEN 'pending' ELSE status END AS status, status = 'failed' AND retry_count < 3 AS retried FROM tasks""", "tasks")
def t5_retry_failed(spark, sf):
    return tasks.retry_failed(_tasks(spark, sf)).select("id", "status", "retried")


@query("""SELECT 'status' AS kind, status AS value, count(*) AS n FROM tasks GROUP BY ALL UNION ALL SELECT 'priority', priority, count(*) FROM tasks WHERE status = 'pending' GROUP BY ALL""", "tasks")
def t6_stats(spark, sf):
    return tasks.stats(_tasks(spark, sf))


@query("SELECT id, added_at FROM tasks WHERE status = 'failed' ORDER BY added_at DESC, id LIMIT 20", "tasks")
def t7_newest_failed(spark, sf):
    return _tasks(spark, sf).where("status = 'failed'").orderBy(F.desc("added_at"), "id").limit(20).select("id", "added_at")


@query("""SELECT id, CASE WHEN status = 'processing' AND (started_at IS NULL OR epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(started_at)) > 600) THEN 'pending' ELSE status END AS status FROM tasks""", "tasks")
def t9_reset_stuck(spark, sf):
    return tasks.reset_stuck(_tasks(spark, sf), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("id", "status")


@query("""SELECT task, coalesce(max(n) FILTER (bad), 0) AS longest FROM (SELECT task, bad, count(*) AS n FROM (SELECT *, status = 'failed' AS bad,
 row_number() OVER (PARTITION BY task ORDER BY ts, seq) - row_number() OVER (PARTITION BY task, status = 'failed' ORDER BY ts, seq) AS island FROM log) GROUP BY task, bad, island) GROUP BY task""", "log")
def t14_error_runs(spark, sf):
    return tasks.error_runs(_log(spark, sf), "failed")


@query("""SELECT CAST(user_id % 2 AS VARCHAR) AS backend, CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS kind, count(*) AS runs, round(avg(value), 6) AS mean FROM events WHERE event_type <> 'error' GROUP BY ROLLUP (user_id % 2, event_type) HAVING grouping(user_id % 2) = 0""")
def b1_backend_averages(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'error'").withColumn("backend", (F.col("user_id") % 2).cast("string"))
    r = e.rollup("backend", "event_type").agg(F.grouping("event_type").alias("g"), F.grouping("backend").alias("h"), F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 6).alias("mean"))
    return r.where("h = 0").select("backend", F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("kind"), "runs", "mean")


@query("""SELECT event_type, round(avg(value) FILTER (user_id % 2 = 1) / avg(value) FILTER (user_id % 2 = 0), 6) AS ratio FROM events GROUP BY 1""")
def b2_speed_ratio(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("b", F.col("user_id") % 2)
    p = e.groupBy("event_type").pivot("b", [0, 1]).agg(F.avg("value"))
    return p.select("event_type", F.round(F.col("1") / F.col("0"), 6).alias("ratio"))


# Image texts, excerpts, attachments, routes, failures ------------------------------------------------------


@query("""SELECT event_id, 'Image: img' || event_id || chr(10) || 'Dimensions: ' || user_id || 'x' || (user_id + 1) || chr(10) || 'Format: ' || event_type
 || CASE WHEN event_id % 3 > 0 THEN chr(10) || 'Date: ' || strftime(ts, '%Y-%m-%d') ELSE '' END || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Camera: ' || props ELSE '' END
 || CASE WHEN event_id % 5 > 0 THEN chr(10) || 'GPS: ' || printf('%.6f, %.6f', (event_id % 90)::DOUBLE, (event_id % 180) / 2::DOUBLE) ELSE '' END AS body FROM events""")
def x12_image_texts(spark, sf):
    e, n = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id")
    gps = lambda c: F.when(n % 5 > 0, c.cast("double"))
    text = T.image_text(
        F.concat(F.lit("img"), n.cast("string")), F.col("user_id"), F.col("user_id") + 1, F.col("event_type"), F.when(n % 3 > 0, F.date_format("ts", "yyyy-MM-dd")),
        F.when(n % 2 == 0, F.col("props")), gps(n % 90), gps((n % 180) / 2),
    )
    return e.select("event_id", text.alias("body"))


_SQL["cut"] = r"""cut AS (SELECT doc_id, ' ' || array_to_string(w[s:s + 199], ' ') || ' ' AS e FROM (
 SELECT doc_id, w, greatest(coalesce(list_position(w, 'the'), 0) - 100, 1) AS s FROM (SELECT doc_id, string_split(coalesce(content, ''), ' ') AS w FROM docs))),
 once AS (SELECT doc_id, regexp_replace(e, '([^\p{L}\p{N}])(the)([^\p{L}\p{N}])', '\1<em>\2</em>\3', 'gi') AS e FROM cut)"""


@query(r"SELECT doc_id, substr(e2, 2, length(e2) - 2) AS excerpt FROM (SELECT doc_id, regexp_replace(e, '([^\p{L}\p{N}>])(the)([^\p{L}\p{N}<])', '\1<em>\2</em>\3', 'gi') AS e2 FROM once)", "docs", "cut")
def f7_excerpts(spark, sf):
    return _docs(spark, sf).select("doc_id", T.highlight(T.crop(F.col("content"), F.lit("the")), "the").alias("excerpt"))


@query("")
def f7_excerpts_whole(spark, sf):
    return _docs(spark, sf).select("doc_id", T.highlight(T.crop(F.col("content"), F.lit("the")), "the").alias("excerpt"))


@query(r"""SELECT conv_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS attached FROM (
SELECT conv_id, turn, regexp_replace('file ' || turn || chr(10) || text, '^\s+|\s+$', '', 'g') AS t, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'user')
WHERE turn < last AND turn % 2 = 0 AND t IS NOT NULL GROUP BY conv_id""")
def g11_attachments(spark, sf):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.concat(F.lit("file "), F.col("turn").cast("string"))), part("image", F.lit("bits")), part("text", F.col("text")))
    return rag.attachments(_chats(spark, sf).withColumn("parts", F.when((F.col("turn") % 2 == 0) & F.col("text").isNotNull(), parts)))


@query("""SELECT doc_id, name, CASE WHEN doc_id % 3 < 2 THEN 'real ' || source ELSE name END AS "real", doc_id % 3 <> 0 AS enabled, doc_id % 3 < 2 AS routed FROM (
SELECT doc_id, source, source || list_value('-plain', '-context', '-other')[CAST(doc_id % 3 AS INT) + 1] AS name FROM docs)""", "docs")
def g21_g22_routes(spark, sf):
    d = _docs(spark, sf)
    bases = d.select(F.col("source").alias("base"), F.concat(F.lit("real "), "source").alias("real")).distinct()
    known = rag.routes(bases, spark.createDataFrame([("plain", False), ("context", True)], "suffix string, enabled boolean"))
    kind = F.element_at(F.array(F.lit("-plain"), F.lit("-context"), F.lit("-other")), (F.col("doc_id") % 3).cast("int") + 1)
    return rag.resolve(d.select("doc_id", F.concat("source", kind).alias("name")), known)


_SQL["failures"] = """failures AS (SELECT task, max(ts) AS failed_at, count(*) - 1 AS retry_count FROM (
 SELECT *, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY ts DESC, seq DESC) AS later FROM log) WHERE status = 'failed' AND later = 0 GROUP BY task)"""


@query("SELECT task, failed_at, retry_count FROM failures", "log", "failures")
def t10_failed_files(spark, sf):
    return tasks.failed_files(_log(spark, sf))


@query("SELECT retry_count < 3 AS retryable, count(*) AS n FROM failures WHERE failed_at > TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY GROUP BY 1", "log", "failures")
def t11_recent_failures(spark, sf):
    recent = tasks.purge(tasks.failed_files(_log(spark, sf)), F.lit("2024-02-15 00:00:00").cast("timestamp_ntz"))
    return recent.groupBy((F.col("retry_count") < 3).alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'format' AS kind, ext AS extension, count(*) AS n FROM docs WHERE doc_id % 3 = 0 GROUP BY ext UNION ALL SELECT 'content', NULL, count(*) FROM docs WHERE doc_id % 3 > 0""", "docs")
def t12_error_triage(spark, sf):
    error = F.when(F.col("doc_id") % 3 == 0, "Unsupported file").when(F.col("doc_id") % 3 == 1, "cannot read")
    return tasks.triage(_docs(spark, sf).select(F.col("ext").alias("extension"), error.alias("error")))


@query("SELECT status, count(*) AS n FROM tasks WHERE contains(task_type, '1') GROUP BY status", "tasks")
def t13_task_search(spark, sf):
    return _tasks(spark, sf).where(F.col("task_type").contains("1")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
