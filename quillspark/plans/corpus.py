"""Queries of files, extraction, stores and chunks, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, extract, index, vectors
from ..operators.tables import shared_dir
from ..sources import files
from .catalogue import _SQL, _chunks, _docs, _embedded, _snapshots, _tasks, query

_KINDS = [(e, k) for k, extensions in reversed(extract.READERS) for e in extensions]
_SQL["readers"] = "readers AS (SELECT ext, last(kind ORDER BY pos) AS kind FROM (VALUES " + ", ".join(f"('{e}', '{k}', {i})" for i, (e, k) in enumerate(_KINDS)) + ") r(ext, kind, pos) GROUP BY ext)"
# what a file system says of each document's file
_SQL["listed"] = """listed AS (SELECT doc_id, path, ext, content, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars * 40000 END AS size, doc_id % 10 <> 1 AS is_file FROM docs),
 sent AS (SELECT l.*, r.kind AS known, CASE WHEN size IS NULL THEN 'missing' WHEN NOT is_file THEN 'not a file' WHEN size > 52428800 THEN 'too large' WHEN r.kind IS NULL THEN 'unsupported' END AS error
 FROM listed l LEFT JOIN readers r USING (ext))"""


def _listed(spark, sf):
    d, i = _docs(spark, sf), F.col("doc_id")
    return d.select("doc_id", "path", "content", F.when(i % 9 != 0, F.col("n_chars") * 40000).alias("size"), (i % 10 != 1).alias("is_file"))


# Files -------------------------------------------------------------------------------------------------


@query("")
def s1_s5_scan(spark, sf):
    """The files of the tables themselves, as a scan sees them."""
    found = files.scan(spark, [sf])
    return found.select(T.file_name(F.col("path")).alias("name"), "size", "extension", F.col("mtime").isNotNull().alias("dated"), F.col("sha256").isNull().alias("no_hash"))


@query("SELECT path, size, mtime FROM new", "docs", "snaps")
def s8_saved_state(spark, sf):
    """Two snapshots saved one after the other; what is read back is the newer."""
    old, new = _snapshots(_docs(spark, sf))
    folder = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    files.save_state(old, folder, 1)
    files.save_state(new, folder, 2)
    return files.load_state(spark, folder, "path string, size long, mtime long")


_SQL["checked"] = """checked AS (SELECT doc_id, asked, CASE WHEN NOT starts_with(asked, '/') THEN 'not absolute' WHEN n.path IS NULL THEN 'missing' WHEN doc_id % 17 = 0 THEN 'not a file' WHEN doc_id % 19 = 0 THEN 'not readable' END AS error
 FROM (SELECT doc_id, path, CASE WHEN doc_id % 5 = 0 THEN substr(path, 2) ELSE path END AS asked FROM docs) d LEFT JOIN new n ON d.path = n.path)"""


def _checked(spark, sf):
    d, i = _docs(spark, sf), F.col("doc_id")
    asked = d.select("doc_id", "path", F.when(i % 5 == 0, F.substr("path", F.lit(2))).otherwise(F.col("path")).alias("asked"))
    rows = asked.join(_snapshots(d)[1].select("path", F.lit(True).alias("there")), "path", "left")
    return rows.select("doc_id", "asked", files.request_error(F.col("asked"), F.col("there").isNotNull(), i % 17 != 0, i % 19 != 0).alias("error"))


@query("SELECT doc_id, error FROM checked", "docs", "snaps", "checked")
def s10_request_errors(spark, sf):
    return _checked(spark, sf).select("doc_id", "error")


@query("""SELECT count(*) FILTER (error IS NOT NULL) = 0 AS success, count(*) FILTER (error IS NULL) AS queued, count(*) FILTER (error IS NOT NULL) AS skipped,
(SELECT string_agg(error || ': ' || asked, chr(10) ORDER BY doc_id) FROM (SELECT * FROM checked WHERE error IS NOT NULL ORDER BY doc_id LIMIT 10)) AS errors FROM checked""", "docs", "snaps", "checked")
def s10_batch_outcome(spark, sf):
    return files.ingest_outcome(_checked(spark, sf).select(F.col("doc_id").alias("id"), F.col("asked").alias("path"), "error"))


# Extraction ----------------------------------------------------------------------------------------------


@query("SELECT path, CASE WHEN error IS NULL THEN known END AS kind, error FROM sent", "docs", "readers", "listed")
def x1_dispatch(spark, sf):
    return extract.dispatch(_listed(spark, sf), extract.readers(spark)).select("path", "kind", "error")


_PLAIN = r"[^\x00-\x7F -ÿ]"


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN regexp_replace(coalesce(content, ''), '[^\x00-\x7F\x{00A0}-\x{00FF}]', '?', 'g') ELSE coalesce(content, '') END AS text,
 CASE WHEN doc_id % 3 = 2 THEN 'utf-16' WHEN doc_id % 3 = 1 AND regexp_matches(content, '[\x{00A0}-\x{00FF}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM docs""", "docs")
def x2_x3_decode(spark, sf):
    """Texts encoded in three ways and read back without being told which."""
    i, text = F.col("doc_id") % 3, F.coalesce("content", F.lit(""))
    content = F.when(i == 2, F.encode(text, "UTF-16")).when(i == 1, F.encode(F.regexp_replace(text, _PLAIN, "?"), "ISO-8859-1")).otherwise(text.cast("binary"))
    return _docs(spark, sf).select("doc_id", content.alias("content")).select("doc_id", extract.decode(F.col("content")).alias("x")).select("doc_id", "x.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN props || ']' WHEN event_id % 4 = 1 THEN '{' || chr(10) || '  "a": [' || chr(10) || '    {' || chr(10) || '      "k": ' || k || chr(10) || '    }' || chr(10) || '  ],' || chr(10) || '  "é": null' || chr(10) || '}'
 ELSE '{' || chr(10) || '  "k": ' || k || chr(10) || '}' END AS text, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 3 ELSE 1 END AS keys, CASE WHEN event_id % 4 = 0 THEN 'invalid JSON' END AS error
 FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def x4_json(spark, sf):
    i, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(i == 0, F.concat(p, F.lit("]"))).when(i == 1, F.concat(F.lit('{"a": ['), p, F.lit('], "é": null}'))).otherwise(p)
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", raw.alias("raw"))
    return e.select("event_id", extract.json_texts(F.col("raw")).alias("x")).select("event_id", "x.*")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 3 ELSE 1 END AS keys, CASE WHEN event_id % 4 = 0 THEN 'invalid JSON' END AS error FROM events""")
def x4_json_keys(spark, sf):
    i, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(i == 0, F.concat(p, F.lit("]"))).when(i == 1, F.concat(F.lit('{"a": ['), p, F.lit('], "é": null}'))).otherwise(p)
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), raw.alias("text"))
    return extract.json_keys(e).withColumnRenamed("id", "event_id")


@query("""SELECT doc_id, CASE WHEN length(trim(coalesce(content, ''))) >= CASE WHEN ext = '.py' THEN 50 ELSE 20 END THEN coalesce(l, 'unknown') END AS language
FROM docs LEFT JOIN (SELECT doc_id, arg_max(language, (n, language)) AS l FROM told GROUP BY 1) USING (doc_id)""", "docs", "profiles")
def x6_language_floor(spark, sf):
    """No language below 20 characters, or 50 of code."""
    from .catalogue import x6_language

    d = _docs(spark, sf)
    enough = F.length(F.trim(F.coalesce("content", F.lit("")))) >= F.when(F.col("ext") == ".py", 50).otherwise(20)
    return d.select("doc_id", enough.alias("enough")).join(x6_language(spark, sf), "doc_id").select("doc_id", F.when(F.col("enough"), F.col("language")).alias("language"))


@query("""SELECT doc_id, string_agg(p, chr(10) ORDER BY i) AS body FROM (SELECT doc_id, unnest(string_split(coalesce(content, ''), chr(10))) AS p, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) AS i FROM docs)
 WHERE trim(p) <> '' GROUP BY doc_id""", "docs")
def x8_paragraphs(spark, sf):
    return extract.paragraphs(_docs(spark, sf).select("doc_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("i", "text")))


@query("""SELECT event_id, 'Image: i' || event_id || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Exposure: 1/' || user_id ELSE '' END || CASE WHEN event_id % 3 > 0 THEN chr(10) || 'Aperture: f/' || CAST(user_id % 16 AS VARCHAR) ELSE '' END
 || CASE WHEN event_id % 5 > 0 THEN chr(10) || 'ISO: ' || (user_id * 100) ELSE '' END AS body FROM events""")
def x12_image_details(spark, sf):
    n, u, none = F.col("event_id"), F.col("user_id"), F.lit(None).cast("string")
    text = T.image_text(F.concat(F.lit("i"), n.cast("string")), none, none, none, none, none, none.cast("double"), none.cast("double"))
    some = lambda on, value: F.when(on, value)
    body = T.image_details(text, some(n % 2 == 0, F.concat(F.lit("1/"), u.cast("string"))), some(n % 3 > 0, (u % 16).cast("string")), some(n % 5 > 0, (u * 100).cast("string")))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", body.alias("body"))


@query(r"SELECT count(*) AS files, count(*) FILTER (error IS NULL) AS successful, CAST(sum(CASE WHEN error IS NULL THEN len(regexp_extract_all(coalesce(content, ''), '[^\s]+')) ELSE 0 END) AS BIGINT) AS words FROM sent", "docs", "readers", "listed")
def x17_batch_summary(spark, sf):
    sent = extract.dispatch(_listed(spark, sf), extract.readers(spark))
    return extract.batch_summary(sent.select(F.col("content").alias("text"), "error"))


@query("SELECT kind, count(DISTINCT ext) AS files_of, string_agg(DISTINCT ext, ', ' ORDER BY ext) AS extensions FROM (SELECT DISTINCT ext FROM docs) JOIN readers USING (ext) GROUP BY kind", "docs", "readers")
def x18_listing(spark, sf):
    """The readers, with their extensions, of the files that there are."""
    there = _docs(spark, sf).select(F.col("ext").alias("extension")).distinct()
    known = extract.readers(spark).join(there, "extension", "left_semi")
    return extract.listing(known).join(known.groupBy("kind").agg(F.countDistinct("extension").alias("files_of")), "kind").select("kind", "files_of", "extensions")


# Stores --------------------------------------------------------------------------------------------------

_SQL["job"] = """ex AS (SELECT path, content AS text, CASE WHEN doc_id % 6 = 0 THEN 'unreadable' END AS error FROM docs),
 outcomes AS (SELECT d.path, CASE WHEN d.path IN (SELECT path FROM old WHERE size % 2 = 0 UNION ALL SELECT path FROM new WHERE size % 5 = 0) THEN 'skipped' WHEN e.error IS NOT NULL OR trim(coalesce(e.text, '')) = '' THEN 'failed' ELSE 'indexed' END AS outcome, e.text
 FROM docs d JOIN ex e USING (path))"""


def _outcomes(spark, sf):
    d = _docs(spark, sf)
    old, new = _snapshots(d)
    extracted = d.select("path", F.col("content").alias("text"), F.when(F.col("doc_id") % 6 == 0, "unreadable").alias("error"))
    return index.index_files(d.select("path"), old.where("size % 2 = 0"), new.where("size % 5 = 0"), extracted)


@query("SELECT path, outcome, CASE WHEN outcome = 'indexed' THEN length(text) END AS chars FROM outcomes", "docs", "snaps", "job")
def i1_index_job(spark, sf):
    return _outcomes(spark, sf).select("path", "outcome", F.length("text").alias("chars"))


@query("""SELECT count(*) AS total, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
 100 * count(*) FILTER (outcome = 'indexed') / count(*) AS success_rate FROM outcomes""", "docs", "snaps", "job")
def i3_outcome_counts(spark, sf):
    return index.outcome_counts(_outcomes(spark, sf))


@query("""SELECT path, size, mtime, coalesce(category, 'autre') AS category, substr(body, 1, 100) AS body FROM (SELECT path, size, mtime, CASE WHEN size % 3 > 0 THEN 'known' END AS category, repeat(path, 9) AS body FROM new)
UNION ALL SELECT path, size, mtime, 'old', 'old' FROM old WHERE path NOT IN (SELECT path FROM new)""", "docs", "snaps")
def i5_i6_batch_upsert(spark, sf):
    """A batch with repeated paths, missing categories and long bodies."""
    old, new = _snapshots(_docs(spark, sf))
    new = new.withColumns({"category": F.when(F.col("size") % 3 > 0, "known"), "body": F.repeat("path", 9)})
    stale = new.withColumns({"mtime": F.col("mtime") - 5, "body": F.lit("stale")})
    old = old.withColumns({"category": F.lit("old"), "body": F.lit("old")})
    return index.upsert_batch(old, new.union(stale), "path", "mtime", {"category": "autre"}, {"body": 100})


@query("""SELECT path, path IN (SELECT path FROM old) AS in_fulltext, path IN (SELECT path FROM new) AS in_vectors FROM docs WHERE doc_id % 4 = 0""", "docs", "snaps")
def i8_delete_both(spark, sf):
    d = _docs(spark, sf)
    return index.delete_both(*_snapshots(d), d.where("doc_id % 4 = 0"), "path")[2]


@query("SELECT d.path, o.path IS NOT NULL AS found, o.size FROM docs d LEFT JOIN old o USING (path)", "docs", "snaps")
def i9_lookup(spark, sf):
    d = _docs(spark, sf)
    return index.lookup(_snapshots(d)[0].select("path", "size"), d, "path").select("path", "found", "size")


@query("SELECT count(*) AS total, max(len(embedding))::INT AS dimension, CAST(sum(4 * len(embedding)) AS BIGINT) AS bytes, round(sum(4 * len(embedding)) / 1048576, 2) AS mb FROM embeddings")
def i10_vector_stats(spark, sf):
    return index.vector_stats(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding")


@query("""SELECT greatest(f.n, v.n) AS documents, f.n AS fulltext, v.n AS vectors, t.pending, t.processing, t.completed, t.failed FROM (SELECT count(*) AS n FROM old) f, (SELECT count(*) AS n FROM new) v,
 (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM tasks) t""", "docs", "snaps", "tasks")
def i12_combined_stats(spark, sf):
    return index.combined_stats(*_snapshots(_docs(spark, sf)), _tasks(spark, sf))


@query("SELECT path FROM old UNION SELECT path FROM new", "docs", "snaps")
def i13_indexed_paths(spark, sf):
    old, new = _snapshots(_docs(spark, sf))
    return old.select("path").union(new.select("path")).distinct()


@query("SELECT count(*) AS removed, 0::BIGINT AS remaining FROM old", "docs", "snaps")
def i14_clear(spark, sf):
    left, removed = index.cleared(_snapshots(_docs(spark, sf))[0])
    return removed.crossJoin(left.agg(F.count(F.lit(1)).alias("remaining")))


@query("""SELECT asked, coalesce(e, c) AS path, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'contains' END AS "match" FROM (SELECT asked, (SELECT min(path) FROM docs WHERE path = asked) AS e,
 (SELECT min(path) FROM docs WHERE contains(lower(path), stem)) AS c FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE '/moved/SRC' || (doc_id % 7) || '/' || doc_id || '0.doc' END AS asked,
 CASE WHEN doc_id % 2 = 0 THEN '' ELSE doc_id || '0' END AS stem FROM docs WHERE doc_id % 50 < 2))""", "docs")
def i16_path_check(spark, sf):
    """Asked for: the paths of ids divisible by 50, and files of other folders named after the next ids."""
    d, i = _docs(spark, sf), F.col("doc_id")
    moved = F.concat(F.lit("/moved/SRC"), (i % 7).cast("string"), F.lit("/"), i.cast("string"), F.lit("0.doc"))
    return index.find_paths(d.where("doc_id % 50 < 2").select(F.when(i % 2 == 0, F.col("path")).otherwise(moved).alias("path")), d)


@query("SELECT path FROM old EXCEPT SELECT path FROM new", "docs", "snaps")
def i17_missing_vectors(spark, sf):
    return index.pending(*_snapshots(_docs(spark, sf)), "path").select("path").distinct()


_SQL["tries"] = """tries AS (SELECT doc_id, content, length(trim(coalesce(content, ''))) >= 100 AS long FROM docs WHERE doc_id % 3 = 0), sizes AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)"""


@query("""SELECT t.doc_id, CASE WHEN long THEN coalesce(n, 0) ELSE 0 END AS removed, CASE WHEN long THEN coalesce(n, 0) ELSE 0 END AS written, CASE WHEN long THEN greatest(1, length(content) // 1536) ELSE 0 END AS estimate
 FROM tries t LEFT JOIN sizes USING (doc_id)""", "docs", "chunks", "tries")
def i19_rechunk(spark, sf):
    d = _docs(spark, sf)
    return chunk.rechunk(d.where("doc_id % 3 = 0"), _chunks(spark, sf))[1]


# Chunks --------------------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, coalesce(n, 0)::INT AS chunks, length(t) // 3 AS tokens, t <> '' AS success, CASE WHEN t = '' THEN 'Empty document text' END AS error FROM norm d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)""", "chunks")
def c4_chunk_results(spark, sf):
    return chunk.chunk_results(_docs(spark, sf))


@query("SELECT coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END, sha256(t)) AS doc_id, count(*) AS chunks FROM chunks JOIN norm USING (doc_id) GROUP BY 1", "chunks")
def c6_chunk_text(spark, sf):
    """Texts without an id are chunked under the hash of what is chunked; equal texts are then one document."""
    own = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    d = _docs(spark, sf).select(F.coalesce(own, F.sha2(T.normalise_text(F.col("content")), 256)).alias("doc_id"), "content")
    return chunk.fixed_chunks(d).groupBy("doc_id").agg(F.count("chunk_id").alias("chunks"))


_SQL["chunkvec"] = "parts AS (SELECT chunk_id AS id, content AS t FROM chunks),\n " + _embedded("cvec", "parts")


def _chunk_vectors(spark, sf):
    return _chunks(spark, sf).withColumn("vector", vectors.embed(F.col("content")))


@query("SELECT id AS chunk_id, round(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS square FROM cvec", "chunks", "chunkvec")
def c7_append_chunks(spark, sf):
    """Chunks of even documents are there with vectors; those of odd ones come without and are embedded."""
    c = _chunks(spark, sf)
    old = c.where("doc_id % 2 = 0").withColumn("vector", vectors.embed(F.col("content")))
    new = c.where("doc_id % 2 = 1").withColumn("vector", F.lit(None).cast("array<float>"))
    both = index.append_chunks(old, new, vectors.embed)[0]
    return both.select("chunk_id", F.round(T.dot(F.col("vector"), F.col("vector")), 4).alias("square"))


@query("SELECT d.doc_id, coalesce(n, 0) AS removed FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id) WHERE d.doc_id % 5 = 0", "docs", "chunks")
def c8_delete_chunks(spark, sf):
    return index.delete_chunks(_chunks(spark, sf), _docs(spark, sf).where("doc_id % 5 = 0"))[1]


@query("SELECT doc_id, chunk_index, chunk_id, content FROM chunks WHERE doc_id % 50 = 0 AND doc_id IN (SELECT doc_id FROM docs)", "docs", "chunks")
def c9_chunks_of_documents(spark, sf):
    asked = _docs(spark, sf).where("doc_id % 50 = 0").select("doc_id")
    return _chunks(spark, sf).join(asked, "doc_id", "left_semi").select("doc_id", "chunk_index", "chunk_id", "content")


@query("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM chunks", "chunks")
def c11_chunk_stats(spark, sf):
    return index.chunk_stats(_chunks(spark, sf))
