"""Queries of filtered, sorted and paged searches, contexts, factual answers, task reports and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, filters, rag, search, tasks, vectors
from ..operators.tables import materialise, sized
from .catalogue import _SQL, STOP, SYNONYMS, _chats, _chunks, _corpus, _docs, _fulltext, _items, _nearest, _semantic, _tasks, query
from .corpus import _chunk_vectors

# documents with what filters and sorts look at: a category, and a date that some lack and some have in a form of their own
_SQL["tagged"] = """tagged AS (SELECT doc_id AS id, source AS title, content, path, ext AS file_type, lang AS language, n_chars AS file_size,
 CASE WHEN ext IN ('.pdf', '.docx') THEN 'document' WHEN ext IN ('.txt', '.md') THEN 'text' WHEN ext = '.py' THEN 'code' WHEN ext = '.jpg' THEN 'image' WHEN ext = '.csv' THEN 'spreadsheet' ELSE 'other' END AS category,
 CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'last week' ELSE '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15' END AS created_at FROM docs)"""
_KEPT = """category IN ('document', 'text', 'other') AND contains(lower(path), '/src') AND file_type IN ('.pdf', '.txt', '.zip')
 AND (created_at IS NULL OR created_at = 'last week' OR created_at BETWEEN '2024-03-01' AND '2024-09-30')"""


def _tagged(spark, sf):
    d, i = _docs(spark, sf), F.col("doc_id")
    month = F.concat(F.lit("2024-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-15"))
    date = F.when(i % 7 == 0, None).when(i % 7 == 1, "last week").otherwise(month)
    return d.select(
        i.alias("id"), F.col("source").alias("title"), "content", "path", F.col("ext").alias("file_type"), F.col("lang").alias("language"),
        F.col("n_chars").alias("file_size"), T.category(F.col("ext")).alias("category"), date.alias("created_at"),
    )


FILTER = filters.Filter(file_types=(".PDF", ".txt", ".zip"), path_contains="/SRC", date_after="2024-03-01", date_before="2024-09-30")


# Filters, sorts, pages and modes -------------------------------------------------------------------------


@query("SELECT id FROM tagged WHERE category = 'text' AND language = 'en' AND file_type IN ('.md')", "docs", "tagged")
def f4_equality_filters(spark, sf):
    return _tagged(spark, sf).where(filters.Filter("text", "en", (".md",)).on()).select("id")


@query(f"SELECT id FROM tagged WHERE {_KEPT}", "docs", "tagged")
def h2_path_date_type_filters(spark, sf):
    return _tagged(spark, sf).where(FILTER.on()).select("id")


_SQL["kept_vecs"] = f"kept AS (SELECT dvec.* FROM dvec JOIN tagged USING (id) WHERE {_KEPT}),\n " + _nearest("semk", "kept", "qvec")


@query("SELECT query_id, id, rank FROM semk", "docs", "tagged", "embedded", "kept_vecs")
def h1_filtered_semantic_leg(spark, sf):
    """Filters come before distances, so a query gets all of its places."""
    q = _items(spark, sf).select("query_id", vectors.embed(F.col("query")).alias("qvector"))
    rows = _tagged(spark, sf).where(FILTER.on()).select("id", vectors.embed(F.col("content")).alias("vector"))
    return vectors.knn(q, materialise(spark, rows, "embedded"), 20).select("query_id", "id", "rank")


_SQL["labelled"] = "vecs AS (SELECT vec_id AS id, embedding AS vector FROM embeddings WHERE label = 3), qvecs AS (SELECT vec_id AS id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0),\n " + _nearest("sem3", "vecs", "qvecs")


@query("SELECT query_id, id, round(1 / (1 + distance), 6) AS score FROM sem3 WHERE 1 / (1 + distance) >= 0.4", "labelled")
def v6_prefiltered_knn(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector"))
    found = vectors.knn(q, e.where("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 20, least=0.4)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("")
def v8_approximate_knn(spark, sf):
    """An inverted file of codes: cells by the square root of the rows, two in three of them probed, as the tables'
    vectors hardly gather, and the vectors themselves read for fifty codes a query; tests hold recall above 0.9."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvector"))
    index = vectors.build_index(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return vectors.approximate_knn(q, index, 10, probes=0.65, candidates=5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


_SQL["near_terms"] = r"""npost AS (SELECT id, attr, w[g] AS term, g - 1 AS pos FROM (SELECT id, attr, w, unnest(range(1, len(w) + 1)) AS g FROM (
  SELECT doc_id AS id, attr, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM (SELECT doc_id, 0 AS attr, source AS t FROM documents UNION ALL SELECT doc_id, 1, coalesce(text, '') FROM documents)))),
 nq AS (SELECT query_id, qterm, min(g) - 1 AS first FROM (SELECT query_id, w[g] AS qterm, g FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS g FROM (
  SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id % 50 = 0))) GROUP BY query_id, qterm),
 nqt AS (SELECT query_id, qterm, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS qpos FROM nq),
 top AS (SELECT query_id, id, words, typos, attribute, exact FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY words DESC, typos) AS r FROM found) WHERE r <= 20),
 occ AS (SELECT DISTINCT t.query_id, t.id, p.attr, p.pos, n.qpos FROM top t JOIN npost p ON p.id = t.id JOIN words x ON x.query_id = t.query_id AND x.term = p.term JOIN nqt n ON n.query_id = x.query_id AND n.qterm = x.qterm),
 gaps AS (SELECT a.query_id, a.id, a.qpos, least(8, min(greatest(1, abs(a.pos - b.pos)))) AS gap FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.id = b.id AND a.attr = b.attr AND b.qpos = a.qpos + 1 GROUP BY ALL),
 closeness AS (SELECT t.query_id, t.id, (SELECT (max(qpos)) * 8 FROM nqt n WHERE n.query_id = t.query_id) - coalesce(sum(8 - gap), 0) AS proximity FROM top t LEFT JOIN gaps g ON g.query_id = t.query_id AND g.id = t.id GROUP BY t.query_id, t.id)"""


@query("""SELECT query_id, id, words, typos, CAST(proximity AS BIGINT) AS proximity, attribute, exact, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, typos, proximity, attribute, exact DESC, id) AS rank
FROM top JOIN closeness USING (query_id, id) QUALIFY rank <= 20""", "terms", "near_terms")
def f3_proximity_ranking(spark, sf):
    found = search.keyword_search(_items(spark, sf), search.postings(_corpus(spark, sf), ("title", "content")), 20, proximity=True)
    return found.select("query_id", "id", "words", "typos", F.col("proximity").cast("long").alias("proximity"), "attribute", "exact", "rank")


@query("""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, typos, attribute, n_chars DESC NULLS LAST, exact DESC, id) AS rank
FROM found JOIN documents ON doc_id = id QUALIFY rank <= 20""", "terms")
def f5_sorted_ranking(spark, sf):
    """The largest files first among documents that match equally well."""
    size = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("key"))
    found = search.keyword_search(_items(spark, sf), search.postings(_corpus(spark, sf), ("title", "content")), 20, sort=size, descending=True)
    return found.select("query_id", "id", "rank")


@query("SELECT query_id, id, rank FROM ft WHERE rank BETWEEN 6 AND 12", "terms")
def f6_offset_and_limit(spark, sf):
    return search.page(_fulltext(spark, sf), 5, 10, most=12).select("query_id", "id", "rank")


@query("""SELECT query_id, id, rank FROM ft UNION ALL SELECT -1, doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 20""", "terms")
def f8_blank_query_lists_all(spark, sf):
    blank = spark.createDataFrame([(-1, " ")], "query_id long, query string")
    return search.or_all(_items(spark, sf).union(blank), _fulltext(spark, sf), _corpus(spark, sf), 20).withColumn("rank", F.col("rank").cast("long"))


_SQL["semantic_only"] = ", only AS (SELECT query_id, id, round((0.6 / (60 + rank)) / max(0.6 / (60 + rank)) OVER (PARTITION BY query_id), 4) AS score, rank FROM sem)"


@query("""SELECT 'semantic' AS mode, query_id, id, round((1.0::DOUBLE / (60 + rank)) / (1.0::DOUBLE / 61), 4) AS score, rank FROM sem WHERE rank <= 10
UNION ALL SELECT 'fulltext', query_id, id, round((1.0::DOUBLE / (60 + rank)) / (1.0::DOUBLE / 61), 4), rank FROM ft WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, id, score, rank FROM ranked WHERE rank <= 10""", "fused")
def h3_modes(spark, sf):
    near, matched = materialise(spark, _semantic(spark, sf), "near"), materialise(spark, _fulltext(spark, sf), "matched")
    legs, rows = (lambda: near, lambda: matched), None
    for mode in filters.MODES:
        part = search.page(search.by_mode(mode, *legs, filters.MODES), 0, 10).select(F.lit(mode).alias("mode"), "query_id", "id", "score", F.col("rank").cast("long").alias("rank"))
        rows = part if rows is None else rows.union(part)
    return rows


@query("""SELECT event_id, nullif(concat_ws('; ', CASE WHEN n NOT BETWEEN 1 AND 1000 THEN 'query has to have 1 to 1000 characters' END, CASE WHEN l NOT BETWEEN 1 AND 100 THEN 'limit has to be 1 to 100' END,
 CASE WHEN o < 0 THEN 'offset has to be 0 or more' END, CASE WHEN event_type NOT IN ('view', 'click') THEN 'mode has to be one of hybrid, semantic, fulltext' END, CASE WHEN event_id % 3 = 2 THEN 'sort has to be one of created_at, file_size, title' END), '') AS faults
FROM (SELECT *, event_id % 1100 AS n, user_id % 103 AS l, event_id % 7 - 1 AS o FROM events)""")
def h13_request_faults(spark, sf):
    """A table of requests, made of the events, and what is wrong with each."""
    e, i = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id")
    mode = F.when(F.col("event_type") == "view", "hybrid").when(F.col("event_type") == "click", F.lit(None)).otherwise("best")
    rows = e.select(
        i, F.repeat(F.lit("q"), (i % 1100).cast("int")).alias("query"), (F.col("user_id") % 103).alias("limit"), (i % 7 - 1).alias("offset"), mode.alias("mode"),
        F.when(i % 3 == 1, "title").when(i % 3 == 2, "color").alias("sort"),
    )
    return filters.request_faults(rows).select("event_id", "faults")


@query("""SELECT event_id, round(CASE WHEN s IS NULL THEN 1 - (k % 10) / 10.0::DOUBLE WHEN s BETWEEN 0 AND 1 THEN s ELSE 1 / (1 + abs(s)) END, 9) AS score FROM (
SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value / CASE WHEN event_id % 2 = 0 THEN 1000 ELSE -50 END END AS s, event_id AS k FROM events)""")
def h7_normalised_scores(spark, sf):
    e, i = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id")
    s = F.when(i % 4 > 0, F.col("value") / F.when(i % 2 == 0, 1000).otherwise(-50))
    return e.select("event_id", F.round(T.normalised_score(s, i % 10, F.lit(10)), 9).alias("score"))


@query("""SELECT query_id, rank, id, path, CASE WHEN id % 4 = 0 THEN regexp_extract(path, '[^/]+$') ELSE title END AS title, CASE WHEN length(content) > 500 THEN content[1:500] || '...' ELSE coalesce(content, '') END AS content,
 try_cast(created_at AS TIMESTAMP) AS modified_at FROM ft JOIN tagged USING (id) WHERE rank <= 10""", "terms", "docs", "tagged")
def h11_result_rows(spark, sf):
    docs = _tagged(spark, sf).withColumn("title", F.when(F.col("id") % 4 > 0, F.col("title")))
    return filters.result_rows(search.page(_fulltext(spark, sf), 0, 10), docs).withColumn("modified_at", F.col("modified_at").cast("timestamp_ntz"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND trim(CASE WHEN turn % 4 = 0 THEN '  ' ELSE coalesce(text, '') END) <> ''")
def h12_blank_queries(spark, sf):
    c = _chats(spark, sf).where("role = 'user'")
    q = c.select(F.struct("conv_id", "turn").alias("query_id"), F.when(F.col("turn") % 4 == 0, "  ").otherwise(F.col("text")).alias("query"))
    return filters.asked(q).select("query_id.*")


_ALWAYS = ("the", "que")


@query(rf"""SELECT conv_id, turn, len(w) <= 4 OR len(list_filter(w, lambda x: x IN {_ALWAYS})) > 0 AS expand FROM (
SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations)""")
def q5_expand_decision(spark, sf):
    return _chats(spark, sf).select("conv_id", "turn", search.should_expand(F.coalesce("text", F.lit("")), _ALWAYS).alias("expand"))


@query(rf"""SELECT item_id AS query_id, 0 AS variant, text FROM benchmark UNION ALL SELECT query_id, 1, terms FROM (
 SELECT query_id, string_agg(term, ' ' ORDER BY place) AS terms, max(p) > 0 AS expanded FROM u GROUP BY 1) JOIN benchmark ON item_id = query_id WHERE expanded AND terms <> text
 AND (SELECT len(w) <= 4 OR len(list_filter(w, lambda x: x IN {_ALWAYS})) > 0 FROM (SELECT list_filter(string_split(q, ' '), lambda x: x <> '') AS w FROM n WHERE n.query_id = item_id))""", "synonyms", "queries")
def q6_query_variants(spark, sf):
    return search.query_variants(_items(spark, sf, every=True), spark.createDataFrame(SYNONYMS, "term string, pos int, synonym string"), STOP, _ALWAYS)


# Contexts ------------------------------------------------------------------------------------------------

_SQL["chunkvec"] = _SQL["chunkvec"]
_SQL["parts"] = _SQL["chunks"] + ",\n asked AS (SELECT item_id AS id, coalesce(text, '') AS t FROM benchmark WHERE item_id % 50 = 0),\n "
_SCORE = "CASE WHEN distance <= 2 THEN greatest(0, 1 - distance / 2) ELSE 1 / (1 + distance) END"


def _chunk_hits(spark, sf, k: int = 20, least: float = 0.3):
    q = _items(spark, sf).select("query_id", vectors.embed(F.col("query")).alias("qvector"))
    rows = _chunk_vectors(spark, sf).select(F.col("chunk_id").alias("id"), "vector")
    return vectors.knn(q, materialise(spark, rows, "embedded-chunks"), k, T.chunk_score, least)


def _chunk_context(spark, sf, limit: int = 5, least: float = 0.1):
    """The chunks of a query are few: only the documents that they come from are cut again."""
    found = materialise(spark, rag.relevant(_chunk_hits(spark, sf, 2 * limit, least), limit, least), "chunk-hits", small=True)
    ids = materialise(spark, found.select(chunk.chunk_document(F.col("id")).alias("doc_id")).distinct(), "hit-documents", small=True)
    docs = _docs(spark, sf).join(sized(ids, vectors.MOST_CANDIDATES), "doc_id", "left_semi")
    return materialise(spark, rag.chunk_context(found, chunk.fixed_chunks(docs), limit, least), "chunk-context")


def _embedded_items() -> str:
    from .catalogue import _embedded

    return "asked AS (SELECT item_id AS id, coalesce(text, '') AS t FROM benchmark WHERE item_id % 50 = 0),\n " + _embedded("qvec", "asked")


_SQL["near_chunks"] = _embedded_items() + ",\n " + _nearest("semc", "cvec", "qvec") + f""",
 scored AS (SELECT query_id, id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, {_SCORE} AS score FROM semc WHERE rank <= 10 AND {_SCORE} >= 0.1),
 taken AS (SELECT query_id, chunk_id, place AS rank, round(score, 4) AS score, doc_id, chunk_index, total_chunks, content FROM scored JOIN chunks USING (chunk_id) WHERE place <= 5)"""


@query("SELECT query_id, rank, chunk_id, score, (SELECT count(DISTINCT doc_id) FROM taken o WHERE o.query_id = t.query_id)::INT AS documents FROM taken t", "chunks", "chunkvec", "near_chunks")
def v7_g2_chunk_context(spark, sf):
    return _chunk_context(spark, sf).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "documents")


_SQL["near_some_chunks"] = _embedded_items() + """,
 wanted AS (SELECT v.* FROM cvec v JOIN chunks ON chunk_id = v.id WHERE doc_id % 3 = 0),\n """ + _nearest("semd", "wanted", "qvec")


@query(f"SELECT query_id, id, round({_SCORE}, 6) AS score, rank FROM semd WHERE {_SCORE} >= 0.1", "chunks", "chunkvec", "near_some_chunks")
def v5_chunks_of_documents(spark, sf):
    """The nearest chunks of the documents asked for: the filter comes before distances, so each query gets its places."""
    q = _items(spark, sf).select("query_id", vectors.embed(F.col("query")).alias("qvector"))
    rows = _chunks(spark, sf).where("doc_id % 3 = 0").select(F.col("chunk_id").alias("id"), vectors.embed(F.col("content")).alias("vector"))
    found = vectors.knn(q, materialise(spark, rows, "embedded-chunks"), 20, T.chunk_score, 0.1)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, '<em>The</em> ' || source || ', <em>the</em>_ file of <em>the</em> ' || source AS title FROM docs", "docs")
def f7_marked_titles(spark, sf):
    title = F.concat(F.lit("The "), "source", F.lit(", the_ file of the "), "source")
    return _docs(spark, sf).select("doc_id", T.highlight(title, "the").alias("title"))


@query("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id, score FROM ranked WHERE rank <= 10 AND score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5", "fused")
def g1_document_context(spark, sf):
    ranked = search.page(search.fuse_ranks(_semantic(spark, sf), _fulltext(spark, sf)), 0, 10)
    return rag.relevant(ranked, 5, 0.3).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


_ENTRY = """'[' || rank || '] doc ' || doc_id || ' [' || (chunk_index + 1) || '/' || total_chunks || ']' || chr(10) || '    Path: /d/' || doc_id || chr(10) || CASE WHEN score > 0 THEN '    Relevance: ' || CAST(round_even(100 * score, 0) AS INT) || '%' || chr(10) ELSE '' END
 || '    Content: ' || content"""


def _entries(spark, sf):
    rows = _chunk_context(spark, sf)
    name = F.col("doc_id").cast("string")
    part = F.concat(F.lit("["), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total_chunks").cast("string"), F.lit("]"))
    text = rag.entry(F.col("rank"), F.concat(F.lit("doc "), name), F.concat(F.lit("/d/"), name), F.col("score"), F.col("content"), part)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "documents", text.alias("entry"))


@query(f"SELECT query_id, rank, {_ENTRY} AS entry FROM taken", "chunks", "chunkvec", "near_chunks")
def g4_entries(spark, sf):
    return _entries(spark, sf).select("query_id", "rank", "entry")


_HEAD = "Passages from your documents:"
_SQL["contexts"] = f"""ent AS (SELECT query_id, rank, {_ENTRY} AS entry FROM taken), sums AS (SELECT *, length(entry) // 4 AS t, sum(length(entry) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM ent),
 fit AS (SELECT query_id, rank, CASE WHEN 20 + c <= 900 THEN entry ELSE substr(entry, 1, CAST((900 - 20 - (c - t) - 50) * 4 AS BIGINT)) || CASE WHEN length(entry) > (900 - 20 - (c - t) - 50) * 4 THEN '...' ELSE '' END END AS entry FROM sums
  WHERE 20 + c <= 900 OR (900 - 20 - (c - t) >= 0 AND 900 - 20 - (c - t) - 50 > 100)),
 ctx AS (SELECT query_id, '{_HEAD}' || chr(10) || chr(10) || string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS entries FROM fit GROUP BY 1)"""


@query("SELECT query_id, context, entries, length(context) // 4 AS tokens FROM ctx", "chunks", "chunkvec", "near_chunks", "contexts")
def g5_g6_contexts(spark, sf):
    return rag.contexts(_entries(spark, sf), F.lit(_HEAD), 900, 20)


@query("""SELECT item_id AS query_id, CASE WHEN item_id % 100 = 50 AND context IS NOT NULL THEN 'chunks' WHEN item_id % 100 = 0 THEN 'documents' ELSE 'none' END AS mode,
 'Use the context.' || chr(10) || chr(10) || CASE WHEN item_id % 100 = 50 AND context IS NOT NULL THEN context || chr(10) || chr(10) WHEN item_id % 100 = 0 THEN 'Documents of ' || item_id || chr(10) || chr(10) ELSE '' END || coalesce(text, '') AS enriched
 FROM (SELECT * FROM benchmark WHERE item_id % 50 = 0) b LEFT JOIN ctx ON query_id = item_id""", "chunks", "chunkvec", "near_chunks", "contexts")
def g6_enriched_prompts(spark, sf):
    """Chunks are found for every other item; for the rest documents stand in."""
    q = _items(spark, sf)
    of_chunks = rag.contexts(_entries(spark, sf), F.lit(_HEAD), 900, 20).where("query_id % 100 = 50")
    of_docs = q.where("query_id % 100 = 0").select("query_id", F.concat(F.lit("Documents of "), F.col("query_id").cast("string")).alias("context"))
    return rag.enrich(q.select("query_id", F.coalesce("query", F.lit("")).alias("prompt")), of_chunks, of_docs, "Use the context.")


@query("""SELECT query_id, string_agg(chunk_id || ' | doc ' || doc_id || ' | /d/' || doc_id || ' | ' || printf('%.4f', score), chr(10) ORDER BY rank) AS sources FROM taken GROUP BY 1""", "chunks", "chunkvec", "near_chunks")
def g24_citations(spark, sf):
    rows, name = _chunk_context(spark, sf), F.col("doc_id").cast("string")
    return rag.citations(rows.select("query_id", "rank", F.col("chunk_id").alias("id"), F.concat(F.lit("doc "), name).alias("title"), F.concat(F.lit("/d/"), name).alias("path"), "score"))


@query("""SELECT conv_id AS profile_id, concat_ws(chr(10) || chr(10), CASE WHEN conv_id % 3 > 0 THEN 'I am assistant ' || conv_id END, CASE WHEN conv_id % 2 > 0 THEN 'User: number ' || conv_id END,
 CASE WHEN conv_id % 5 > 0 THEN 'Indexed folders:' || chr(10) || '- /a/' || conv_id || chr(10) || '- /b' END) AS context FROM (SELECT DISTINCT conv_id FROM conversations)""")
def g9_system_texts(spark, sf):
    i = F.col("conv_id")
    name = lambda head: F.concat(F.lit(head), i.cast("string"))
    rows = _chats(spark, sf).select("conv_id").distinct().select(
        i.alias("profile_id"), F.when(i % 3 > 0, name("I am assistant ")).otherwise(" ").alias("identity"), F.when(i % 2 > 0, name("number ")).alias("user"),
        F.when(i % 5 > 0, F.array(name("/a/"), F.lit("/b"))).otherwise(F.array().cast("array<string>")).alias("folders"),
    )
    return rag.system_texts(rows)


# Factual answers -------------------------------------------------------------------------------------------

_SQL["questions"] = """questions AS (SELECT conv_id * 1000 + turn AS prompt_id, CASE turn % 4 WHEN 0 THEN 'How many files in /corpus/src' || (conv_id % 12) || '/ ?' WHEN 1 THEN 'list /corpus/src1' || CASE WHEN conv_id % 2 = 0 THEN '/1' ELSE '' END || ', please'
 WHEN 2 THEN 'Liste ~/books/x.' ELSE 'no path here' END AS prompt, CASE turn % 4 WHEN 0 THEN '/corpus/src' || (conv_id % 12) WHEN 1 THEN '/corpus/src1' || CASE WHEN conv_id % 2 = 0 THEN '/1' ELSE '' END WHEN 2 THEN '/home/user/books/x' END AS prefix, turn % 4 IN (1, 2) AS wants FROM conversations),
 asked_for AS (SELECT DISTINCT prefix FROM questions WHERE prefix IS NOT NULL), numbers AS (SELECT prefix, count(path) AS n FROM asked_for LEFT JOIN docs ON starts_with(path, prefix) GROUP BY 1),
 shown AS (SELECT prefix, path, source AS title, row_number() OVER (PARTITION BY prefix ORDER BY path) AS place FROM asked_for JOIN docs ON starts_with(path, prefix) QUALIFY place <= 20)"""


def _questions(spark, sf):
    c, t, n = _chats(spark, sf), F.col("turn") % 4, F.col("conv_id")
    own = F.concat(F.lit("How many files in /corpus/src"), (n % 12).cast("string"), F.lit("/ ?"))
    listed = F.concat(F.lit("list /corpus/src1"), F.when(n % 2 == 0, "/1").otherwise(""), F.lit(", please"))
    prompt = F.when(t == 0, own).when(t == 1, listed).when(t == 2, "Liste ~/books/x.").otherwise("no path here")
    return c.select((n * 1000 + F.col("turn")).alias("prompt_id"), prompt.alias("prompt"))


@query("SELECT prompt_id, prefix AS path FROM questions", "docs", "questions")
def g13_prompt_paths(spark, sf):
    return _questions(spark, sf).select("prompt_id", rag.prompt_path(F.col("prompt")).alias("path"))


@query("SELECT prefix, n FROM numbers", "docs", "questions")
def g14_counts_of_prompts(spark, sf):
    asked = _questions(spark, sf).select(rag.prompt_path(F.col("prompt")).alias("prefix"))
    return rag.counts_below(asked, _docs(spark, sf))


@query("SELECT prefix, CAST(place AS INT) AS place, title, path FROM shown", "docs", "questions")
def g15_lists_of_prompts(spark, sf):
    asked = _questions(spark, sf).select(rag.prompt_path(F.col("prompt")).alias("prefix"))
    return rag.lists_below(asked, _docs(spark, sf).select("path", F.col("source").alias("title")))


@query("""SELECT prompt_id, CASE WHEN prefix IS NULL THEN NULL WHEN n = 0 THEN 'no documents under ' || prefix WHEN wants THEN least(n, 20) || ' listed under ' || prefix || chr(10) || l ELSE n || ' documents under ' || prefix END AS answer
FROM questions LEFT JOIN numbers USING (prefix) LEFT JOIN (SELECT prefix, string_agg('- ' || title || ' (' || path || ')', chr(10) ORDER BY place) AS l FROM shown GROUP BY 1) USING (prefix)""", "docs", "questions")
def g16_factual_answers(spark, sf):
    return rag.factual_answers(_questions(spark, sf), _docs(spark, sf).select("path", F.col("source").alias("title")))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'My book ' || conv_id WHEN 1 THEN 'notes-' || conv_id || '.docx' WHEN 2 THEN 'the plan of ' || conv_id WHEN 3 THEN 'un titre' END AS name FROM conversations""")
def g17_document_names(spark, sf):
    t, n = F.col("turn") % 5, F.col("conv_id").cast("string")
    prompt = (
        F.when(t == 0, F.concat(F.lit('summarize "My book '), n, F.lit('" for me'))).when(t == 1, F.concat(F.lit("(notes-"), n, F.lit(".docx) please")))
        .when(t == 2, F.concat(F.lit("Summarize the plan of "), n, F.lit(" ?"))).when(t == 3, "résume-moi « un titre » vite").otherwise("hello there")
    )
    return _chats(spark, sf).select("conv_id", "turn", rag.document_name(prompt).alias("name"))


@query("""SELECT query_id, arg_min(id, (CASE WHEN contains(lower(title), 'src' || query_id % 7) OR contains(path, 'src' || query_id % 7) THEN 0 ELSE 1 END, rank)) AS id FROM ft JOIN (SELECT doc_id AS id, source AS title, path FROM docs) USING (id) WHERE rank <= 5 GROUP BY 1""", "docs", "terms")
def g18_resolved_documents(spark, sf):
    named = _items(spark, sf).select("query_id", F.concat(F.lit("SRC"), (F.col("query_id") % 7).cast("string")).alias("name"))
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "path")
    return rag.resolve_documents(named, _fulltext(spark, sf).select("query_id", "id", "rank"), docs)


_SQL["partials"] = """nums AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS i FROM chunks), groups AS (SELECT doc_id, i // 5 AS part, string_agg(content, chr(10) || chr(10) ORDER BY i) AS t FROM nums GROUP BY ALL),
 partials AS (SELECT doc_id, part, CASE WHEN length(t) % 7 = 0 THEN '[part ' || (part + 1) || ' failed]' ELSE substr(t, 1, 60) END AS p FROM groups), wholes AS (SELECT doc_id, count(*) AS parts, string_agg(p, chr(10) || chr(10) ORDER BY part) AS t FROM partials GROUP BY 1)"""


@query("SELECT doc_id, parts, CASE WHEN parts = 1 OR length(t) % 7 = 0 THEN t ELSE substr(t, 1, 60) END AS summary FROM wholes", "chunks", "partials")
def g20_summaries(spark, sf):
    """A writer that takes the beginning of a text, and fails for some; no document of the tables is sampled."""
    write = lambda t: F.when(F.length(t) % 7 != 0, F.substring(t, 1, 60))
    return rag.summaries(_chunks(spark, sf), write, most=1000)


@query("")
def g20_central_summaries(spark, sf):
    """Every document by its most central sentences: of parts of five chunks, even ones of 100 at most, and then of the
    parts' sentences."""
    return rag.summaries(_chunks(spark, sf), rag.central_sentences())


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'real ' || source ELSE name END AS "real", CASE doc_id % 4 WHEN 0 THEN false ELSE true END AS enabled, CASE WHEN doc_id % 4 = 1 THEN 'text,code' END AS categories, doc_id % 4 < 2 AS routed
 FROM (SELECT doc_id, source, list_value(source || '-plain', source || '-docs-only', source || '-other', 'x-plain')[CAST(doc_id % 4 AS INT) + 1] AS name FROM docs)""", "docs")
def g21_suffix_routes(spark, sf):
    d, i = _docs(spark, sf), F.col("doc_id")
    bases = d.select(F.col("source").alias("base"), F.concat(F.lit("real "), "source").alias("real")).distinct()
    suffixes = spark.createDataFrame([("plain", 0, False, None), ("docs-only", 1, True, "text,code"), ("only", 2, True, "image")], "suffix string, place int, enabled boolean, categories string")
    name = F.element_at(F.array(*(F.concat(F.col("source") if k < 3 else F.lit("x"), F.lit(x)) for k, x in enumerate(("-plain", "-docs-only", "-other", "-plain")))), (i % 4).cast("int") + 1)
    return rag.resolve_suffixes(d.select("doc_id", name.alias("name")), bases, suffixes).drop("name")


@query("SELECT user_id AS conv_id, count(*) AS messages, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM events GROUP BY 1")
def g23_timed_sessions(spark, sf):
    return rag.timed_sessions(spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("conv_id"), "ts"))


# Tasks and reports -----------------------------------------------------------------------------------------

_SQL["errors"] = """errs AS (SELECT user_id AS task, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
 CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN 'reason ' || (event_id % 4) WHEN event_type = 'error' THEN ' ' END AS error FROM events)"""


def _errors(spark, sf):
    from .catalogue import _status

    e, i = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id")
    error = F.when(F.col("event_type") == "error", F.when(i % 3 > 0, F.concat(F.lit("reason "), (i % 4).cast("string"))).otherwise(" "))
    return e.select(F.col("user_id").alias("task"), i.alias("seq"), "ts", _status().alias("status"), error.alias("error"))


@query("""SELECT task, status, started_at, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN ts END AS completed_at, CASE WHEN status = 'failed' THEN error END AS error, retry_count FROM (
SELECT task, arg_max(status, (ts, seq)) AS status, max(ts) AS ts, max(CASE WHEN status = 'processing' THEN ts END) AS started_at, arg_max(coalesce(error, ''), (ts, seq)) AS error, count(*) FILTER (status = 'failed' AND error <> '') AS retry_count FROM errs GROUP BY 1)""", "errors")
def t4_transitions(spark, sf):
    return tasks.transitions(_errors(spark, sf))


@query("""SELECT 'status' AS kind, status AS value, count(*) AS n FROM tasks GROUP BY ALL UNION ALL SELECT 'task_type', task_type, count(*) FROM tasks GROUP BY ALL
UNION ALL SELECT 'priority', priority, count(*) FROM tasks WHERE status = 'pending' GROUP BY ALL""", "tasks")
def t6_stats_by_type(spark, sf):
    return tasks.stats_by(_tasks(spark, sf))


@query("SELECT id, status, priority FROM tasks WHERE id % 50 = 0", "tasks")
def t7_task_lookup(spark, sf):
    t = _tasks(spark, sf)
    return t.join(t.where("id % 50 = 0").select("id").distinct(), "id", "left_semi").select("id", "status", "priority")


@query("SELECT id, status FROM tasks WHERE status <> 'completed'", "tasks")
def t8_clear_completed(spark, sf):
    return tasks.without_completed(_tasks(spark, sf))[0].select("id", "status")


@query("""SELECT coalesce(nullif(trim(error), ''), 'unknown') AS reason, count(*) AS n, count(*) FILTER (seq % 5 < 3) AS retryable FROM errs WHERE status = 'failed' GROUP BY 1""", "errors")
def t11_failure_reasons(spark, sf):
    failed = _errors(spark, sf).where("status = 'failed'")
    return tasks.failure_reasons(failed.withColumn("retry_count", F.col("seq") % 5))


@query("""SELECT worker, processed, failed, consecutive_errors, longest FROM (SELECT worker, count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status = 'failed' AND later = 0) AS consecutive_errors FROM (SELECT *, task % 16 AS worker, count(*) FILTER (status = 'completed') OVER (PARTITION BY task % 16 ORDER BY ts DESC, seq DESC) AS later FROM log) GROUP BY 1)
 JOIN (SELECT worker, coalesce(max(n) FILTER (bad), 0) AS longest FROM (SELECT worker, bad, island, count(*) AS n FROM (SELECT task % 16 AS worker, status = 'failed' AS bad,
  row_number() OVER (PARTITION BY task % 16 ORDER BY ts, seq) - row_number() OVER (PARTITION BY task % 16, status = 'failed' ORDER BY ts, seq) AS island FROM log) GROUP BY ALL) GROUP BY 1) USING (worker)""", "log")
def t14_worker_counters(spark, sf):
    from .catalogue import _log

    return tasks.worker_counters(_log(spark, sf).withColumn("worker", F.col("task") % 16).drop("task"))


@query("""SELECT event_type, ratio, CASE WHEN ratio > 1.5 THEN 'strong' WHEN ratio > 1.1 THEN 'faster' WHEN ratio > 0.9 THEN 'similar' ELSE 'slower' END AS band FROM (
SELECT event_type, round(avg(value) FILTER (user_id % 7 = 1) / avg(value) FILTER (user_id % 7 = 0), 2) AS ratio FROM events GROUP BY 1)""")
def b2_recommendation(spark, sf):
    """How much faster one of two is, in the bands of the report."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("b", F.col("user_id") % 7)
    r = F.round(F.avg(F.when(F.col("b") == 1, F.col("value"))) / F.avg(F.when(F.col("b") == 0, F.col("value"))), 2)
    rows = e.groupBy("event_type").agg(r.alias("ratio"))
    x = F.col("ratio")
    return rows.select("event_type", "ratio", F.when(x > 1.5, "strong").when(x > 1.1, "faster").when(x > 0.9, "similar").otherwise("slower").alias("band"))
