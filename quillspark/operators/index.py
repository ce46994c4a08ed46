"""Maintenance of document, vector and chunk tables. Tables are replaced by new versions, never in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialise


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, blank: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; of several new ones the last by
    ``order`` counts. ``blank``: column of ``new`` that must hold more than white space."""
    if blank:
        new = new.where(F.trim(F.coalesce(blank, F.lit(""))) != "")
    last = W.partitionBy(key).orderBy(F.desc(order))
    new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def pending(files: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Files that are not indexed yet."""
    return files.join(indexed.select(key), key, "left_anti")


def group_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """field, value, n: one pass of grouping sets over the columns; the total stands under ``total``."""
    sets = rows.groupingSets([[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    n = len(columns)
    field, value = F.lit("total"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        here = F.col("g") == (1 << n) - 1 - (1 << (n - 1 - k))
        field, value = F.when(here, c).otherwise(field), F.when(here, F.col(c).cast("string")).otherwise(value)
    return sets.select(field.alias("field"), value.alias("value"), "n")


def field_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """field, n: how many rows have the field."""
    one = rows.agg(*(F.count(c).alias(c) for c in columns))
    return one.unpivot([], list(columns), "field", "n")


def sync(fulltext: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """fulltext, vectors, missing, surplus, percent of two stores."""
    a, b = fulltext.select(key, F.lit(1).alias("a")), vectors.select(key, F.lit(1).alias("b"))
    both = a.join(b, key, "full_outer").agg(F.count("a").alias("fulltext"), F.count("b").alias("vectors"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("surplus"))
    return both.withColumn("percent", F.when(F.col("fulltext") > 0, F.floor(100 * F.col("vectors") / F.col("fulltext"))).otherwise(0).cast("long"))


def upsert_batch(old: DataFrame, new: DataFrame, key: str, order: str, defaults: dict[str, str], cut: dict[str, int] | None = None) -> DataFrame:
    """``upsert`` of a batch; missing values take ``defaults``, texts are cut to ``cut`` characters."""
    new = new.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    new = new.withColumns({c: F.substring(c, 1, n) for c, n in (cut or {}).items()})
    return upsert(old, new, key, order)


def index_files(files: DataFrame, fulltext: DataFrame, vectors: DataFrame, extracted: DataFrame, key: str = "path", force: bool = False) -> DataFrame:
    """key, outcome, text of every file: ``skipped`` if either store has it (unless ``force``), ``failed`` if there
    is no text, else ``indexed``, to be written to both stores and chunked. A file counts once."""
    files = files.select(key).distinct()
    known = fulltext.select(key).union(vectors.select(key)).distinct().withColumn("known", F.lit(not force))
    rows = files.join(known, key, "left").join(extracted.select(key, "text", "error"), key, "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    outcome = F.when(F.coalesce("known", F.lit(False)), "skipped").when(F.col("error").isNotNull() | blank, "failed").otherwise("indexed")
    return rows.select(key, outcome.alias("outcome"), F.when(outcome == "indexed", F.col("text")).alias("text"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """total, indexed, skipped, failed, success_rate (per cent of the total; 0 of none)."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    rows = outcomes.agg(F.count(F.lit(1)).alias("total"), n("indexed"), n("skipped"), n("failed"))
    return rows.withColumn("success_rate", F.when(F.col("total") > 0, 100 * F.col("indexed") / F.col("total")).otherwise(0.0))


def delete_both(fulltext: DataFrame, vectors: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both stores without the keys, and for each key whether it was in each of them (key, in_fulltext, in_vectors)."""
    asked = keys.select(key).distinct()
    there = lambda rows, name: rows.select(key).distinct().withColumn(name, F.lit(True))
    told = asked.join(there(fulltext, "in_fulltext"), key, "left").join(there(vectors, "in_vectors"), key, "left")
    told = told.select(key, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_fulltext", "in_vectors")))
    return without(fulltext, asked, key), without(vectors, asked, key), told


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """key, found, and the columns of ``rows``: a row for each of the distinct ``keys``, found or not."""
    found = rows.withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def combined_stats(fulltext: DataFrame, vectors: DataFrame, tasks: DataFrame) -> DataFrame:
    """documents (of the larger store), fulltext, vectors, pending, processing, completed, failed: one row."""
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    states = tasks.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")))
    rows = one(fulltext, "fulltext").crossJoin(one(vectors, "vectors")).crossJoin(states)  # of one row each
    return rows.withColumn("documents", F.greatest("fulltext", "vectors"))


def vector_stats(vectors: DataFrame, vector: str) -> DataFrame:
    """total, dimension (the greatest), bytes, mb (two places) of a table of float vectors."""
    rows = vectors.agg(F.count(F.lit(1)).alias("total"), F.max(F.size(vector)).alias("dimension"), F.coalesce(F.sum(4 * F.size(vector)), F.lit(0)).cast("long").alias("bytes"))
    return rows.withColumn("mb", F.round(F.col("bytes") / (1 << 20), 2))


def cleared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without rows, and how many there were (removed)."""
    return rows.limit(0), rows.agg(F.count(F.lit(1)).alias("removed"))


def grams(text: Column, n: int) -> Column:
    """The distinct sequences of ``n`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def paths_with(stems: DataFrame, paths: DataFrame) -> DataFrame:
    """stem, path: the least of ``paths`` (path) that holds each of ``stems`` (stem, lower case) in any case.

    Of a stem's sequences of three characters the one that the fewest paths have is its key: paths with it are looked at.
    Only sequences of asked stems are indexed. A stem of one or two characters is a key itself."""
    spark, size = stems.sparkSession, F.least(F.length("stem"), F.lit(3))
    of = lambda text, n: F.when(n == 3, grams(text, 3)).when(n == 2, grams(text, 2)).otherwise(grams(text, 1))
    asked = stems.where("stem <> ''").distinct().select("stem", F.explode(of(F.col("stem"), size)).alias("gram"))
    asked = materialise(spark, asked, "asked-grams")
    low, sizes = F.lower("path"), [r.n for r in asked.select(F.length("gram").alias("n")).distinct().collect()]  # three at most
    cut = F.concat(F.array().cast("array<string>"), *(grams(low, n) for n in sizes))
    rows = paths.select("path").distinct().select("path", F.explode(cut).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    rows = materialise(spark, rows, "path-grams")
    held = asked.join(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keys = held.groupBy("stem").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return keys.join(rows, "gram").where(F.contains(low, F.col("stem"))).groupBy("stem").agg(F.min("path").alias("path"))


def find_paths(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked, path, match (exact, contains or null): the document of each asked path, else the first by path whose
    path holds the asked file's stem in any case."""
    ask = asked.select(F.col("path").alias("asked")).distinct()
    exact = ask.join(rows.select(F.col("path").alias("asked")).distinct().withColumn("path", F.col("asked")), "asked")
    rest = ask.join(exact.select("asked"), "asked", "left_anti")
    rest = rest.withColumn("stem", F.lower(F.regexp_replace(F.element_at(F.split("asked", "/"), -1), r"(?<=.)\.[^.]+$", "")))
    near = rest.join(paths_with(rest.select("stem"), rows), "stem").select("asked", "path")
    found = exact.withColumn("match", F.lit("exact")).unionByName(near.withColumn("match", F.lit("contains")))
    return ask.join(found, "asked", "left")


def append_chunks(old: DataFrame, new: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """The chunk table with ``new`` chunks, those without a vector embedded (``embed``: Column to Column), and how
    many were added."""
    vector = F.coalesce(F.col("vector"), embed(F.col("content")))
    return old.unionByName(new.withColumn("vector", vector).select(*old.columns)), new.agg(F.count(F.lit(1)).alias("added"))


def delete_chunks(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunk table without the chunks of ``docs`` (doc_id), and doc_id, removed."""
    asked = docs.select("doc_id").distinct()
    removed = asked.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("removed")), "doc_id", "left")
    return without(chunks, asked, "doc_id"), removed.select("doc_id", F.coalesce("removed", F.lit(0)).alias("removed"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """chunks, documents: counted exactly, whatever their number."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"))
