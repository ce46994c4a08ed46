"""From files to texts: which reader takes a file, decoding, JSON, paragraphs, and what a batch gave."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, word_count

# Extensions of each kind of reader. An extension of several kinds belongs to the first.
READERS = (
    ("pdf", (".pdf",)),
    ("docx", (".docx",)),
    ("pptx", (".pptx",)),
    ("xlsx", (".xlsx",)),
    ("odf", (".odt", ".ods", ".odp")),
    ("image", (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".webp")),
    ("json", (".json",)),
    (
        "code",
        (
            ".py", ".pyi", ".pyx", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".html", ".htm", ".css", ".scss", ".sass", ".less",
            ".json", ".yaml", ".yml", ".toml", ".xml", ".csv", ".sh", ".bash", ".zsh", ".fish", ".sql", ".r", ".rb", ".go", ".rs",
            ".c", ".cpp", ".h", ".hpp", ".java", ".kt", ".swift", ".m", ".mm",
        ),
    ),
    ("text", (".txt", ".md", ".markdown", ".rst", ".tex", ".log")),
)
MOST_BYTES = 50 << 20


def readers(spark: SparkSession, kinds: tuple = READERS) -> DataFrame:
    """extension, kind: a row per extension, of its first kind."""
    first: dict[str, str] = {}
    for kind, extensions in kinds:
        for e in extensions:
            first.setdefault(e, kind)
    return spark.createDataFrame(list(first.items()), "extension string, kind string")


def dispatch(files: DataFrame, known: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``files`` (path, size, is_file; a null size: there is no such file) with extension, kind and error. The
    first fault counts: missing, not a file, too large, unsupported; a file without one has a kind. ``known``:
    a table of readers, of fixed size."""
    rows = files.withColumn("extension", extension(F.col("path"))).join(F.broadcast(known.withColumnRenamed("kind", "_kind")), "extension", "left")
    error = (
        F.when(F.col("size").isNull(), "missing").when(~F.col("is_file"), "not a file")
        .when(F.col("size") > most, "too large").when(F.col("_kind").isNull(), "unsupported")
    )
    return rows.withColumns({"error": error, "kind": F.when(error.isNull(), F.col("_kind"))}).drop("_kind")


def decode(content: Column) -> Column:
    """Struct (text, encoding) of bytes: UTF-16 with a byte order mark, UTF-8 if the bytes are, else Latin-1."""
    head = F.hex(F.substring(content, 1, 2))
    plain = content.cast("string")
    encoding = F.when(head.isin("FEFF", "FFFE"), "utf-16").when(F.is_valid_utf8(plain), "utf-8").otherwise("latin-1")
    text = F.when(encoding == "utf-16", F.decode(content, "UTF-16")).when(encoding == "utf-8", plain).otherwise(F.decode(content, "ISO-8859-1"))
    return F.struct(text.alias("text"), encoding.alias("encoding"))


def json_texts(text: Column) -> Column:
    """Struct (text, keys, error) of JSON texts: indented, with all of their keys counted at any depth; a text that
    is no JSON stays as it is, with an error."""

    def keys(x) -> int:
        if isinstance(x, dict):
            return len(x) + sum(map(keys, x.values()))
        return sum(map(keys, x)) if isinstance(x, list) else 0

    def read(raw: str | None) -> tuple[str, int | None, str | None]:
        try:
            data = json.loads(raw or "")
            return json.dumps(data, indent=2, ensure_ascii=False), keys(data), None
        except (ValueError, RecursionError):
            return raw or "", None, "invalid JSON"

    @F.pandas_udf("text string, keys int, error string")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([read(x) for x in b], columns=["text", "keys", "error"])
            yield out.astype({"keys": "Int32"})

    return parsed(text)


_WALK = """
WITH RECURSIVE walk (id, value, named) MAX RECURSION LEVEL {most} AS (
  SELECT id, value, false FROM {rows}
  UNION ALL
  SELECT w.id, e.value, e.key IS NOT NULL FROM walk w, LATERAL variant_explode(w.value) e
)
SELECT id, named FROM walk LIMIT ALL
"""


def json_keys(texts: DataFrame, most: int = 200) -> DataFrame:
    """id, keys, error of JSON texts (id, text; ids are distinct): how many keys they have at any depth down to ``most``,
    null with an error for what is no JSON. A recursive query opens one level of all texts at a time.

    The parser stops behind the first value, so a text has to be one value both within a list and within an object: what
    follows a value can't go on both."""
    spark, name = texts.sparkSession, f"_texts_{uuid.uuid4().hex}"
    parsed = lambda a, b: F.try_parse_json(F.concat(F.lit(a), F.coalesce("text", F.lit("")), F.lit(b)))
    rows = texts.select("id", F.when(parsed('{"_": ', "}").isNotNull(), parsed("[", "]")).alias("value"))
    rows.createOrReplaceTempView(name)
    walked = spark.sql(_WALK.format(rows=name, most=most))
    spark.catalog.dropTempView(name)
    counted = walked.groupBy("id").agg(F.count_if("named").cast("int").alias("n"))
    bad = F.col("value").isNull()
    rows = rows.select("id", bad.alias("bad")).join(counted, "id")
    return rows.select("id", F.when(~F.col("bad"), F.col("n")).alias("keys"), F.when(F.col("bad"), "invalid JSON").alias("error"))


def paragraphs(parts: DataFrame) -> DataFrame:
    """doc_id, body: the parts (doc_id, i, text) of a document in order, a line each, blank ones left out."""
    kept = parts.where(F.trim("text") != "")
    body = F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    return kept.groupBy("doc_id").agg(F.array_join(body, "\n").alias("body"))


def batch_summary(extracted: DataFrame) -> DataFrame:
    """files, successful, words: of one batch of results (text, error)."""
    good = F.col("error").isNull()
    return extracted.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(good).alias("successful"), F.coalesce(F.sum(F.when(good, word_count(F.col("text")))), F.lit(0)).alias("words")
    )


def listing(known: DataFrame) -> DataFrame:
    """kind, extensions (in order, joined by commas)."""
    return known.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_set("extension")), ", ").alias("extensions"))
