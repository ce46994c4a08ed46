"""The training-data pipeline: each stage takes the documents that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_stream, cminhash, decontaminate, secret_scan, toxicity_knn
from quillspark.llm.common import crc_mod, materialise, repeated, sized, table
from quillspark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many rows of decisions are broadcast.
BROADCAST_ROWS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5.

    Each row is judged by its own text, so other texts of a doc_id stay; repeated rows share their fate and
    none is merged. Rows of a null doc_id are judged alike, null and empty texts score as clean (no neighbour),
    very long ones are read whole. Without labels of both kinds every text scores what the fit says of no
    votes, below 0.5. An empty table stays empty; columns other than documents' are left out."""
    learn = crc_mod(F.col("doc_id"), 5) != 0
    index = toxicity_knn.fit(spark, docs, table(spark, sf_dir, "labels"), learn)
    return toxicity_knn.without_toxic(spark, docs.select(*COLUMNS), index)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates, that of its least doc_id.

    Rows go by doc_id and text, so a text that is like no other stays whatever becomes of other texts of its doc_id.
    Of several texts of the least doc_id in one group one stays, of rows that repeat a doc_id and text too. Rows of a
    null doc_id stay as they are; null and empty texts have no shingle and are copies of nothing. Very long texts are
    read whole, an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    gone = sized(materialise(spark, cminhash.removed_texts(spark, docs).withColumnRenamed("text_key", "_key"), "gone"), BROADCAST_ROWS)
    docs = docs.withColumn("_key", F.xxhash64("text")).join(gone, ["doc_id", "_key"], "left_anti").select(*COLUMNS)
    # only rows of ids that repeat are shuffled
    again = materialise(spark, repeated(docs), "repeated")
    if again.isEmpty():
        return docs
    again = sized(again, BROADCAST_ROWS)
    once = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(again, "doc_id", "left_anti").select(*COLUMNS).union(once.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no passage of the benchmark.

    Each row is judged by its own text, repeated rows alike; rows of a null doc_id too. Null and empty texts
    hold nothing and stay, very long ones are read whole. Items that are null or empty match nothing; with no
    items, or no documents, the table stays as it is."""
    return decontaminate.without_items(spark, docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked; ``n_chars`` follows the new text.

    Repeated rows and rows of a null doc_id are masked alike. A null text stays null and keeps its n_chars, an
    empty one stays empty, very long ones are read whole; an empty table stays empty."""
    masked = secret_scan.mask_documents(docs.select(*COLUMNS))
    return masked.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    A null text counts as empty and has no token; repeated rows give repeated rows, a null doc_id stays null.
    Very long texts are encoded in parts; an empty table gives no row."""
    return bpe_stream.encode_documents(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: SQL can't express the stages; tests hold run() against its stages' own results and against odd tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
