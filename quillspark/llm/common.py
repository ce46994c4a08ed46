"""Helpers that all training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import let, materialise, shared_dir, sized  # noqa: F401

#: A word: a longest run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot that has more rows than this, and more than a ten-thousandth of all rows.
HOT_ROWS = 2_000


def split_join(
    spark: SparkSession, left: DataFrame, right: DataFrame, key: str, spread: str, broadcast_rows: int, how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """``left`` joined with ``right`` by ``key`` (inner, left or left_semi), whatever share of the rows a key has.

    A ``right`` (a written table) of at most ``broadcast_rows`` rows is broadcast. Beyond that, the rows of a hot key of
    ``left`` are dealt by ``spread`` to as many parts as keep each below ``HOT_ROWS`` or a ten-thousandth of all rows,
    and every part gets the key's rows of ``right``. ``counted``: a cheaper table of the keys of ``left``."""
    if right.count() <= broadcast_rows:
        return left.join(F.broadcast(right), key, how)
    counts = materialise(spark, (left if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    most = max(HOT_ROWS, (counts.agg(F.sum("_n")).first()[0] or 0) // 10_000)
    hot = counts.where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))  # ten thousand at most
    if hot.isEmpty():
        return left.join(right, key, how)
    hot, parts = F.broadcast(hot), F.col("_parts")
    dealt = left.join(hot, key, "left").withColumn("_part", F.when(parts.isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), parts)).cast("int"))
    every = F.when(parts.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))
    met = right.join(hot, key, "left").withColumn("_part", F.explode(every))
    return dealt.drop("_parts").join(met.drop("_parts"), [key, "_part"], how).drop("_part")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of at most ``rows`` rows, so that a task holds little beside its input; what Arrow has kept
    goes back when the task is done."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    pa.default_memory_pool().release_unused()


def repeated(rows: DataFrame) -> DataFrame:
    """The doc_ids that several rows have."""
    return rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def digest_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
