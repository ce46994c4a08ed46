"""Quality rules: statistics of one text, and how many documents of a host share each line.

Normalised lines are hashed, and the documents of each host that have a line are counted. Lines in more
documents than the limit are boilerplate and count as removed; a document that loses most of its characters
is rejected. On request exact copies of a text count once, so that copies do not reject one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, materialise, split_join

_SYMBOLS = r"[#*$%&|<>]"
_POSITION_BITS = 24


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more."""

    def covered(positions: Column) -> Column:
        # positions ascend: each window adds what lies beyond the one before
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"))
        return F.aggregate(positions, start, step, lambda acc: acc["sum"])

    def dup(places: Column, hashes: Column) -> Column:
        # places in the order of their windows: equal windows stand side by side
        at = lambda i: F.get(hashes, F.get(places, i))
        own = lambda p, i: (at(i) == at(i - 1)) | (at(i) == at(i + 1))
        return F.sort_array(F.filter(places, lambda p, i: F.coalesce(own(p, i), F.lit(False))))

    def twice(hashes: Column) -> Column:
        # hash and place of each window in one long, as long as the places fit and no two windows share the
        # rest of a hash; else both in a struct, which is sorted slower
        mask = (1 << _POSITION_BITS) - 1
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
        place = lambda p: p.bitwiseAND(F.lit(mask)).cast("int")
        rest = lambda p: p.bitwiseAND(F.lit(~mask))

        def mixed(order: Column) -> Column:
            at = lambda p: F.get(hashes, place(p))
            both = F.transform(order, lambda p, i: (rest(p) == rest(F.get(order, i - 1))) & (at(p) != at(F.get(order, i - 1))))
            return F.exists(both, lambda x: F.coalesce(x, F.lit(False)))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        whole = lambda: F.transform(pairs, lambda x: x["i"])
        chosen = let(packed, lambda order: F.when(mixed(order), whole()).otherwise(F.transform(order, place)))
        chosen = F.when(F.size(hashes) > (1 << _POSITION_BITS), whole()).otherwise(chosen)
        return let(chosen, lambda places: covered(dup(places, hashes)))

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), twice(h)).otherwise(F.lit(0).cast("long"))
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows(w), some)))


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), f"{SPACE}+"), "")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("(?s)[^\\x20\\x09-\\x0D]"))
    long = lambda c: c.cast("long")
    rows = docs.withColumns({"_words": words, "_lines": lines})
    rows = rows.select(
        *docs.columns,
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        long(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_SYMBOLS))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_rows(docs: DataFrame) -> DataFrame:
    """source, doc_id, text_hash, pos (of all lines), line (hash), chars: a row per line with a word."""
    plain = F.translate(F.lower("text"), "123456789", "000000000")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""))
    cut = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("line"), F.length(x).alias("chars")))
    rows = docs.select("source", "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.filter(cut, lambda x: x["chars"] > 0)).alias("_x"))
    return rows.select("source", "doc_id", "text_hash", "_x.pos", "_x.line", "_x.chars")


def without_lines(text: Column, places: Column) -> Column:
    """``text`` without its lines at ``places``, in time in proportion to its length."""

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), kept)


def judge_lines(
    spark: SparkSession, docs: DataFrame, max_docs: int = 50, max_removed: float = 0.5, broadcast_rows: int = 200_000,
    copies: bool = False,
) -> DataFrame:
    """A row per document: doc_id, base statistics, base_failed, removed (share of characters), kept, text
    (without the removed lines; null stays null).

    A line of a host that more than ``max_docs`` distinct texts of this host have (``copies``: documents,
    so that exact copies of a text count each) is removed; a document
    that loses more than ``max_removed`` of its characters is not kept. Null text counts as empty and
    fails the base rules; a null source is a host of its own. Rows that repeat a doc_id and text get
    equal results. Texts of any length are read whole; an empty table gives no row. Only doc_id, source and
    text are read of ``docs``.
    """
    docs = docs.select("doc_id", "source", "text")
    lines = line_rows(docs)
    common = (
        lines.select("source", "line", "doc_id" if copies else "text_hash").distinct()
        .groupBy("source", "line").count().where(F.col("count") > max_docs)
        .select("source", "line")
    )
    # lines of a host by one key; a line that most documents have is dealt to many tasks
    key = F.xxhash64(F.col("source").isNull(), "source", "line").alias("_key")
    common = materialise(spark, common.select(key), "common-lines")
    found = split_join(spark, lines.select("*", key), common, "_key", "doc_id", broadcast_rows, "left_semi", counted=lines.select(key))
    found = (
        found.groupBy("doc_id", "source", "text_hash").agg(F.collect_set(F.struct("pos", "chars")).alias("common"))
        .withColumnsRenamed({n: f"_{n}" for n in ("doc_id", "source", "text_hash")})
    )
    rows = base_rules(docs).withColumn("text_hash", F.xxhash64("text")).join(
        found,
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.col("_text_hash")),
        "left",
    )
    cleaned = F.when(F.col("common").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.transform("common", lambda x: x["pos"])))
    gone = F.aggregate("common", F.lit(0), lambda n, x: n + x["chars"])
    share = F.when(F.length("text") > 0, F.coalesce(gone / F.length("text"), F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumns({"cleaned": cleaned, "removed": share})
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("removed") <= max_removed)).alias("kept"), "removed", F.col("cleaned").alias("text"),
    )
