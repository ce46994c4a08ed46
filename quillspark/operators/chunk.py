"""Chunking: fixed windows in Spark, and windows that end at natural breaks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_text, tokens_estimate
from .tables import let


@dataclass(frozen=True)
class Sizes:
    """Characters: size of a window, overlap, least and greatest size of a chunk."""

    size: int = 1536
    overlap: int = 150
    least: int = 300
    most: int = 3072


def window_count(length: Column, s: Sizes) -> Column:
    """How many fixed windows a text of a length has; a short last window joins the one before it."""
    step = s.size - s.overlap
    n = F.when(length <= s.size, 1).otherwise(F.ceil((length - s.size) / step) + 1)
    return let(n.cast("int"), lambda n: F.when((n > 1) & (length - (n - 1) * step < s.least), n - 1).otherwise(n))


def fixed_offsets(length: Column, s: Sizes) -> Column:
    """Array of (start, end, total) of fixed windows."""
    step = s.size - s.overlap

    def windows(x: Column) -> Column:
        end = lambda i: F.when(i == x["n"] - 1, x["length"]).otherwise(F.least(i * step + s.size, x["length"]))
        return F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.struct((i * step).alias("start"), end(i).alias("end"), x["n"].alias("total")))

    return let(length, lambda n: let(F.struct(n.alias("length"), window_count(n, s).alias("n")), windows))


def fixed_chunks(docs: DataFrame, s: Sizes = Sizes()) -> DataFrame:
    """A row per chunk of ``docs`` (doc_id, content): chunk_id, doc_id, chunk_index, total_chunks, offset_start,
    offset_end, content. Blank texts have no chunk. A text is cut once into pieces of a step, of which each window
    joins its own, so that the work grows with the length; no row carries the whole text, nothing is shuffled."""
    step = s.size - s.overlap
    cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def windows(x: Column) -> Column:
        """Of a text's length, number of windows and pieces."""

        def window(i: Column) -> Column:
            last = i == x["n"] - 1
            # the windows before the last take as many pieces as reach over their size, the last takes all
            own = F.array_join(F.slice(x["pieces"], i + 1, F.when(last, F.size(x["pieces"])).otherwise(-(-s.size // step))), "")
            end = F.when(last, x["length"]).otherwise(i * step + s.size)
            content = F.when(last, own).otherwise(F.left(own, F.lit(s.size)))
            return F.struct((i * step).cast("int").alias("start"), end.cast("int").alias("end"), x["n"].alias("total"), content.alias("content"))

        return F.transform(F.sequence(F.lit(0), x["n"] - 1), window)

    def chunks(text: Column) -> Column:
        sized = let(F.length(text), lambda n: F.struct(n.alias("length"), window_count(n, s).alias("n"), cut(text).alias("pieces")))
        return F.when(text != "", let(sized, windows))

    rows = docs.select("doc_id", F.posexplode(let(normalise_text(F.col("content")), chunks)).alias("chunk_index", "c"))
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", F.col("c.total").alias("total_chunks"),
        F.col("c.start").alias("offset_start"), F.col("c.end").alias("offset_end"), "c.content",
    )


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_"), F.lpad(index.cast("string"), 5, "0"))


def chunk_document(chunk_id: Column) -> Column:
    """The doc_id (a number) of a chunk."""
    return F.regexp_replace(chunk_id, "_[0-9]+$", "").cast("long")


# After which strings a window may end, the best first.
BREAKS = ("\n\n", ". ", "。", "! ", "? ", "！", "？", "\n", ", ", "、", "; ", ": ", " ")


def break_point(text: str, start: int, end: int, size: int) -> int:
    """The end of the window [start, end): behind the last break of the best kind that begins after the first
    character of the last fifth of ``size``; ``end`` if there is none."""
    low = max(start, end - int(size * 0.2))
    ends = (at + len(b) for b in BREAKS if (at := text.rfind(b, low + 1, end)) >= 0)
    return next(ends, end) if end < len(text) else len(text)


def split_text(text: str, s: Sizes) -> list[tuple[int, int, str]]:
    """(start, end, content) of overlapping windows of a normalised text."""
    out: list[tuple[int, int, str]] = []
    start = 0
    while start < len(text):
        end = break_point(text, start, min(start + s.size, len(text)), s.size)
        part = text[start:end].strip()
        if out and len(part) < s.least and len(out[-1][2]) + len(part) + 1 <= s.most:
            if part:
                out[-1] = (out[-1][0], end, f"{out[-1][2]} {part}")
        elif part:
            out.append((start, end, part))
        if end >= len(text):
            break
        # a step back that would not get past the last chunk's start is left out
        start = end - s.overlap if out and end - s.overlap > out[-1][0] else end
    return out


def break_chunks(docs: DataFrame, s: Sizes = Sizes()) -> DataFrame:
    """As fixed_chunks, with windows that end at breaks: sequential within a text, parallel across texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise_text(F.col("content")).alias("text")).where("text <> ''")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [(d, split_text(t, s)) for d, t in zip(f.doc_id, f.text)]
            found = [(d, i, len(chunks), *c) for d, chunks in parts for i, c in enumerate(chunks)]
            yield pd.DataFrame(found, columns=["doc_id", "chunk_index", "total_chunks", "offset_start", "offset_end", "content"])

    rows = rows.mapInPandas(run, "doc_id long, chunk_index int, total_chunks int, offset_start int, offset_end int, content string")
    return rows.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "*")


def chunk_results(docs: DataFrame, s: Sizes = Sizes()) -> DataFrame:
    """doc_id, chunks, tokens, success, error: what chunking each of ``docs`` gives. A blank text is an error."""
    rows = docs.select("doc_id", let(normalise_text(F.col("content")), lambda t: F.struct(F.length(t).alias("n"), tokens_estimate(t, 3).alias("tokens"))).alias("x"))
    blank = F.col("x.n") == 0
    return rows.select(
        "doc_id", F.when(blank, 0).otherwise(window_count(F.col("x.n"), s)).cast("int").alias("chunks"), "x.tokens", (~blank).alias("success"),
        F.when(blank, "Empty document text").alias("error"),
    )


def rechunk(docs: DataFrame, old: DataFrame, s: Sizes = Sizes(), least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcome): the chunk table with the chunks of ``docs`` in place of their old ones, and doc_id,
    removed, written, estimate for each document. Documents of fewer than ``least`` characters are skipped and
    keep their old chunks."""
    long = F.length(F.trim(F.coalesce("content", F.lit("")))) >= least
    todo = docs.where(long)
    new = fixed_chunks(todo, s)
    kept = old.join(todo.select("doc_id"), "doc_id", "left_anti").select(*new.columns)
    removed = old.groupBy("doc_id").agg(F.count(F.lit(1)).alias("removed"))
    estimate = F.greatest(F.lit(1), F.floor(F.length("content") / s.size)).cast("int")
    outcome = chunk_results(docs, s).join(removed, "doc_id", "left").join(docs.select("doc_id", long.alias("long"), estimate.alias("estimate")), "doc_id")
    zero = lambda c: F.when(F.col("long"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return kept.unionByName(new), outcome.select("doc_id", zero(F.col("removed")).alias("removed"), zero(F.col("chunks")).alias("written"), zero(F.col("estimate")).alias("estimate"))
