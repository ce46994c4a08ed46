"""Filters of searches, request bounds, and the rows that a search shows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, preview

MODES = {"hybrid": (0.6, 0.4), "semantic": (1.0, 0.0), "fulltext": (0.0, 1.0)}
SORTS = ("created_at", "file_size", "title")


@dataclass(frozen=True)
class Filter:
    """All that is given has to hold. ``path_contains`` and extensions hold in any case; dates are ISO texts."""

    category: str | None = None
    language: str | None = None
    file_types: tuple[str, ...] = ()
    path_contains: str | None = None
    date_after: str | None = None
    date_before: str | None = None

    def on(self, category="category", language="language", file_type="file_type", path="path", date="created_at") -> Column:
        """The condition on documents. A date that is missing or can't be read passes, in both legs of a search."""
        keep = F.lit(True)
        for name, value in ((category, self.category), (language, self.language)):
            if value is not None:
                keep &= F.col(name).eqNullSafe(F.lit(value))
        if self.file_types:
            keep &= F.coalesce(F.lower(F.col(file_type)).isin(*(x.lower() for x in self.file_types)), F.lit(False))
        if self.path_contains:
            keep &= F.contains(F.lower(F.coalesce(F.col(path), F.lit(""))), F.lit(self.path_contains.lower()))
        if self.date_after or self.date_before:
            at = F.try_to_timestamp(F.col(date).cast("string"))
            inside = F.lit(True)
            if self.date_after:
                inside &= at >= F.lit(self.date_after).cast("timestamp")
            if self.date_before:
                inside &= at <= F.lit(self.date_before).cast("timestamp")
            keep &= F.coalesce(inside, F.lit(True))
        return keep


@dataclass(frozen=True)
class Request:
    """One search as asked for; bounds are checked before anything is planned."""

    query: str
    limit: int = 10
    offset: int = 0
    mode: str = "hybrid"
    sort: str | None = None
    filters: Filter = field(default_factory=Filter)

    def __post_init__(self) -> None:
        faults = []
        if not 1 <= len(self.query) <= 1000:
            faults.append("query has to have 1 to 1000 characters")
        if not 1 <= self.limit <= 100:
            faults.append("limit has to be 1 to 100")
        if self.offset < 0:
            faults.append("offset has to be 0 or more")
        if self.mode not in MODES:
            faults.append(f"mode has to be one of {', '.join(MODES)}")
        if self.sort is not None and self.sort not in SORTS:
            faults.append(f"sort has to be one of {', '.join(SORTS)}")
        if faults:
            raise ValueError("; ".join(faults))


def request_faults(requests: DataFrame) -> DataFrame:
    """``requests`` (query, limit, offset, mode, sort) with ``faults``: what ``Request`` would say of each row, null if
    nothing. A null query counts as empty, another null as the default."""
    known = lambda c, values: F.col(c).isNull() | F.col(c).isin(*values)
    length = F.length(F.coalesce("query", F.lit("")))
    said = (
        (length.between(1, 1000), "query has to have 1 to 1000 characters"),
        (F.coalesce("limit", F.lit(10)).between(1, 100), "limit has to be 1 to 100"),
        (F.coalesce("offset", F.lit(0)) >= 0, "offset has to be 0 or more"),
        (known("mode", MODES), f"mode has to be one of {', '.join(MODES)}"),
        (known("sort", SORTS), f"sort has to be one of {', '.join(SORTS)}"),
    )
    return requests.withColumn("faults", F.nullif(F.concat_ws("; ", *(F.when(~ok, text) for ok, text in said)), F.lit("")))


def asked(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query) that say something: blank ones have an empty result."""
    return queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")


def result_rows(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, rank, id, path, title (else the file's name), content (its first 500 characters), modified_at
    (null if it can't be read) of ranked ids; ``docs``: id, path, title, content, created_at."""
    rows = ranked.select("query_id", "rank", "id").join(docs.select("id", "path", "title", "content", "created_at"), "id")
    return rows.select(
        "query_id", "rank", "id", "path", F.coalesce(F.nullif("title", F.lit("")), file_name(F.col("path"))).alias("title"),
        preview(F.coalesce("content", F.lit(""))).alias("content"), F.try_to_timestamp(F.col("created_at").cast("string")).alias("modified_at"),
    )
