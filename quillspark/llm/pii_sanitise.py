"""Personal data, and the terms around it that would still tell whose it is.

Patterns find protected entities: mail addresses, IP addresses, card and phone numbers. What else in a text reveals
an entity is estimated from the corpus: of the terms near its occurrences, those that are met with it far more often
than chance would have it. The pointwise mutual information of entity and term, over all documents, is held against
the information content of the entity itself; their quotient is 0 for an independent term and 1 for one that never
stands in a document without the entity. Terms above a threshold are generalised to a class of words wherever they
stand in a text with that entity, those above a second one are removed.

Only texts with entities have pairs of entity and term, at most ``2 * window`` for each occurrence. Counts are
summed in tasks before they are shuffled; no pair of documents or of terms is ever formed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sized, slices

#: Kinds of spans in the order in which spans of one start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
KINDS = BASE + ADDED

# Fixed values of the query's contract.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_APART = re.compile("[^0-9]")

_TERM = re.compile(r"[^\W_]{2,}")


@dataclass(frozen=True)
class Settings:
    """``window``: terms on either side of an entity that are held against it. ``support``: in fewer distinct texts a
    pair says nothing. ``generalise``, ``remove``: disclosures (mutual information over the entity's information
    content) from which a term is generalised and removed. ``known``: so many candidate terms are broadcast to the
    count of documents, more are joined to it; ``broadcast_rows``: the same of tables of pairs and of texts."""

    window: int = 8
    support: int = 2
    generalise: float = 0.7
    remove: float = 0.9
    known: int = 500_000
    broadcast_rows: int = 200_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is met once, with what stands before it since the last one, so that no run is read twice."""
    end = 0
    at = text.find("@")
    while at >= 0:
        before = text[end:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, entity) of a text's personal data in order; ``kind``: its place in ``KINDS``."""
    found = [(a, 0, b, f"email:{text[a:b].lower()}") for a, b in _emails(text)]
    found += [(m.start(), 1, m.end(), f"ip:{m[0]}") for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for kind, pattern, least, most in ((2, _CARD, 14, 19), (3, _PHONE, 10, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                digits = _APART.sub("", m[0])
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    found.append((m.start(), kind, m.end(), f"{KINDS[kind]}:{digits}"))
    return sorted(found)


def other_terms(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms that no span touches."""
    out, k, reach = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if m.start() >= reach:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def near_terms(spans: list[tuple[int, int, int, str]], terms: list[tuple[int, int, str]], window: int) -> set[tuple[str, str]]:
    """(entity, term) of the ``window`` terms before and behind each span."""
    starts = [t[0] for t in terms]
    found = set()
    for start, _, _, entity in spans:
        at = bisect_left(starts, start)
        found |= {(entity, t[2]) for t in terms[max(0, at - window) : at + window]}
    return found


_SEEN = {
    "doc_id": pa.int64(),
    "text_id": pa.binary(),
    "base": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])),
    "entities": pa.list_(pa.string()),
    "near": pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())])),
    "places": pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
}
_SCHEMA = """doc_id long, text_id binary, base array<struct<start:int,kind:int,end:int>>, entities array<string>,
near array<struct<entity:string,term:string>>, places array<struct<term:string,start:int,end:int>>"""


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def observe(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text_id, base (start, kind, end), entities, near (entity, term), places (term, start, end of the terms
    of ``near``, wherever they stand): a row per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc_id, key, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_id", "text"))):
                spans = base_spans(text or "")
                near, places = set(), []
                if spans:
                    terms = other_terms(text, spans)
                    near = near_terms(spans, terms, s.window)
                    own = {t for _, t in near}
                    places = [(t, start, end) for start, end, t in terms if t in own]
                rows.append((doc_id, key, [x[:3] for x in spans], sorted({x[3] for x in spans}), sorted(near), places))
            columns = zip(*rows) if rows else [[] for _ in _SEEN]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _SEEN.values())], list(_SEEN))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("text_id"), "text")
    return rows.mapInArrow(run, _SCHEMA)


def document_counts(docs: DataFrame, candidates: DataFrame, s: Settings) -> DataFrame:
    """term, n_t: how many documents each of ``candidates`` (term, a written table) stands in, all documents read whole."""
    spark = docs.sparkSession
    few = candidates.count() <= s.known
    known = spark.sparkContext.broadcast({r.term for r in candidates.toLocalIterator()} if few else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                found = set(map(str.lower, _TERM.findall(text or "")))
                counts.update(found if known.value is None else found & known.value)
                if len(counts) > 300_000:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    def batch(counts: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted if few else counted.join(candidates, "term")


def disclosure(n: Column, n_e: Column, n_t: Column, n_et: Column) -> Column:
    """Mutual information of an entity and a term over the entity's information content, from how many documents there
    are, and how many hold the entity, the term and both; 0 for an entity that all documents hold."""
    return F.when(n > n_e, F.ln(n_et * n / (n_e * n_t)) / F.ln(n / n_e)).otherwise(0.0)


def disclosures(spark: SparkSession, docs: DataFrame, seen: DataFrame, s: Settings) -> DataFrame:
    """entity, term, n_e, n_t, n_et, share, kind (place in ``KINDS``): the pairs whose terms give the entity away.

    ``seen``: the written result of ``observe``."""
    pairs = seen.select("text_id", F.explode("near").alias("x")).select("text_id", "x.entity", "x.term")
    # documents by text first, so that a text that many documents repeat is one row
    pairs = pairs.groupBy("entity", "term", "text_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts"))
    entities = seen.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n = seen.count()
    pairs = materialise(spark, pairs.where(F.col("texts") >= s.support).join(entities, "entity"), "pairs")
    # a term's documents are at least those in which it stands near some entity: most pairs need no more counting
    least = seen.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term"))
    least = least.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    may = pairs.join(least, "term").where(disclosure(F.lit(n), F.col("n_e"), F.col("n_t"), F.col("n_et")) >= s.generalise)
    candidates = materialise(spark, may.select("term").distinct(), "candidates")
    if candidates.isEmpty():
        return spark.createDataFrame([], "entity string, term string, n_e long, n_t long, n_et long, share double, kind int")
    found = pairs.join(document_counts(docs, candidates, s), "term")
    found = found.withColumn("share", disclosure(F.lit(n), F.col("n_e"), F.col("n_t"), F.col("n_et")))
    kind = F.when(F.col("share") >= s.remove, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    found = found.where(F.col("share") >= s.generalise).select("entity", "term", "n_e", "n_t", "n_et", "share", kind.alias("kind"))
    return materialise(spark, found, "disclosures")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of an array of (start, kind, end) in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(text, ",")


def scan(spark: SparkSession, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text_id, base, spans (arrays of start, kind, end, in order): a row per row of ``docs`` (doc_id, text).

    ``spans`` are those of ``base`` and those of the terms that give away an entity of the same text. A null text
    counts as empty and has none; repeated rows count as documents each and give equal rows, but ``support`` counts
    distinct texts; a null doc_id stays null. Texts are read whole, of any length; an empty table gives no row.
    Offsets are of code points, ends exclusive. Only doc_id and text are read."""
    seen = materialise(spark, observe(docs, s), "entities")
    told = sized(disclosures(spark, docs, seen, s), s.broadcast_rows)
    texts = seen.where(F.size("near") > 0).select("text_id", "near").dropDuplicates(["text_id"])
    own = texts.select("text_id", F.explode("near").alias("x")).select("text_id", "x.entity", "x.term").join(told, ["entity", "term"])
    # the strictest of what a text's entities ask for
    own = own.groupBy("text_id", "term").agg(F.max("kind").alias("kind")).groupBy("text_id")
    own = materialise(spark, own.agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told")), "told")
    rows = seen.join(sized(own, s.broadcast_rows), "text_id", "left")
    hit = F.filter("places", lambda x: F.map_contains_key("told", x["term"]))
    more = F.transform(hit, lambda x: F.struct(x["start"].alias("start"), F.element_at("told", x["term"]).alias("kind"), x["end"].alias("end")))
    spans = F.when(F.col("told").isNotNull(), F.sort_array(F.concat("base", more))).otherwise(F.col("base"))
    return rows.select("doc_id", "text_id", "base", spans.alias("spans"))


def word_class(term: str) -> str:
    """What a generalised term is replaced by."""
    if any(c.isdigit() for c in term):
        return "[number]"
    return "[name]" if term[:1].isupper() else "[word]"


def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with personal data replaced by its kind, and terms by their class or by nothing. Spans that overlap are
    one, of the first one's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            name = KINDS[kind]
            out += [text[at:start], "" if name == "remove" else word_class(text[start:end]) if name == "generalise" else f"[{name}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(spark: SparkSession, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``text`` sanitised, all other columns as they are: a row per row. A null text stays null."""
    found = scan(spark, docs, s).where(F.size("spans") > 0).select(F.col("text_id").alias("_pii_id"), F.col("spans").alias("_pii_spans"))
    found = sized(materialise(spark, found.dropDuplicates(["_pii_id"]), "spans"), s.broadcast_rows)
    rows = docs.join(found, text_id(F.col("text")) == F.col("_pii_id"), "left").select(*docs.columns, "_pii_spans")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[(x["start"], x["kind"], x["end"]) for x in found or ()] for found in b.column("_pii_spans").to_pylist()]
            texts = [t if t is None else clean(t, x) for t, x in zip(b.column("text").to_pylist(), spans)]
            columns = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)
