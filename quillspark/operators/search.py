"""Keyword retrieval of a table of queries, rank fusion, and query expansion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import terms
from . import vectors
from .tables import materialise, sized
from .vectors import MOST_QUERIES, knn  # noqa: F401

#: Matched words are broadcast up to about so many rows; more are searched for part by part of the queries. Documents
#: whose places are asked for are broadcast up to such a number, else joined by shuffle.
MOST_WORDS = 2_000_000
#: Query terms whose deletions go to all tasks at once.
MOST_TERMS = 10_000
#: Words of a query that lie further apart than this, or do not meet in one attribute, count as this far.
FARTHEST = 8
#: Letters of a word's beginning whose deletions find it, and what a letter counts in a hash by its place.
BEGINNING = 8
FACTORS = np.random.default_rng(BEGINNING).integers(1, 1 << 63, BEGINNING, np.uint64) | np.uint64(1)
#: Pairs of a document and a term of a query that a task works on at once.
MOST_CELLS = 4_000_000
#: Documents of equal words and typos that a task holds before it hands them on.
MOST_TIES = 500_000
#: No match: more than any number of edits, and of attributes.
NONE = 255
#: What a document's place is decided by.
RANKING = ("words", "typos", "attribute", "exact")

def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """``queries`` (query_id and more) in blocks of about ``MOST_QUERIES`` rows by the hash of query_id."""
    return vectors.query_blocks(queries, MOST_QUERIES)


@dataclass
class Postings:
    """The words of ``docs`` (id and the ``attributes``, the most important first), written when first used."""

    docs: DataFrame
    attributes: tuple[str, ...]

    @cached_property
    def words(self) -> DataFrame:
        """id, w0, w1, ...: a row per document with its distinct words, each in the best of its attributes.

        The corpus is read and cut into words once, and nothing is shuffled: all words of a document lie in its row.
        Rows that share an id become one."""
        spark, before, parts = self.docs.sparkSession, F.array().cast("array<string>"), []
        for k, a in enumerate(self.attributes):
            own = terms(F.col(a))
            parts.append(F.array_except(own, before).alias(f"w{k}"))
            before = own if k == 0 else F.concat(before, own)
        rows = materialise(spark, self.docs.select("id", *parts), "words")
        again = materialise(spark, rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_id")), "repeated-ids")
        if again.isEmpty():
            return rows
        same = F.col("id").eqNullSafe(F.col("_id"))
        again = sized(again, MOST_WORDS)
        best = self._exploded(rows.join(again, same, "left_semi")).groupBy("id", "term").agg(F.min("attr").alias("attr"))
        own = lambda k: F.collect_list(F.when(F.col("attr") == k, F.col("term"))).alias(f"w{k}")
        merged = materialise(spark, best.groupBy("id").agg(*map(own, range(len(self.attributes)))), "merged-words")
        return rows.join(again, same, "left_anti").unionByName(merged)

    def _exploded(self, rows: DataFrame) -> DataFrame:
        with_attr = lambda k: F.transform(f"w{k}", lambda t: F.struct(t.alias("term"), F.lit(k).alias("attr")))
        found = F.concat(*map(with_attr, range(len(self.attributes))))
        return rows.select("id", F.explode(found).alias("x")).select("id", "x.term", "x.attr")

    @cached_property
    def entries(self) -> DataFrame:
        """term, id, attr (0 is the most important): a row per document and word of it."""
        return self._exploded(self.words)

    @cached_property
    def vocabulary(self) -> DataFrame:
        """term, documents: the distinct words and how many documents have them."""

        def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = pc.value_counts(pa.concat_arrays([x.flatten() for x in b.columns]))
                yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["term", "documents"])
            pa.default_memory_pool().release_unused()

        rows = self.words.drop("id").mapInArrow(counted, "term string, documents long")
        return materialise(self.docs.sparkSession, rows.groupBy("term").agg(F.sum("documents").alias("documents")), "vocabulary")

    def places(self, ids: DataFrame) -> DataFrame:
        """id, attr, pos, term of the documents ``ids`` (id, a written table) alone."""
        docs, rows = self.docs.join(sized(ids, MOST_WORDS), "id", "left_semi"), None
        for k, a in enumerate(self.attributes):
            part = docs.select("id", F.lit(k).alias("attr"), F.posexplode(terms(F.col(a))).alias("pos", "term"))
            rows = part if rows is None else rows.union(part)
        return rows


def postings(docs: DataFrame, attributes: tuple[str, ...] = ("title", "content", "path")) -> Postings:
    return Postings(docs, attributes)


def typo_budget(term: Column) -> Column:
    """Edits allowed: one from four letters, two from eight."""
    return F.when(F.length(term) >= 8, 2).when(F.length(term) >= 4, 1).otherwise(0)


def deletions(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """What the first ``BEGINNING`` letters of words become when up to two of them are left out, as 64-bit hashes: pairs of
    how many letters were left out, and a hash for each word. Equal letters have equal hashes.

    Two words within n edits have a deletion of up to n letters in common: what their alignment keeps of the shorter
    of two aligned beginnings is left of both."""
    n = BEGINNING
    letters = words.astype(f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
    # of each beginning, the sum of letters that stand ``gone`` places before their own
    sums = np.zeros((3, n + 1, len(words)), np.uint64)
    for gone in range(3):
        for i in range(n):
            sums[gone, i + 1] = sums[gone, i] + (letters[:, i] * FACTORS[i - gone] if i >= gone else np.uint64(0))
    none, one, two = sums
    out = [(0, none[n])] + [(1, none[i] + one[n] - one[i + 1]) for i in range(n)]
    return out + [(2, none[i] + one[j] - one[i + 1] + two[n] - two[j + 1]) for i in range(n) for j in range(i + 1, n)]


class NearTerms:
    """Query terms by the hashes of their deletions."""

    def __init__(self, asked: pa.Table):
        self.terms, self.budget = asked["qterm"].combine_chunks(), asked["budget"].to_numpy().astype(np.int64)
        self.length = pc.utf8_length(self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [(h[self.budget >= gone], np.flatnonzero(self.budget >= gone)) for gone, h in deletions(self.terms.to_numpy(zero_copy_only=False))]
        keys, term = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.size = np.unique(keys[order], return_index=True, return_counts=True)
        self.term = term[order]

    @cached_property
    def marks(self) -> np.ndarray:
        """Whether a key begins with these 24 bits: most of what is looked for is not there."""
        marks = np.zeros(1 << 24, bool)
        marks[self.keys >> np.uint64(40)] = True
        return marks

    def near(self, words: pa.Array) -> pa.RecordBatch:
        """qterm, budget, term of ``words``."""
        pairs = [np.zeros(0, np.int64)]
        for _, h in deletions(words.to_numpy(zero_copy_only=False)):
            row = np.flatnonzero(self.marks[h >> np.uint64(40)])
            key = np.searchsorted(self.keys, h[row])
            there = key < len(self.keys)
            row, key = row[there], key[there]
            same = self.keys[key] == h[row]
            row, key = row[same], key[same]
            size = self.size[key]
            at = np.repeat(self.start[key] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            pairs.append(np.repeat(row, size) * len(self.terms) + self.term[at])
        row, term = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.terms)))
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        some = np.abs(length[row] - self.length[term]) <= self.budget[term]
        row, term = row[some], term[some]
        columns = [self.terms.take(pa.array(term)), pa.array(self.budget[term].astype(np.int32)), words.take(pa.array(row))]
        return pa.RecordBatch.from_arrays(columns, ["qterm", "budget", "term"])


def candidate_words(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """qterm, budget, term: pairs of a query term (qterm, budget, a written table) and a word that share a deletion and
    whose lengths allow the edits; a superset of the pairs within the budget. The terms' deletions go to all tasks,
    ``MOST_TERMS`` terms at a time, and the words of the vocabulary look for theirs among them where they lie."""
    found = None
    for part in vectors.query_blocks(asked, MOST_TERMS, "qterm"):
        near = NearTerms(part.select("qterm", "budget").toArrow())
        shared = asked.sparkSession.sparkContext.broadcast(near)
        rows = vocabulary.select("term").mapInArrow(lambda batches, shared=shared: (shared.value.near(b.column(0)) for b in batches), "qterm string, budget int, term string")
        found = rows if found is None else found.union(rows)
    return found


def matched_terms(query_terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, qpos, term, edits: words of the vocabulary (a written table) within a query term's budget.

    Terms without a budget meet equal words. The others meet words by common deletions, equal keys of a few dozen a
    word, and the edit distance is worked out for what met."""
    asked = query_terms.select("qterm").distinct().withColumn("budget", typo_budget(F.col("qterm")))
    asked = materialise(vocabulary.sparkSession, asked, "query-terms")
    exact = vocabulary.join(sized(asked.where("budget = 0"), MOST_WORDS), F.col("term") == F.col("qterm")).select("qterm", "term", F.lit(0).alias("edits"))
    found = candidate_words(asked.where("budget > 0"), vocabulary).withColumn("edits", F.levenshtein("term", "qterm", 2))
    found = exact.union(found.where("edits between 0 and budget").select("qterm", "term", "edits"))
    return query_terms.join(found, "qterm").select("query_id", "qpos", "term", "edits")


def keyword_search(
    queries: DataFrame, posted: Postings, k: int, proximity: bool = False, sort: DataFrame | None = None, descending: bool = False
) -> DataFrame:
    """query_id, id, words, typos, attribute, exact, rank (and ``proximity``).

    ``queries``: query_id, query. Ranking, in order: more query terms matched, fewer edits, with ``proximity``
    the nearness of neighbouring query terms, better attribute, the key of ``sort`` (id, key; nulls last), more
    exact terms, id. The query terms of a block meet the vocabulary first, and the few words found meet the
    written postings.
    """
    every = queries.select("query_id", F.posexplode(F.array_distinct(terms(F.col("query")))).alias("qpos", "qterm"))
    spark = queries.sparkSession

    def search(q: DataFrame, words: DataFrame) -> DataFrame:
        found = best_documents(words, posted, k, ties=proximity or sort is not None)
        query = W.partitionBy("query_id")
        order = [F.desc("words"), F.asc("typos")]
        if proximity or sort is not None:
            # what comes later in the order matters only for rows that reach the first k places by these two
            found = found.withColumn("_r", F.rank().over(query.orderBy(*order))).where(F.col("_r") <= k).drop("_r")
            found = materialise(spark, found, "found")
        if proximity:
            found = found.join(nearness(found, posted, words, q), ["query_id", "id"])
            order.append(F.asc("proximity"))
        order.append(F.asc("attribute"))
        if sort is not None:
            found = found.join(sort.select("id", F.col("key").alias("_key")), "id", "left")
            order.append(F.col("_key").desc_nulls_last() if descending else F.col("_key").asc_nulls_last())
        rank = F.row_number().over(query.orderBy(*order, F.desc("exact"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("_key")

    found = None
    for block in query_blocks(every):
        words = materialise(spark, matched_terms(block, posted.vocabulary), "matched-words")
        for part in vectors.query_blocks(words, MOST_WORDS):
            rows = search(block, part)
            found = rows if found is None else found.union(rows)
    return found


class Matches:
    """The matched words of a few queries, sorted so that a word's (query, term of it, edits) stand together."""

    def __init__(self, words: pa.Table):
        coded = words["term"].combine_chunks().dictionary_encode()
        self.known, self.kind = coded.dictionary, words.schema.field("query_id").type
        queries = words["query_id"].combine_chunks().dictionary_encode()
        self.queries = queries.dictionary
        word, query = (x.indices.to_numpy(zero_copy_only=False) for x in (coded, queries))
        qpos = words["qpos"].to_numpy().astype(np.int64)
        most = qpos.max(initial=0) + 1
        pairs, pair = np.unique(query * most + qpos, return_inverse=True)
        order = np.argsort(word, kind="stable")
        self.query_of, self.pair, self.edits = pairs // most, pair[order], words["edits"].to_numpy()[order].astype(np.uint8)
        self.size = np.bincount(word, minlength=len(self.known))
        self.start = np.cumsum(self.size) - self.size

    def of(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document (its place), pair and edits of every match of the documents' words."""
        doc = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
        found = pc.index_in(words.flatten(), self.known)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        word, doc = found.drop_null().to_numpy(zero_copy_only=False), doc[hit]
        size = self.size[word]
        at = np.repeat(self.start[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(doc, size), self.pair[at], self.edits[at]

    def meet(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """document, query, words, typos, attribute, exact of every document of a batch that a query meets."""
        n, pairs, asked = batch.num_rows, len(self.query_of), len(self.queries)
        edits, attribute = np.full(n * pairs, NONE, np.uint8), np.full(n * asked, NONE, np.uint8)
        for k in reversed(range(batch.num_columns - 1)):
            doc, pair, e = self.of(batch.column(k + 1))
            for x in (2, 1, 0):  # what is written last stays
                some = e == x
                at = doc[some] * pairs + pair[some]
                edits[at] = np.minimum(edits[at], x)
            attribute[doc * asked + self.query_of[pair]] = k
        cell = np.flatnonzero(edits != NONE)
        at, e = cell // pairs * asked + self.query_of[cell % pairs], edits[cell]
        words, typos, exact = (np.bincount(at, w, n * asked).astype(np.int64) for w in (None, e, e == 0))
        met = np.flatnonzero(words)
        return met // asked, met % asked, words[met], typos[met], attribute[met], exact[met]


class BestDocuments:
    """Of the documents that a task has met, the first ``k`` of each query by ``RANKING``; with ``ties`` all those that as
    many words and as few edits as the ``k``-th have."""

    def __init__(self, matches: Matches, k: int, ties: bool):
        self.matches, self.k, self.ties = matches, k, ties
        self.floor = np.zeros(len(matches.queries), np.int64)  # no document below can be among the first k
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.ids: list[pa.Array] = []
        self.held, self.kept = 0, 0

    def key(self, words: np.ndarray, typos: np.ndarray) -> np.ndarray:
        """Greater for more words, then for fewer edits."""
        return words * (2 * len(self.matches.query_of) + 1) - typos

    def add(self, batch: pa.RecordBatch) -> None:
        doc, query, *rest = self.matches.meet(batch)
        some = self.key(rest[0], rest[1]) >= self.floor[query]
        if some.any():
            self.rows.append((query[some], *(x[some] for x in rest)))
            self.ids.append(batch.column(0).take(pa.array(doc[some])))
            self.held += int(some.sum())
            if self.held > 2 * self.kept + 100_000:
                self.trim()

    def trim(self) -> None:
        if not self.rows:
            return
        query, words, typos, attribute, exact = (np.concatenate(x) for x in zip(*self.rows))
        ids, key = pa.concat_arrays(self.ids), self.key(words, typos)
        by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
        order = np.lexsort((by_id, -exact, attribute, -key, query))
        sizes = np.bincount(query, minlength=len(self.floor))
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(order)) - first[query[order]]
        full = np.flatnonzero(sizes >= self.k)
        self.floor[full] = np.maximum(self.floor[full], key[order[first[full] + self.k - 1]])
        stays = order[key[order] >= self.floor[query[order]]] if self.ties else order[place < self.k]
        self.rows = [tuple(x[stays] for x in (query, words, typos, attribute, exact))]
        self.ids = [ids.take(pa.array(stays))]
        self.held = self.kept = len(stays)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Hands on what is held; what is not as good stays out from then on."""
        self.trim()
        for (query, words, typos, attribute, exact), ids in zip(self.rows, self.ids):
            columns = [self.matches.queries.take(pa.array(query)), ids, pa.array(words), pa.array(typos), pa.array(attribute.astype(np.int32)), pa.array(exact)]
            rows = pa.RecordBatch.from_arrays(columns, ["query_id", "id", *RANKING])
            yield from (rows.slice(x, 10_000) for x in range(0, rows.num_rows, 10_000))
        self.rows, self.ids, self.held, self.kept = [], [], 0, 0


def best_documents(words: DataFrame, posted: Postings, k: int, ties: bool) -> DataFrame:
    """query_id, id, words, typos, attribute, exact: each task's first ``k`` documents of each query of ``words`` (matched
    terms, ``MOST_WORDS`` or so), with ``ties`` all that are as good by words and typos. A document's hits are summed up
    where its words lie, so that what is shuffled follows the queries and the cluster, not the table."""
    spark, rows = posted.docs.sparkSession, posted.words
    matches = Matches(words.select("query_id", "qpos", "term", "edits").toArrow())
    shared = spark.sparkContext.broadcast(matches)
    schema = f"query_id {words.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, words long, typos long, attribute int, exact long"

    some, most = max(1, min(1_000, MOST_CELLS // max(1, len(matches.query_of)))), MOST_TIES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = shared.value
        best = BestDocuments(matches, k, ties)
        for b in batches if len(matches.known) else ():
            for at in range(0, b.num_rows, some):
                best.add(b.slice(at, some))
                if ties and best.held > most:  # any number may be as good
                    yield from best.batches()
        yield from best.batches()
        pa.default_memory_pool().release_unused()

    return vectors.few_tasks(rows).mapInArrow(run, schema)


def nearness(found: DataFrame, posted: Postings, words: DataFrame, query_terms: DataFrame) -> DataFrame:
    """query_id, id, proximity: the sum, over neighbouring terms of the query, of the least distance at which both
    stand in one attribute of the document. Of all occurrences of two terms in order, nearest ones are neighbours.
    Only the documents of ``found`` are read for their words' places."""
    keys = ["query_id", "id"]
    ids = materialise(found.sparkSession, found.select("id").distinct(), "found-ids")
    hits = posted.places(ids).join(sized(words, MOST_WORDS), "term").join(found.select(*keys), keys, "left_semi")
    hits = hits.select(*keys, "attr", "pos", "qpos", F.explode(F.array(F.col("qpos") - 1, F.col("qpos"))).alias("pair"))
    line = W.partitionBy(*keys, "attr", "pair").orderBy("pos", "qpos")
    gap = F.when(F.lag("qpos").over(line) != F.col("qpos"), F.greatest(F.lit(1), F.col("pos") - F.lag("pos").over(line)))
    least = hits.withColumn("gap", gap).groupBy(*keys, "pair").agg(F.min("gap").alias("gap"))
    saved = least.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), FARTHEST - F.coalesce("gap", F.lit(FARTHEST)))).alias("saved"))
    size = query_terms.groupBy("query_id").agg((F.max("qpos") * FARTHEST).alias("most"))
    rows = found.select(*keys).join(size, "query_id").join(saved, keys, "left")
    return rows.select(*keys, (F.col("most") - F.coalesce("saved", F.lit(0))).alias("proximity"))


def or_all(queries: DataFrame, ranked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank: ``ranked``, and for each blank query the first ``k`` documents by id."""
    blank = queries.where(F.trim(F.coalesce("query", F.lit(""))) == "").select("query_id")
    first = docs.select("id").orderBy("id").limit(k)
    first = first.withColumn("rank", F.row_number().over(W.orderBy("id")))  # k rows
    return ranked.select("query_id", "id", "rank").union(blank.crossJoin(F.broadcast(first)))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return 1 / (k + rank)


def fuse_ranks(semantic: DataFrame, fulltext: DataFrame, weights: tuple[float, float] = (0.6, 0.4), both_bonus: float = 1.3) -> DataFrame:
    """query_id, id, score (1 for the best of a query), rrf, in_both, fulltext_score, rank.

    Inputs: query_id, id, rank. The displayed full-text score is 1 - rank / n, so the last hit shows 0.
    """
    n = W.partitionBy("query_id")
    f = fulltext.select("query_id", "id", F.col("rank").alias("f"), (1 - F.col("rank") / F.count("id").over(n)).alias("fulltext_score"))
    rows = semantic.select("query_id", "id", F.col("rank").alias("s")).join(f, ["query_id", "id"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = F.col("s").isNotNull() & F.col("f").isNotNull()
    rrf = zero(reciprocal_rank(F.col("s"))) * weights[0] + zero(reciprocal_rank(F.col("f"))) * weights[1]
    rows = rows.withColumns({"in_both": both, "rrf": F.when(both, rrf * both_bonus).otherwise(rrf), "fulltext_score": zero(F.col("fulltext_score"))})
    rows = rows.withColumn("score", F.round(F.col("rrf") / F.max("rrf").over(n), 4))
    order = n.orderBy(F.desc(F.round("rrf", 12)), "id")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", F.round("rrf", 6).alias("rrf"), "in_both", F.round("fulltext_score", 4).alias("fulltext_score"), "rank")


def fuse_scores(semantic: DataFrame, fulltext: DataFrame, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """query_id, id, score: the weighted sum of normalised scores, a tenth more where both legs agree, 1 at most."""
    rows = semantic.select("query_id", "id", F.col("score").alias("s")).join(fulltext.select("query_id", "id", F.col("score").alias("f")), ["query_id", "id"], "full_outer")
    s, f = F.coalesce("s", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
    total = s * weights[0] + f * weights[1]
    return rows.select("query_id", "id", F.round(F.least(F.lit(1.0), F.when((s > 0) & (f > 0), total * 1.1).otherwise(total)), 4).alias("score"))


def page(ranked: DataFrame, offset: int, limit: int, most: int | None = None) -> DataFrame:
    """Places ``offset`` + 1 to ``offset`` + ``limit``, none beyond ``most``."""
    last = offset + limit if most is None else min(offset + limit, most)
    return ranked.where(F.col("rank").between(offset + 1, last))


def append_new(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first list of each query, then the rows of the second that are new, in their order (query_id, id, rank)."""
    sizes = first.groupBy("query_id").agg(F.max("rank").alias("size"))
    new = second.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).join(sizes, "query_id", "left")
    return first.select("query_id", "id", "rank").union(new.select("query_id", "id", (F.coalesce("size", F.lit(0)) + F.col("n")).cast("int").alias("rank")))


def normalise_query(query: Column) -> Column:
    query = F.regexp_replace(F.lower(query), r"(?U)[^\w\s-]", " ")
    return F.trim(F.regexp_replace(query, r"(?U)\s+", " "))


def expand_queries(queries: DataFrame, synonyms: DataFrame, stop_words: tuple[str, ...], most: int = 3) -> DataFrame:
    """query_id, terms (joined by spaces), expanded (whether a synonym was added).

    ``synonyms``: term, pos, synonym. Each content term is followed by its first ``most`` synonyms; of repeated
    terms the first stays. A query without a content term keeps its normalised text.
    """
    rows = queries.select("query_id", normalise_query(F.col("query")).alias("q"))
    words = rows.select("query_id", F.posexplode(F.filter(F.split("q", " "), lambda x: ~x.isin(*stop_words) & (x != ""))).alias("i", "term"))
    more = words.join(synonyms.where(F.col("pos") <= most), "term").select("query_id", "i", "pos", F.col("synonym").alias("term"))
    every = words.select("query_id", "i", F.lit(0).alias("pos"), "term").union(more)
    every = every.groupBy("query_id", "term").agg(F.min(F.struct("i", "pos")).alias("at"), F.max("pos").alias("pos"))
    joined = every.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("x"), (F.max("pos") > 0).alias("expanded"))
    joined = joined.select("query_id", F.array_join(F.transform("x", lambda y: y["term"]), " ").alias("terms"), "expanded")
    return rows.join(joined, "query_id", "left").select("query_id", F.coalesce("terms", "q").alias("terms"), F.coalesce("expanded", F.lit(False)).alias("expanded"))


def should_expand(query: Column, always: tuple[str, ...], most: int = 4) -> Column:
    """Whether a query is short (at most ``most`` words) or has a word that is always expanded."""
    words = F.filter(F.split(normalise_query(query), " "), lambda x: x != "")
    return (F.size(words) <= most) | F.arrays_overlap(words, F.array(*map(F.lit, always)))


def query_variants(queries: DataFrame, synonyms: DataFrame, stop_words: tuple[str, ...], always: tuple[str, ...]) -> DataFrame:
    """query_id, variant (0: the query as it is), text: each query, and its expansion where it should be expanded
    and differs."""
    rows = queries.select("query_id", "query", should_expand(F.col("query"), always).alias("yes"))
    more = rows.where("yes").join(expand_queries(queries, synonyms, stop_words), "query_id").where(F.col("expanded") & (F.col("terms") != F.col("query")))
    first = rows.select("query_id", F.lit(0).alias("variant"), F.col("query").alias("text"))
    return first.union(more.select("query_id", F.lit(1), "terms"))


def by_mode(mode: str, semantic, fulltext, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """``fuse_ranks`` of the legs (functions without arguments) that the mode needs; the other is not planned."""
    w = weights[mode]
    legs = [leg() if x > 0 else None for leg, x in zip((semantic, fulltext), w)]
    some = next(x for x in legs if x is not None).select("query_id", "id", "rank")
    return fuse_ranks(*(some.limit(0) if x is None else x for x in legs), weights=w)
