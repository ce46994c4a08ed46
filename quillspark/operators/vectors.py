"""Vectors: an embedding of tokens, exact nearest neighbours, and an inverted file of product-quantised codes."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.text import document_score, terms
from .tables import materialise, shared_dir, sized

#: Rows of a query table that are broadcast at once; larger tables are searched block by block.
MOST_QUERIES = 10_000
#: Ids of candidates that are broadcast at once to the table of vectors; more are joined by shuffle.
MOST_CANDIDATES = 1_000_000
DIMENSIONS = 256
#: Texts, and vectors, that a task works on at once, so that it holds little beside the Arrow batch that it was given.
SLICE = 1_000


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector of a text: each of its words adds one, with a sign, at a place, both by the word's MD5. A text
    without a word, blank and null ones too, is the zero vector."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            parts = [_unit_vectors(words.slice(k, SLICE), dimensions) for k in range(0, len(words), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))
        pa.default_memory_pool().release_unused()

    return vectors(terms(text))


def _unit_vectors(words: pa.ListArray, dimensions: int) -> pa.ListArray:
    """Vectors of a few texts' words, of which each distinct one becomes a Python object, and an MD5, once."""
    coded = words.flatten().dictionary_encode()
    digests = b"".join(hashlib.md5(w).digest() for w in coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))
    digests = np.frombuffer(digests, np.uint8).reshape(-1, 16)
    place = np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0].astype(np.int64) % dimensions
    sign = 1.0 - 2 * (digests[:, 4] // 16 % 2)
    word = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    v = np.bincount(row * dimensions + place[word], sign[word], len(words) * dimensions).astype(np.float64).reshape(len(words), dimensions)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    offsets = np.arange(0, v.size + 1, dimensions, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, v.astype(np.float32).ravel())


def query_blocks(queries: DataFrame, most: int | None = None, by: str = "query_id") -> list[DataFrame]:
    """``queries`` (query_id and more) in blocks of about ``most`` rows by the hash of ``by``."""
    n = max(1, -(-queries.count() // (most or MOST_QUERIES)))
    return [queries if n == 1 else queries.where(F.pmod(F.xxhash64(by), F.lit(n)) == k) for k in range(n)]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors without nulls, of equal length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Nearest:
    """The ``k`` nearest vectors so far of each query; ties by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.squares = (queries * queries).sum(1)
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)

    def add(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Meets ``rows`` with the queries ``which`` (all). Distances by products choose candidates, up to more
        than their error beyond the ``k``-th; theirs are then worked out by differences."""
        which = np.arange(len(self.queries)) if which is None else which
        squares = (rows * rows).sum(1)
        some = max(1, 2_000_000 // max(len(rows), 1))
        for at in range(0, len(which), some):
            part = which[at : at + some]
            far = squares[:, None] + self.squares[part] - 2 * rows @ self.queries[part].T
            slack = 1e-7 * (1 + np.abs(far).max(initial=0))
            cut = np.partition(far, self.k - 1, axis=0)[self.k - 1] if len(rows) > self.k else np.full(len(part), np.inf)
            for j, q in enumerate(part):
                best = self.found[q]
                limit = cut[j] if best is None or len(best[0]) < self.k else min(cut[j], best[0][-1])
                near = np.flatnonzero(far[:, j] <= limit + slack)
                if not len(near):
                    continue
                gap = rows[near] - self.queries[q]
                distance, names = np.round((gap * gap).sum(1), 9), ids[near]
                if best is not None:
                    distance, names = np.concatenate([best[0], distance]), np.concatenate([best[1], names])
                order = np.lexsort((names, distance))[: self.k]
                self.found[q] = distance[order], names[order]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return ((q, *x) for q, x in enumerate(self.found) if x is not None)


def _asked(block: DataFrame, vectors: DataFrame) -> tuple[list, np.ndarray, list, str]:
    """Ids and vectors of a block of queries, the Arrow types of query_id and id, and the schema of what is found."""
    got = block.select("query_id", "qvector").where("qvector is not null").toArrow().combine_chunks()
    kinds = [block.schema["query_id"].dataType, vectors.schema["id"].dataType]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, distance double"
    return got["query_id"].to_pylist(), matrix(got["qvector"].combine_chunks()), [to_arrow_type(t) for t in kinds], schema


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` in two tasks a core at most, each of which reads many splits one after another and hands on its best once:
    what is shuffled follows the cluster's size, not the table's."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _batches(best: Nearest, names: list, kinds: list) -> Iterator[pa.RecordBatch]:
    for q, distance, near in best.rows():
        columns = [pa.array([names[q]] * len(near), kinds[0]), pa.array(near.tolist(), kinds[1]), pa.array(distance)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "distance"])


def _search(block: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance: each task's ``k`` nearest of each query of a block."""
    names, queries, kinds, schema = _asked(block, vectors)
    shared = vectors.sparkSession.sparkContext.broadcast((names, queries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        best = Nearest(queries, k)
        for b in batches if len(names) else ():
            for part in (b.slice(k, SLICE) for k in range(0, b.num_rows, SLICE)):
                best.add(part.column("id").to_numpy(zero_copy_only=False), matrix(part.column("vector")))
        yield from _batches(best, names, kinds)

    rows = few_tasks(vectors.select("id", "vector").where("vector is not null"))
    return rows.mapInArrow(run, schema)


def _ranked(parts: list[DataFrame], k: int, score, least: float | None) -> DataFrame:
    top = W.partitionBy("query_id").orderBy("distance", "id")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).withColumn("score", score(F.col("distance")))
    return rows if least is None else rows.where(F.col("score") >= least)


def knn(queries: DataFrame, vectors: DataFrame, k: int, score=document_score, least: float | None = None) -> DataFrame:
    """query_id, id, distance, score, rank: the ``k`` nearest of ``vectors`` (id, vector) for each row of
    ``queries`` (query_id, qvector), by squared distance, ties by id. Filters belong on ``vectors``; the corpus is
    read once for each block of queries and not shuffled: each of a few tasks hands on the best ``k`` of a query. Null
    vectors are neither queries nor neighbours."""
    return _ranked([_search(block, vectors, k) for block in query_blocks(queries)], k, score, least)


def _nearest_rows(centres: np.ndarray, rows: np.ndarray, n: int = 1) -> np.ndarray:
    """Places of the ``n`` centres nearest to each row, nearest first."""
    far = (centres * centres).sum(1) - 2 * rows @ centres.T if len(rows) else np.zeros((0, len(centres)))
    return np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(1)[:, None]


def _means(rows: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """``n`` centres of ``rows`` by k-means, fewer if there are fewer rows."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:n]].copy()
    for _ in range(rounds):
        own = _nearest_rows(centres, rows)[:, 0]
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


@dataclass(frozen=True)
class IndexSettings:
    """``sample``: the index is fitted on at most so many vectors, those of the least hashes of their ids. ``most_cells``:
    there are as many cells as the square root of the number of rows, up to this. ``parts``: a code has a byte for each
    of so many equal parts of a vector. ``file_rows``: rows of a cell's file, so that a cell of any size has many files."""

    sample: int = 20_000
    most_cells: int = 4_096
    parts: int = 16
    rounds: int = 12
    file_rows: int = 1_000_000
    seed: int = 3


@dataclass
class Cells:
    """Centres of an inverted file."""

    centres: np.ndarray

    def nearest_cells(self, rows: np.ndarray, n: int) -> np.ndarray:
        return _nearest_rows(self.centres, rows, n)


def _sampled(vectors: DataFrame, sample: int, seed: int) -> np.ndarray:
    """At most ``sample`` of ``vectors`` (id, vector), those of the least hashes of their ids."""
    rows = vectors.where("vector is not null").orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(sample).select("vector")
    return matrix(rows.toArrow().combine_chunks()["vector"].combine_chunks())


def fit_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 3) -> Cells:
    """Centres by k-means on a bounded sample."""
    x = _sampled(vectors, sample, seed)
    return Cells(_means(x, cells, rounds, seed) if len(x) else np.zeros((1, 1)))


def assign_cells(vectors: DataFrame, index: Cells) -> DataFrame:
    """``vectors`` (id, vector, and more) with ``cell``, every row that has a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(shared.value.nearest_cells(np.stack(v.tolist()).astype(np.float64), 1)[:, 0].astype(np.int32))

    return vectors.where("vector is not null").withColumn("cell", cell("vector"))


@dataclass
class Quantiser(Cells):
    """Cells, and the code books of what is left of a vector when its cell's centre is taken away: ``books[p]`` holds the
    centres of part p."""

    books: np.ndarray

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell, and a byte for each part, of each row."""
        cell = _nearest_rows(self.centres, rows)[:, 0]
        rest = (rows - self.centres[cell]).reshape(len(rows), len(self.books), -1)
        parts = [_nearest_rows(b, rest[:, p])[:, 0] for p, b in enumerate(self.books)]
        return cell, np.stack(parts, 1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that a cell's codes stand for."""
        return self.centres[cell] + np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)


def fit_quantiser(vectors: DataFrame, s: IndexSettings = IndexSettings()) -> Quantiser:
    """Centres and code books by k-means on a bounded sample of ``vectors`` (id, vector); null vectors don't count."""
    n, x = vectors.where("vector is not null").count(), _sampled(vectors, s.sample, s.seed)
    x = x if len(x) else np.zeros((1, s.parts))
    parts = max(p for p in range(1, s.parts + 1) if x.shape[1] % p == 0)
    centres = _means(x, min(s.most_cells, max(1, math.isqrt(n))), s.rounds, s.seed)
    rest = (x - centres[_nearest_rows(centres, x)[:, 0]]).reshape(len(x), parts, -1)
    return Quantiser(centres, np.stack([_means(rest[:, p], 256, s.rounds, s.seed + p) for p in range(parts)]))


@dataclass
class ApproximateIndex:
    """``codes``: id, cell, code of every vector, written in a folder for each cell; ``vectors``: id, vector, as given."""

    cells: Quantiser
    codes: DataFrame
    vectors: DataFrame


def build_index(vectors: DataFrame, s: IndexSettings = IndexSettings()) -> ApproximateIndex:
    """The index of all ``vectors`` (id, vector; a table). Null vectors are in no cell. A cell may hold any share of the
    rows: its rows are written by as many tasks as they fill files."""
    spark, cells = vectors.sparkSession, fit_quantiser(vectors, s)
    shared = spark.sparkContext.broadcast(cells)
    kind = vectors.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, codes = shared.value.codes(matrix(b.column("vector")))
            columns = [b.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cell", "code"])

    rows = vectors.select("id", "vector").where("vector is not null").mapInArrow(run, f"id {kind.simpleString()}, cell int, code binary")
    rows = materialise(spark, rows, "vector-codes")
    sizes = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / s.file_rows).cast("int").alias("_files")))  # a row per cell
    dealt = rows.join(sizes, "cell").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    dealt.repartition("cell", "_file").select("id", "code", "cell").write.partitionBy("cell").parquet(path)
    schema = StructType([rows.schema[c] for c in ("id", "code", "cell")])
    return ApproximateIndex(cells, spark.read.schema(schema).parquet(path), vectors)


def _candidates(block: DataFrame, index: ApproximateIndex, k: int, probes: int) -> DataFrame:
    """query_id, id, distance (to what its code stands for): each task's ``k`` nearest codes of each query of a block, of
    the cells that it probes. The folders of other cells are not read."""
    names, queries, kinds, schema = _asked(block, index.vectors)
    if queries.shape[1] == index.cells.centres.shape[1]:
        probed = _nearest_rows(index.cells.centres, queries, max(2, probes))[:, :probes]
    else:  # no vector is indexed, or no query has one
        probed = np.zeros((len(queries), 1), np.int64)
    shared = index.vectors.sparkSession.sparkContext.broadcast((names, queries, probed, index.cells))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, probed, cells = shared.value
        best = Nearest(queries, k)
        for b in batches if len(names) else ():
            ids, own = b.column("id").to_numpy(zero_copy_only=False), b.column("cell").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
            for c in np.unique(own):
                here = own == c
                best.add(ids[here], cells.decode(c, codes[here]), np.flatnonzero((probed == c).any(1)))
        yield from _batches(best, names, kinds)

    some = [int(c) for c in np.unique(probed)]
    rows = index.codes.where(F.col("cell").isin(some) if len(some) < len(index.cells.centres) else F.lit(True))
    return few_tasks(rows.select("id", "code", "cell")).mapInArrow(run, schema)


def approximate_knn(
    queries: DataFrame, index: ApproximateIndex, k: int, probes: float = 0.65, candidates: int = 10, score=document_score
) -> DataFrame:
    """As ``knn``, among the codes of the nearest cells of each query, a share ``probes`` of all cells. The vectors
    themselves are read for the ``candidates`` times ``k`` nearest codes of a query alone; their distances are exact and
    decide. Neighbours in other cells, or behind too many codes, are missed."""
    spark, found = index.vectors.sparkSession, None
    n = max(1, math.ceil(probes * len(index.cells.centres)))
    for block in query_blocks(queries):
        near = _ranked([_candidates(block, index, candidates * k, n)], candidates * k, score, None).select("query_id", "id")
        near = materialise(spark, near, "near-codes")
        ids = materialise(spark, near.select("id").distinct(), "near-ids")
        rows = index.vectors.select("id", "vector").join(sized(ids, MOST_CANDIDATES), "id", "left_semi").join(near, "id")
        exact = _exact_distances(block, rows)
        found = exact if found is None else found.union(exact)
    return _ranked([found], k, score, None)


def _exact_distances(block: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, id, distance of ``rows`` (query_id, id, vector)."""
    names, queries, _, schema = _asked(block, rows)
    shared = rows.sparkSession.sparkContext.broadcast(({q: i for i, q in enumerate(names)}, queries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, queries = shared.value
        for b in batches:
            gap = matrix(b.column("vector")) - queries[[places[q] for q in b.column("query_id").to_pylist()]]
            distance = np.round((gap * gap).sum(1), 9) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(distance)], ["query_id", "id", "distance"])

    return rows.select("query_id", "id", "vector").mapInArrow(run, schema)
