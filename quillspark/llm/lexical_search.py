"""Ranked lexical search: branch and bound over tries of the documents' term vectors, ordered by frequency.

Each document's vector is restricted to the terms that some item asks for, and its terms are put in one order, the
most frequent first. Documents in lexical order of these vectors share their beginnings, which are the paths of a
trie (a frequent-pattern tree over documents). A task builds one trie for each few thousand of its documents. A
subtree keeps the largest tf of each of its terms and its least m; a document's score grows with tf and falls with
m, so they bound every score below. Each item walks the trie depth first, the best bound first, and leaves out the
subtrees whose bound is below the score of its k-th best document so far. Scores are exact 64-bit integers.

Everything that grows with the corpus (vectors, counts, tries) stays in tasks; the driver sees counts of the items'
terms and the items. Tasks hand on at most k documents an item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise

# Fixed values of the query's contract: the code points that end a term.
_ENDS = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))
#: Lower-cases A-Z, and makes each end of a term a space; bytes of other code points stay.
_PLAIN = bytes(0x20 if c in _ENDS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``items`` and ``item_bytes``: a block of items holds about so many rows, and so many bytes of text if no item
    alone has more; what is broadcast for a block (its terms and vectors) is bounded by them. ``trie``: documents of a
    trie, so that a task's memory doesn't grow with its input. ``bucket``: documents below which a subtree is no longer
    divided."""

    items: int = 4_000
    item_bytes: int = 16_000_000
    trie: int = 4_096
    bucket: int = 16
    k: int = 20


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: longest runs of ASCII letters, digits and all other code points from 128."""
    return text.translate(_PLAIN).split()


def _utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.string()).cast(pa.binary()).to_pylist()


def item_blocks(items: DataFrame, s: Settings) -> list[DataFrame]:
    """The distinct rows of ``items`` (item_id, text) that have a text, in blocks by the hash of both."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // s.items), -(-size // s.item_bytes))
    return [rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs (of the terms that ``vocabulary`` holds): a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            sizes, ids, tfs = [], [], []
            for text in _utf8(b, "text"):
                found = terms(text or b"")
                sizes.append(len(found))
                counts = {known[t]: c for t, c in Counter(found).items() if t in known}
                ids.append(list(counts))
                tfs.append(list(counts.values()))
            columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<bigint>")


def weight(n_docs: int, df: int) -> int:
    """A term's weight from how many documents there are and how many hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def part_scores(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in an item adds to a document's score, in whole numbers."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Trie:
    """Subtrees of a trie over documents, their bounds, and the documents' own scores by term.

    ``ids`` (terms of all documents, each document's in ascending order of rank) and ``tfs`` are cut by ``cuts``.
    Nodes stand in an order in which a node's children follow one another; node 0 is the root. ``first`` and ``last``
    are the children of an inner node, or the documents of a bucket."""

    def __init__(self, ids: np.ndarray, tfs: np.ndarray, cuts: np.ndarray, m: np.ndarray, weights: np.ndarray, bucket: int):
        n = len(cuts) - 1
        keys = [ids[cuts[i] : cuts[i + 1]].astype(">u4").tobytes() for i in range(n)]
        order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
        keys = [keys[i] for i in order]
        sizes = np.diff(cuts)[order]
        at = np.repeat(cuts[:-1][order] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
        self.order, self.cuts = order, np.concatenate(([0], np.cumsum(sizes)))
        self.ids, self.tfs, self.m, self.weights = ids[at], tfs[at], m[order], weights
        self.parts = part_scores(weights[self.ids], self.tfs, np.repeat(self.m, sizes))
        self.shared = np.array([0, *map(self._common, keys[:-1], keys[1:])], np.int64)  # terms shared with the one before
        self.first, self.last, self.inner = [], [], []
        self.node_cuts, node_ids, node_parts = [0], [], []
        waiting = [(0, n, 0)]
        self._add(0, n, node_ids, node_parts)
        k = 0
        while k < len(waiting):
            lo, hi, depth = waiting[k]
            children = self._children(lo, hi, depth, bucket) if hi - lo > bucket else []
            self.inner.append(bool(children))
            if children:
                self.first.append(len(waiting))
                for child in children:
                    waiting.append(child)
                    self._add(child[0], child[1], node_ids, node_parts)
                self.last.append(len(waiting))
            else:
                self.first.append(lo)
                self.last.append(hi)
            k += 1
        self.node_ids, self.node_parts = np.concatenate(node_ids), np.concatenate(node_parts)
        self.node_cuts = np.array(self.node_cuts)

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b)) // 4
        differ = np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n)
        return int(differ.argmax()) if differ.any() else n

    def _children(self, lo: int, hi: int, depth: int, bucket: int) -> list[tuple[int, int, int]]:
        """The subtrees of the documents ``lo`` to ``hi``, which share ``depth`` terms; neighbouring small ones are one."""
        inside = self.shared[lo + 1 : hi]
        depth = max(depth, int(inside.min()))
        starts = [lo, *(lo + 1 + np.flatnonzero(inside == depth)).tolist(), hi]
        out: list[tuple[int, int, int]] = []
        for a, b in zip(starts, starts[1:]):
            if out and b - out[-1][0] <= bucket:
                out[-1] = (out[-1][0], b, depth)
            else:
                out.append((a, b, depth + 1 if b - a > 1 else depth))
        return out if len(out) > 1 else []

    def _add(self, lo: int, hi: int, node_ids: list, node_parts: list) -> None:
        """The bounds of a subtree: for each of its terms, the score of the largest tf at the least m."""
        ids, tfs = self.ids[self.cuts[lo] : self.cuts[hi]], self.tfs[self.cuts[lo] : self.cuts[hi]]
        order = np.argsort(ids, kind="stable")
        own, at = np.unique(ids[order], return_index=True)
        most = np.maximum.reduceat(tfs[order], at) if len(own) else tfs[:0]
        node_ids.append(own)
        node_parts.append(part_scores(self.weights[own], most, np.full(len(own), self.m[lo:hi].min())))
        self.node_cuts.append(self.node_cuts[-1] + len(own))

    @staticmethod
    def _sums(asked: np.ndarray, ids: np.ndarray, parts: np.ndarray, cuts: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """For each row ``lo`` to ``hi`` the sum of its parts, each as often as the item asks for its term."""
        a, b = cuts[lo], cuts[hi]
        run = np.concatenate(([0], np.cumsum(asked[ids[a:b]] * parts[a:b])))
        return run[cuts[lo + 1 : hi + 1] - a] - run[cuts[lo:hi] - a]

    def search(self, asked: np.ndarray, best: Best) -> int:
        """Puts the documents of the best scores into ``best``; returns how many documents were scored. ``asked``: how
        often the item has each term."""
        scored = 0
        bound = int(self._sums(asked, self.node_ids, self.node_parts, self.node_cuts, 0, 1)[0])
        stack = [(bound, 0)]
        while stack:
            bound, node = stack.pop()
            if not bound or bound < best.least:
                continue
            lo, hi = self.first[node], self.last[node]
            if self.inner[node]:
                bounds = self._sums(asked, self.node_ids, self.node_parts, self.node_cuts, lo, hi)
                keep = np.flatnonzero(bounds >= max(best.least, 1))
                keep = keep[np.argsort(bounds[keep], kind="stable")]  # the best is on top of the stack
                stack += zip(bounds[keep].tolist(), (keep + lo).tolist())
            else:
                scores = self._sums(asked, self.ids, self.parts, self.cuts, lo, hi)
                scored += hi - lo
                for i in np.flatnonzero(scores >= max(best.least, 1)).tolist():
                    best.add(int(scores[i]), int(self.order[lo + i]))
        return scored


class Best:
    """The ``k`` best documents of an item: highest scores, then least doc_ids; a null doc_id is the last."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.heap: list[tuple[int, int, int]] = []
        self.names: list[int | None] = []

    def add(self, score: int, place: int) -> None:
        name = self.names[place]
        row = (score, 0, 0) if name is None else (score, 1, -name)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, row)
        elif row > self.heap[0]:
            heapq.heapreplace(self.heap, row)
        if len(self.heap) == self.k:
            self.least = self.heap[0][0]


@dataclass(frozen=True)
class Block:
    """What tasks need of a block of items: each one's terms (ranks) and how often it has them; each rank's weight; the
    rank of each term of the vocabulary; of the corpus, how many documents have terms and how many terms they have."""

    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    rank: np.ndarray
    n_docs: int
    n_terms: int


def _chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of ``rows``, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows)
            held, n = table.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(held)


def _best(rows: DataFrame, block: Block, s: Settings) -> DataFrame:
    """item (its number), doc_id, score: of each task's documents (doc_id, n, ids, tfs) the best of each item."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        asked, best = np.zeros(len(block.weights), np.int64), [Best(s.k) for _ in block.items]
        for table in _chunks(batches, s.trie):
            flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) for x in table["ids"]], np.int64)
            ids, tfs, n = block.rank[flat("ids")], flat("tfs"), table["n"].to_numpy().astype(np.int64)
            order = np.lexsort((ids, np.repeat(np.arange(len(sizes)), sizes)))
            m = 75 + (25 * n * block.n_docs) // block.n_terms
            trie = Trie(ids[order], tfs[order], np.concatenate(([0], np.cumsum(sizes))), m, block.weights, s.bucket)
            names = table["doc_id"].to_pylist()
            for (own, often), b in zip(block.items, best):
                b.names = names
                asked[own] = often
                trie.search(asked, b)
                asked[own] = 0
        found = [(i, -name if there else None, score) for i, b in enumerate(best) for score, there, name in b.heap]
        if found:
            columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def _search(spark: SparkSession, docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """As ``search``, for one block of items."""
    got = sorted(((r.item_id, r.text) for r in items.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    counts = [Counter(terms(text.encode("utf-8", "surrogatepass"))) for _, text in got]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    rows = materialise(spark, vectors(docs, vocabulary), "term-vectors")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r.id] = r.df
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weights = np.zeros(len(df), np.int64)
    weights[rank] = [weight(n_docs, int(x)) for x in df]
    own = [(rank[[vocabulary[t] for t in c]], np.array([*c.values()], np.int64)) for c in counts]
    found = _best(rows.where(F.size("ids") > 0), Block(own, weights, rank, n_docs, n_terms), s)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(got)], "item int, item_id long")
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item (item_id, text) the ``k`` documents (doc_id, text) of the
    highest scores above 0, equal ones by doc_id, a null one last.

    Null, empty and termless texts have no terms: such a document isn't counted and never found, such an item finds
    nothing. Texts are read whole, of any length. Repeated documents are documents of their own and are all counted;
    repeated items count once, different texts of one item_id are ranked one by one under it. An empty table on either
    side gives no row. Only the columns named are read.
    """
    parts = [_search(spark, docs, block, s) for block in item_blocks(items, s)]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found
