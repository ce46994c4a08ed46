"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows. The space of the vectors is spanned by all of their terms
whose presence depends on the label (chi-square at a level of significance, however many they are); document
frequencies of these terms are counted over all documents. The examples stand in an inverted index whose postings are cut into blocks with the largest weight of each
term in each block. A block's bound is what its maxima could add up to; blocks are read from the highest
bound down until no bound reaches the k-th best cosine, so the neighbours are exact.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .fm_quality import labelled_sample

_TERM = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``sample``: at most so many labelled rows of each class become examples; ``text_bytes``: longer
    labelled rows are passed over in choosing them (scoring reads every text whole). ``significance``: a
    term spans the space from this chi-square on (10.83: one in a thousand by chance; 0: all terms of the
    examples do). ``power``: a neighbour's vote is its cosine to this power."""

    sample: int = 1000
    text_bytes: int = 20_000
    significance: float = 10.83
    neighbours: int = 15
    power: float = 2.0
    block: int = 64
    seed: int = 11


def terms(text: str | None) -> Counter:
    return Counter(_TERM.findall((text or "").lower()))


def significant_terms(present: list[tuple[set, int]], least: float) -> list[str]:
    """The terms whose presence depends on the label with a chi-square of ``least`` or more, in order."""
    by = (Counter(), Counter())
    size = [0, 0]
    for words, y in present:
        by[y].update(words)
        size[y] += 1
    n = sum(size)

    def value(t: str) -> float:
        a, b = by[1][t], by[0][t]
        c, d = size[1] - a, size[0] - b
        return n * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * size[0] * size[1])

    return sorted(t for t in by[0].keys() | by[1].keys() if value(t) >= least)


class Index:
    """Block-max inverted index of the examples, with calibrated votes."""

    def __init__(self, settings: Settings, vocabulary: list[str], df: np.ndarray, n_docs: int):
        self.settings = settings
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1.0
        self.slope, self.offset = 4.0, -2.0

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term ids (ascending) and weights of unit length."""
        ids = self.ids
        found = sorted((ids[t], c) for t, c in counts.items() if t in ids)
        at = np.array([i for i, _ in found], np.int64)
        w = (1 + np.log(np.array([c for _, c in found], np.float64))) * self.idf[at] if found else np.zeros(0)
        return at, w / max(float(np.sqrt((w * w).sum())), 1e-12)

    def build(self, examples: list[tuple[int, int, Counter]]) -> Index:
        """``examples``: (doc_id, label, counts). Examples with the same strongest terms share blocks."""
        vectors = [(d, y, *self.vector(c)) for d, y, c in examples]
        vectors = [v for v in vectors if len(v[2])]
        vectors.sort(key=lambda v: (v[1], int(v[2][np.argmax(v[3])]), v[0]))
        self.doc_ids = np.array([v[0] for v in vectors], np.int64)
        self.labels = np.array([v[1] for v in vectors], np.float64)
        size, n_terms = self.settings.block, len(self.ids)
        self.blocks = []
        self.maxima = np.zeros((n_terms, max(1, -(-len(vectors) // size))))
        for b in range(-(-len(vectors) // size)):
            part = vectors[b * size : (b + 1) * size]
            t = np.concatenate([v[2] for v in part])
            e = np.repeat(np.arange(len(part)), [len(v[2]) for v in part])
            w = np.concatenate([v[3] for v in part])
            order = np.argsort(t, kind="stable")
            self.blocks.append((np.searchsorted(t[order], np.arange(n_terms + 1)), e[order], w[order]))
            np.maximum.at(self.maxima[:, b], t, w)
        self.calibrate()
        return self

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of the largest positive cosine, ties by place; ``skip``: example left out."""
        if not len(at) or not self.blocks:
            return []
        bounds = w @ self.maxima[at]
        best: list[tuple[float, int]] = []
        size = self.settings.block
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) >= k and bounds[b] < best[-1][0] - 1e-12:
                break
            ptr, e, weights = self.blocks[b]
            lo, n = ptr[at], ptr[at + 1] - ptr[at]
            total = int(n.sum())
            if not total:
                continue
            posts = np.arange(total) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            scores = np.bincount(e[posts], weights[posts] * np.repeat(w, n), size)
            if len(best) >= k:
                hit = np.flatnonzero(scores >= best[-1][0] - 1e-12)
            else:
                hit = np.flatnonzero(scores > 0)
            if len(hit):
                new = [(float(scores[i]), int(b) * size + int(i)) for i in hit]
                best = sorted((x for x in best + new if x[1] != skip), key=lambda x: (-round(x[0], 12), x[1]))[:k]
        return best

    def votes(self, near: list[tuple[float, int]]) -> float:
        """The share of toxic neighbours, each with its cosine's power as weight."""
        weights = [s**self.settings.power for s, _ in near]
        total = sum(weights)
        return sum(w * self.labels[i] for w, (_, i) in zip(weights, near)) / total if total > 0 else 0.0

    def calibrate(self) -> None:
        """Logistic fit of the votes that each example gets from the others; the classes weigh the same."""
        y = self.labels
        if not len(y) or y.min() == y.max():
            return
        x = np.array([self.votes(self.nearest(*self._row(i), self.settings.neighbours, i)) for i in range(len(y))])
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        a = np.stack([x, np.ones_like(x)], 1)
        beta = np.array([4.0, -2.0])
        for _ in range(50):  # Newton's method with a little ridge
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            gradient = a.T @ (weight * (p - y)) + 1e-3 * (beta - [8.0, -4.0])
            hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            beta = beta - np.linalg.solve(hessian, gradient)
        self.slope, self.offset = float(beta[0]), float(beta[1])

    def _row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ptr, e, w = self.blocks[i // self.settings.block]
        mine = np.flatnonzero(e == i % self.settings.block)
        return np.searchsorted(ptr, mine, "right") - 1, w[mine]

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(*self.vector(terms(text)), self.settings.neighbours)
        z = self.slope * (self.votes(near) if near else 0.0) + self.offset
        return 1 / (1 + math.exp(-min(max(z, -30), 30))), near


def document_frequencies(spark: SparkSession, docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each term is, over all documents, and how many documents there are."""
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = shared.value, 0
        counts = np.zeros(len(ids) + 1, np.int64)
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                n += 1
                here = ids.keys() & set(_TERM.findall((text or "").lower()))
                counts[[ids[t] for t in here]] += 1
        counts[-1] = n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r.term: r.n for r in rows.toLocalIterator()}
    return np.array([got.get(i, 0) for i in range(len(vocabulary))], np.float64), got.get(len(vocabulary), 0)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Index:
    """``learn``: Column on doc_id that tells which labels may be used; ``docs``: the whole corpus."""
    sample = labelled_sample(docs, labels, "toxic", learn, settings)
    got = sorted(((r.doc_id, int(r.y), r.text) for r in sample.select("doc_id", "y", "text").toLocalIterator()))
    examples = [(d, y, terms(t)) for d, y, t in got]
    vocabulary = significant_terms([(set(c), y) for _, y, c in examples], settings.significance)
    df, n = document_frequencies(spark, docs, vocabulary)
    return Index(settings, vocabulary, df, n).build(examples)


def score_documents(spark: SparkSession, docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, evidence (JSON list of doc_id, cosine, label of the three nearest) for every row.

    A text without a term of the vocabulary, empty and null texts too, has no neighbour and gets the
    score of zero votes. Equal cosines rank by label, strongest term and doc_id of the example. Only
    doc_id and text are read, very long texts whole; repeated rows give repeated rows, a null doc_id stays
    null, an empty table gives no row. Votes don't depend on the norm of a document's vector.
    """
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches):
            found = [index.score(t) for t in b.column("text").to_pylist()]
            evidence = [
                json.dumps([[int(index.doc_ids[i]), round(s, 6), int(index.labels[i])] for s, i in near[:3]]) for _, near in found
            ]
            columns = [b.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, evidence string")


def without_toxic(spark: SparkSession, docs: DataFrame, index: Index, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all of their columns, whose text scores below ``least``. Each row is judged by
    its own text, whatever its doc_id; null and empty texts score as in ``score_documents``."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches):
            yield b.filter(pa.array([index.score(t)[0] < least for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
