"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score of a text is ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the sum over pairs costs
linear time as ``(|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2``. The machine is fitted with Adam on a
bounded sample of labelled rows, balanced by class; scoring is one pass over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STRUCTURE = 16


@dataclass(frozen=True)
class Settings:
    """``sample``: at most so many labelled rows of each class are fitted; ``text_bytes``: rows of longer
    texts are passed over in choosing them (scoring reads every text whole)."""

    buckets: int = 4096
    rank: int = 8
    sample: int = 1500
    text_bytes: int = 40_000
    epochs: int = 12
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


class Features:
    """Sparse features of a text: hashed words (log counts, unit length), structure, metadata."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[bytes, int] = {}

    def bucket(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[word] = xxhash.xxh32_intdigest(word.lower()) % self.buckets
        return found

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode()
        words = raw.split()
        counts = Counter(map(self.bucket, words))
        ids = np.fromiter(counts.keys(), np.int32, len(counts))
        x = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        x /= max(float(np.sqrt((x * x).sum())), 1e-9)
        dense = self.structure(raw, words, n_chars)
        at = np.flatnonzero(dense).astype(np.int32)
        return np.concatenate([ids, at + self.buckets]), np.concatenate([x, dense[at]])

    @staticmethod
    def structure(raw: bytes, words: list[bytes], n_chars: int | None) -> np.ndarray:
        n, k = max(len(raw), 1), max(len(words), 1)
        lines = raw.split(b"\n")
        share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
        upper, lower, digit = share[65:91].sum(), share[97:123].sum(), share[48:58].sum()
        symbols = share[[35, 36, 37, 38, 42, 60, 62, 64, 94, 126]].sum()
        distinct = len(set(words))
        ends = share[[33, 46, 63]].sum()
        values = [
            1.0,
            upper * 2,
            digit * 4,
            min(symbols * 8, 2.0),
            min(share[124] * 20, 2.0),
            min(share[33] * 20, 2.0),
            min(ends * 20, 2.0),
            share[128:].sum(),
            distinct / k,
            min(n / k / 10, 2.0),
            (len(lines) - len(set(lines))) / len(lines),
            min(math.log1p(k) / 8, 2.0),
            min(math.log1p(len(lines)) / 6, 2.0),
            lower,
            min(math.log1p(n / len(lines)) / 8, 2.0),
            min(math.log1p(max(n_chars if n_chars is not None else len(raw), 0)) / 10, 2.0),
        ]
        return np.array(values, np.float32)


class Machine:
    def __init__(self, settings: Settings):
        n = settings.buckets + _STRUCTURE
        self.settings = settings
        self.bias = 0.0
        self.w = np.zeros(n, np.float32)
        self.v = np.random.default_rng(settings.seed).normal(0, 0.05, (n, settings.rank)).astype(np.float32)

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        z = self.v[ids] * x[:, None]
        sums = z.sum(0)
        return float(self.bias + self.w[ids] @ x + 0.5 * ((sums * sums).sum() - (z * z).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Machine:
        """Adam on the logistic loss, in small batches; classes weigh the same in total."""
        if not rows or len(set(labels)) < 2:
            self.bias = 0.0 if not rows else (4.0 if labels[0] else -4.0)
            return self
        s, y = self.settings, np.array(labels, np.float32)
        weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())).astype(np.float32)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.v)]
        step, dice = 0, np.random.default_rng(s.seed)
        for _ in range(s.epochs):
            order = dice.permutation(len(rows))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                gw, gv, gb = np.zeros_like(self.w), np.zeros_like(self.v), 0.0
                for i in some:
                    ids, x = rows[i]
                    v = self.v[ids]
                    sums = (v * x[:, None]).sum(0)
                    m = float(np.clip(self.margin(ids, x), -30, 30))
                    g = (1 / (1 + math.exp(-m)) - y[i]) * weight[i] / len(some)
                    gw[ids] += g * x
                    gv[ids] += g * (x[:, None] * sums - v * (x * x)[:, None])
                    gb += g
                step += 1
                self.bias -= s.rate * gb
                for p, grad, (m1, m2) in ((self.w, gw, state[0]), (self.v, gv, state[1])):
                    grad += s.decay * p
                    m1 += 0.1 * (grad - m1)
                    m2 += 0.001 * (grad * grad - m2)
                    p -= s.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.margin(ids, x), -30), 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, settings) -> DataFrame:
    """At most ``settings.sample`` rows of each class: doc_id, y, text, n_chars. Rows come by a hash of doc_id, so the
    same rows are chosen whatever the partitions are; of several texts of a doc_id the least counts, of several
    labels the greatest."""
    rows = labels.select("doc_id", F.col(label).alias("y")).where(learn & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    ids = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    usable = docs.where(F.octet_length("text").between(1, settings.text_bytes)).select("doc_id").distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit(settings.seed))
    parts = [
        ids.where(F.col("y") == y).join(usable, "doc_id", "left_semi").orderBy(order, "doc_id").limit(settings.sample)
        for y in (0, 1)
    ]
    chosen = F.broadcast(parts[0].union(parts[1]))  # two samples of bounded size
    keep = ["text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    rows = docs.select("doc_id", *keep).where(F.octet_length("text").between(1, settings.text_bytes)).join(chosen, "doc_id")
    return rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(*keep)).alias("_row")).select("doc_id", "y", "_row.*")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn, settings: Settings = Settings()) -> Machine:
    """``learn``: Column on doc_id that tells which labels may be used."""
    sample = labelled_sample(docs, labels, "quality", learn, settings)
    if "n_chars" not in sample.columns:
        sample = sample.withColumn("n_chars", F.lit(None).cast("long"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.buckets)
        for b in batches:
            found = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())],
                ["doc_id", "y", "ids", "x"],
            )

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text", "n_chars")
    rows = rows.mapInArrow(run, "doc_id long, y int, ids binary, x binary")
    got = sorted(rows.toLocalIterator(), key=lambda r: r.doc_id)
    pairs = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.x, np.float32)) for r in got]
    return Machine(settings).fit(pairs, [r.y for r in got])


def score_documents(spark: SparkSession, docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row: the chance of label 1.

    Null and empty texts are scored from their (empty) structure alone. A null n_chars is replaced by
    the text's own length. Only doc_id, text and n_chars are read, very long texts whole; repeated rows give
    repeated rows, a null doc_id stays null, an empty table gives no row.
    """
    shared = spark.sparkContext.broadcast((machine.settings, machine.bias, machine.w, machine.v))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings, bias, w, v = shared.value
        m, features = Machine(Settings(buckets=1)), Features(settings.buckets)
        m.bias, m.w, m.v = bias, w, v
        for b in batches:
            texts, chars = b.column("text").to_pylist(), b.column("n_chars").to_pylist()
            scores = [m.score(*features(t, n)) for t, n in zip(texts, chars)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chars.alias("n_chars")).mapInArrow(
        run, "doc_id long, score double"
    )
