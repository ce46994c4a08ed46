"""Benchmark decontamination by SimHash of item-sized windows.

Every document is read through windows of the items' sizes (classes of sizes ten per cent apart, a window
every thirty-second of its size). A window's 128-bit SimHash sums the bits of its words' hashes; prefix sums
make each window one subtraction. Two fingerprints that differ in at most 8 * (near_bits + 1) - 1 bits agree
within near_bits bits in at least one of eight 16-bit blocks; a table for each block marks the block values
that close to an item's, so no fingerprint within the radius is missed. Around candidates every window of the
item's own size is compared with it by weighted Jaccard on five-word shingles, with counts as weights.

A window that is similar enough shares six shingles of seven with the item, so at least 0.85 of its words
are words of the item; fingerprinted windows, which may lie and end a little beside it, keep 0.77. Windows
with less than ``known_share`` of words of any item of the size class are passed over, which loses nothing.

The radius of 31 bits leaves room for short windows, whose fingerprints move most: of twelve words, two that
differ change some twenty bits. README gives the recall measured on edited passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .shingles import WIDTH, Words, mix, shingles

_KNOWN_BITS = 18
_PUNCTUATION = b".,;:!?\"'()[]{}"


@dataclass(frozen=True)
class Settings:
    """``index_words``: items are searched in blocks of at most so many words, each a broadcast index.
    ``chunk``: texts are fingerprinted together, about so many words at a time; longer ones in parts."""

    similarity: float = 0.75
    near_bits: int = 3
    size_step: float = 1.1
    stride: int = 32
    known_share: float = 0.75
    chunk: int = 65_536
    index_words: int = 1_000_000


def _bits(words: np.ndarray) -> np.ndarray:
    """128 bits of each word, as bytes 0 or 1."""
    pair = np.stack([mix(words), mix(words ^ np.uint64(0xA0761D6478BD642F))], 1)
    return np.unpackbits(pair.view(np.uint8).reshape(-1)).reshape(-1, 128)


def _prefix_sums(bits: np.ndarray, kind: type) -> np.ndarray:
    """Row i: the sum of the first i rows. It may wrap round, as only differences are used. Doubling steps
    keep whole rows together, which is faster here than a running sum down the columns."""
    sums = np.zeros((len(bits) + 1, bits.shape[1]), kind)
    sums[1:] = bits
    k = 1
    while k < len(sums):
        sums[k:] = sums[k:] + sums[:-k]
        k *= 2
    return sums


def _slots(words: np.ndarray) -> np.ndarray:
    """Places of words in a bitmap; words that share one only let more windows through."""
    return (words >> np.uint64(64 - _KNOWN_BITS)).astype(np.int64)


class Index:
    """Fingerprints and shingles of benchmark items, grouped by size class."""

    def __init__(self, items: list[tuple[int, str]], s: Settings):
        self.s = s
        words = Words(_PUNCTUATION)
        self.items: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        groups: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for item_id, text in items:
            w = words((text or "").encode())
            if len(w):
                size = max(1, round(s.size_step ** round(np.log(len(w)) / np.log(s.size_step))))
                fingerprint = np.packbits(2 * _bits(w).sum(0, dtype=np.int64) > len(w)).view(np.uint16)
                groups.setdefault(size, []).append((len(self.items), fingerprint, w))
                self.items.append((item_id, len(w), *np.unique(shingles(w), return_counts=True)))
        near = [sum(1 << i for i in some) for k in range(s.near_bits + 1) for some in combinations(range(16), k)]
        flips = np.array(near, np.uint16)
        self.groups = []
        for size, members in sorted(groups.items()):
            prints = np.stack([f for _, f, _ in members])
            tables = np.zeros((8, 65536), bool)
            for b in range(8):
                tables[b, (prints[:, b, None] ^ flips[None, :]).ravel()] = True
            known = np.zeros(1 << _KNOWN_BITS, bool)
            known[_slots(np.concatenate([w for _, _, w in members]))] = True
            self.groups.append((size, [m for m, _, _ in members], prints, tables, known))

    def find(self, words: np.ndarray) -> list[tuple[int, float, int]]:
        """(item_id, similarity, first word) of the best window for each item that the text holds."""
        return self.find_all([words])[0]

    def find_all(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, int]]]:
        """As ``find``, for each of ``texts``."""
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if self.groups:
            held, size, largest = [], 0, self.groups[-1][0]
            for k, words in enumerate(texts):
                for start in range(0, max(1, len(words) - largest + 1), self.s.chunk):
                    part = words[start : start + self.s.chunk + largest]
                    if len(part):
                        held.append((k, start, part))
                        size += len(part)
                    if size >= self.s.chunk:
                        self._candidates(held, near)
                        held, size = [], 0
            if held:
                self._candidates(held, near)
        found: list[list[tuple[int, float, int]]] = [[] for _ in texts]
        for (k, m), spans in sorted(near.items()):
            best = self._verify(texts[k], spans, m)
            if best:
                found[k].append((self.items[m][0], *best))
        return found

    def _candidates(self, parts: list[tuple[int, int, np.ndarray]], near: dict) -> None:
        """Adds to ``near``, by text and item, spans of words in which windows of the item may begin. ``parts``:
        (text, first word, words); windows don't reach from one into the next."""
        words = np.concatenate([p for _, _, p in parts])
        lengths = np.array([len(p) for _, _, p in parts])
        starts = np.cumsum(lengths) - lengths
        part_of = np.repeat(np.arange(len(parts)), lengths)
        place = np.arange(len(words)) - starts[part_of]
        left = lengths[part_of] - place
        slots, here, windows = _slots(words), np.zeros(len(words) + 1, np.int32), []
        for group in self.groups:
            size, known = group[0], group[4]
            np.cumsum(known[slots], dtype=np.int32, out=here[1:])
            # whole windows, and texts that are shorter than a window
            at = np.flatnonzero(here[size:] - here[:-size] >= self.s.known_share * size) if size <= len(words) else np.zeros(0, np.int64)
            stride = max(1, size // self.s.stride)
            at = at[(left[at] >= size) & ((place[at] % stride == 0) | (left[at] == size))]
            short = starts[lengths < size]
            if len(short):
                n = lengths[lengths < size]
                short = short[here[short + n] - here[short] >= self.s.known_share * n]
                at = np.concatenate([at, short])
            if len(at):
                windows.append((group, at))
        if not windows:
            return
        # fingerprints only for the parts that have such windows
        some = np.zeros(len(parts), bool)
        for _, at in windows:
            some[part_of[at]] = True
        moved = np.cumsum(np.where(some, lengths, 0)) - np.where(some, lengths, 0) - starts
        sums = _prefix_sums(_bits(words[some[part_of]]), np.uint8 if self.groups[-1][0] < 256 else np.uint32)
        radius = 8 * (self.s.near_bits + 1) - 1
        for (size, members, prints, tables, _), every in windows:
            for k in range(0, len(every), 4096):
                at = every[k : k + 4096]
                to = at + moved[part_of[at]]
                n = np.minimum(size, left[at])
                over = sums[to + n] - sums[to] > (n // 2)[:, None]
                fingerprints = np.packbits(over.reshape(-1)).view(np.uint16).reshape(-1, 8)
                hit = tables[0][fingerprints[:, 0]]
                for b in range(1, 8):
                    hit |= tables[b][fingerprints[:, b]]
                at, fingerprints = at[hit], fingerprints[hit]
                far = np.bitwise_count(fingerprints[:, None].view(np.uint64) ^ prints[None].view(np.uint64)).sum(2)
                for i, m in zip(*np.nonzero(far <= radius)):
                    text, first, _ = parts[part_of[at[i]]]
                    begin = first + int(place[at[i]])
                    slack = abs(size - self.items[members[m]][1]) + max(1, size // self.s.stride)
                    near.setdefault((text, members[m]), []).append((max(0, begin - slack), begin + slack))

    def _verify(self, words: np.ndarray, spans: list[tuple[int, int]], m: int) -> tuple[float, int] | None:
        """(similarity, first word) of the most similar window of item ``m``'s own size that begins in one of
        ``spans``; of equal ones the first; None if none is similar enough."""
        _, length, values, counts = self.items[m]
        width = min(WIDTH, length)
        n = min(length, len(words))  # a shorter text is one window
        if n < width:
            return None
        span, total, best = n - width + 1, int(counts.sum()), None
        joined: list[list[int]] = []
        for lo, hi in sorted(spans):
            lo, hi = min(lo, len(words) - n), min(hi, len(words) - n)
            if joined and lo <= joined[-1][1] + 1:
                joined[-1][1] = max(hi, joined[-1][1])
            else:
                joined.append([lo, hi])
        for lo, hi in joined:
            some = shingles(words[lo : hi + n], width)
            at = np.searchsorted(values, some)
            at[at == len(values)] = 0
            which = np.where(values[at] == some, at, -1).tolist()
            most, have, both = counts.tolist(), [0] * len(values), 0
            for i, v in enumerate(which):  # the window of shingles that ends with number i
                if v >= 0:
                    both += have[v] < most[v]
                    have[v] += 1
                if i >= span and (u := which[i - span]) >= 0:
                    have[u] -= 1
                    both -= have[u] < most[u]
                if i >= span - 1:
                    similarity = both / (span + total - both)
                    if similarity >= self.s.similarity - 1e-12 and (best is None or similarity > best[0] + 1e-12):
                        best = (similarity, lo + i - span + 1)
        return best


def item_blocks(spark: SparkSession, items: DataFrame, s: Settings) -> Iterator[Index]:
    """Indexes of blocks of items, each of about ``index_words`` words at most."""
    items = items.select("item_id", "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (5 * s.index_words)))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index(sorted((r.item_id, r.text) for r in part.toLocalIterator()), s)


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, similarity, word: the best window of a document for each item that it holds.

    Words are split at white space, lower-cased (A-Z) and freed of punctuation at both ends. A document
    shorter than an item is one window. Null and empty texts and items match nothing; items of fewer than
    five words are one shingle. Of windows that are equally similar the first counts; equal items each have
    their row. Repeated rows of documents give repeated rows, a null doc_id stays null, very long texts are
    read whole, empty tables give no row. Only doc_id and text are read of ``docs``, item_id and text of
    ``items``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, word long"
    found = None
    for index in item_blocks(spark, items, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, index = Words(_PUNCTUATION), shared.value
            for b in slices(batches):
                rows: list[list] = [[], [], [], []]
                texts = [words(text or b"") for text in b.column("text").cast(pa.binary()).to_pylist()]
                for doc_id, hits in zip(b.column("doc_id").to_pylist(), index.find_all(texts)):
                    for hit in hits:
                        for column, x in zip(rows, (doc_id, *hit)):
                            column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(list(map(pa.array, rows, kinds)), ["doc_id", "item_id", "similarity", "word"])

        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def without_items(spark: SparkSession, docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all of their columns, whose text holds none of ``items``. Each row is judged by
    its own text, whatever its doc_id; null and empty texts hold nothing and stay."""
    for index in item_blocks(spark, items, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, index = Words(_PUNCTUATION), shared.value
            for b in slices(batches):
                texts = [words(text or b"") for text in b.column("text").cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array([not hits for hits in index.find_all(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
