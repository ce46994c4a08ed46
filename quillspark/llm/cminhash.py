"""Near-duplicates by circulant MinHash, banding, and exact Jaccard on the full shingle sets.

Two permutations give all coordinates of a signature: the first scatters shingles over a ring, the
second, shifted circularly by k, gives coordinate k. The coordinates of one shingle are therefore a
contiguous stretch of the second permutation, and a signature is the minimum of such stretches.

Documents of equal sets are one class. Classes that share a band are candidates. Within a band's group
only pairs with a leader are verified; the groups whose members are all known to be connected need no
more work. Rounds with other leaders follow until few pairs are open, or ``rounds`` are done. What is then
open is verified in full: all pairs of different components in bands of few such pairs; in crowded bands
those pairs that share a shingle among the rarest of both, so many that no similar pair can do without
(prefix filtering). So a group of copies, or of texts just short of similar, costs work in proportion to
its size, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, repeated, sized, slices, split_join
from .shingles import Words, shingles


@dataclass(frozen=True)
class Settings:
    """Bands of ``rows`` coordinates: a pair of similarity s shares one with chance 1 - (1 - s**rows)**bands.

    32 bands of 4 find a pair of similarity 0.75 but for a chance of 5e-6. ``percent``: least similarity.
    ``crowd``: a band of more open pairs than so many a member is searched by rare shingles. ``slot_bits``: they
    are ranked by counts of 2**slot_bits slots. Tables of at most ``broadcast_rows`` rows of ids, and of at most
    ``broadcast_sets`` sets, are broadcast.
    """

    bands: int = 32
    rows: int = 4
    ring_bits: int = 20
    percent: int = 75
    rounds: int = 2
    leaders: int = 6
    crowd: int = 8
    slot_bits: int = 20
    seed: int = 5
    broadcast_rows: int = 500_000
    broadcast_sets: int = 100


class Circulant:
    def __init__(self, s: Settings):
        dice, size, k = np.random.default_rng(s.seed), 1 << s.ring_bits, s.bands * s.rows
        self.settings, self.mask = s, np.uint64(size - 1)
        self.first = dice.permutation(size).astype(np.int32)
        second = dice.permutation(size).astype(np.int32)
        ring = np.concatenate([second, second[:k]])
        self.stretch = np.lib.stride_tricks.sliding_window_view(ring, k)
        self.factors = (dice.integers(1, 2**63, s.rows, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)
        self.salts = dice.integers(0, 2**63, s.bands, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first[(hashes & self.mask).astype(np.int64)]
        least = self.stretch[at[:2048]].min(0)
        for k in range(2048, len(at), 2048):
            np.minimum(least, self.stretch[at[k : k + 2048]].min(0), out=least)
        return least

    def bands(self, signature: np.ndarray) -> np.ndarray:
        s = self.settings
        parts = (signature.reshape(s.bands, s.rows).astype(np.uint64) + np.uint64(1)) * self.factors
        mixed = (parts ^ (parts >> np.uint64(29))).sum(1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed ^ self.salts).astype(np.int64)


def _utf8(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, content (digest of the set, null for an empty one), bands: a row
    per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, circulant = Words(), Circulant(s)
        for b in slices(batches):
            sizes, contents, bands = [], [], []
            for text in _utf8(b):
                found = np.unique(shingles(words(text or b"")))
                sizes.append(len(found))
                contents.append(xxhash.xxh3_128_digest(found) if len(found) else None)
                bands.append(circulant.bands(circulant.signature(found)) if len(found) else [])
            columns = [b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())]
            columns.append(pa.array(bands, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "content", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, content binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, content (digest of the set), shingles: the full set of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            sets = [np.unique(shingles(words(t or b""))) for t in _utf8(b)]
            digests = pa.array([xxhash.xxh3_128_digest(x) if len(x) else None for x in sets], pa.binary())
            columns = [b.column("doc_id"), digests, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, content binary, shingles array<long>")


def slot_counts(sets: DataFrame, s: Settings) -> np.ndarray:
    """How often the shingles of each slot occur in ``sets`` (shingles): counted in each task, then summed. The
    driver gets a row per slot, so 2**slot_bits at most, whatever the input."""
    size = 1 << s.slot_bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            found = b.column("shingles").flatten().to_numpy(zero_copy_only=False)
            at, n = np.unique(found & np.int64(size - 1), return_counts=True)
            counts[at] += n
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 50_000):
            some = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(counts[some])], ["slot", "n"])

    counted = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return counts


def rare_prefixes(sets: DataFrame, counts: np.ndarray, s: Settings) -> DataFrame:
    """doc_id, component, n, shingle, place: the rarest shingles of each set of ``sets`` (doc_id, component, shingles).

    Two sets of sizes n and m are similar only if they share least = ceil(p (n + m) / (100 + p)) shingles. With
    all shingles in one order, the first n - least + 1 of one and m - least + 1 of the other then share one.
    The smallest similar partner asks for most; ``place`` (from 1) tells what a larger one asks for. ``counts``:
    for each slot of shingles, how often they occur; the order is by that count and then by shingle.
    """
    shared, mask = sets.sparkSession.sparkContext.broadcast(counts), np.int64(len(counts) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            parts, rows = [], 0
            for doc_id, component, found in zip(b.column("doc_id").to_pylist(), b.column("component").to_pylist(), b.column("shingles")):
                found = found.values.to_numpy(zero_copy_only=False)
                n = len(found)
                found = found[np.lexsort((found, counts[found & mask]))[: n - -(-s.percent * n // 100) + 1]]
                parts.append((np.full(len(found), doc_id), np.full(len(found), component), np.full(len(found), n), found, np.arange(1, len(found) + 1)))
                rows += len(found)
                if rows > 200_000:
                    yield batch(parts)
                    parts, rows = [], 0
            if parts:
                yield batch(parts)

    def batch(parts: list) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "component", "n", "shingle", "place"])

    rows = sets.select("doc_id", "component", "shingles")
    return rows.mapInArrow(run, "doc_id long, component long, n long, shingle long, place long")


def components(spark: SparkSession, links: DataFrame, broadcast_rows: int) -> DataFrame:
    """a, b (the least id reachable) for every id of ``links`` (a, b) that isn't the least itself.

    Alternating large-star and small-star steps until nothing changes; the number of steps grows with the
    logarithm of the input. While the links are few, the joins of a step are broadcasts."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    rows = e.count()
    before = None
    while True:
        small = rows <= broadcast_rows
        # the centre of a star has a link to each of its ids: it is hot
        meet = (lambda a, b: a.join(F.broadcast(b), "u")) if small else (lambda a, b: split_join(spark, a, b, "u", "v", broadcast_rows))
        kept = (lambda df, name: df) if small else (lambda df, name: materialise(spark, df, name))
        both = e.union(e.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = kept(meet(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-stars")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        stars = meet(large, least)
        stars = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = materialise(spark, stars.where("u <> v").distinct(), "stars", small)
        now = e.agg(F.count("u"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return e.select(F.col("u").alias("a"), F.col("v").alias("b"))


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Search:
    def __init__(self, spark: SparkSession, docs: DataFrame, s: Settings):
        self.spark, self.s = spark, s
        self.rows = materialise(spark, signatures(docs, s), "signatures")
        whole = self.rows.where("content is not null and doc_id is not null")
        classes = whole.groupBy("content").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        classes = materialise(spark, classes, "classes")
        # a class goes by its least doc_id, or, where classes share that (texts of one doc_id), by a hash of its own
        again = materialise(spark, repeated(classes.select(F.col("lo").alias("doc_id"))), "shared-ids")
        self.several = not again.isEmpty()
        self.classes = classes.withColumn("rep", F.col("lo"))
        if self.several:
            again = sized(again, s.broadcast_rows)
            known = classes.join(again.select(F.col("doc_id").alias("lo"), F.lit(True).alias("_again")), "lo", "left")
            rep = F.when(F.col("_again"), F.xxhash64("content", F.lit(s.seed))).otherwise(F.col("lo"))
            self.classes = materialise(spark, known.select("content", "lo", "hi", rep.alias("rep")), "named-classes")
        reps = whole.join(self.classes.select("content", F.col("lo").alias("doc_id"), "rep"), ["content", "doc_id"]).dropDuplicates(["rep"])
        members = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
        shared = members.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("rep").alias("k")).where("lo < hi")
        self.members = materialise(spark, self.meet(members, shared.select("band", "k"), "shared").drop("k"), "members")
        ids = self.members.select(F.col("rep").alias("doc_id")).distinct()
        ids = sized(materialise(spark, ids, "candidates"), s.broadcast_rows)
        if self.several:
            # texts of doc_ids that classes share find their class by content, the others need no shuffle of their sets
            texts = docs.join(again, "doc_id", "left_semi")
            named = self.classes.where("rep <> lo").select("content", F.col("rep").alias("doc_id"))
            more = shingle_sets(texts).drop("doc_id").join(named, "content").join(ids, "doc_id", "left_semi")
            docs = docs.join(again, "doc_id", "left_anti")
        sets = shingle_sets(docs.join(ids, "doc_id", "left_semi"))
        # so do rows of other doc_ids with several texts: the class of a doc_id is that of the text which it begins
        double = materialise(spark, repeated(self.rows).join(ids, "doc_id", "left_semi"), "repeated")
        if not double.isEmpty():
            double = sized(double, s.broadcast_rows)
            own = self.classes.where("rep = lo").select("content", F.col("rep").alias("doc_id"))
            once = sets.join(double, "doc_id", "left_semi").join(own, ["content", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
            sets = sets.join(double, "doc_id", "left_anti").unionByName(once)
        sets = sets.select("doc_id", "shingles")
        if self.several:
            sets = sets.unionByName(more.dropDuplicates(["doc_id"]).select("doc_id", "shingles"))
        self.sets = materialise(spark, sets, "sets")
        self.tested: DataFrame | None = None
        self.stars: DataFrame | None = None

    def meet(self, members: DataFrame, bands: DataFrame, name: str) -> DataFrame:
        """``members`` with the columns of ``bands`` (band, k: how many members it has, and more), a row per band.

        Members are not dealt by band: a small table of bands is broadcast. Of a larger one, the bands that hold
        a ten-thousandth of all members are, of which there are ten thousand at most; only the rest is shuffled."""
        bands = materialise(self.spark, bands, name)
        if bands.count() <= self.s.broadcast_rows:
            return members.join(F.broadcast(bands), "band")
        most = bands.agg(F.sum("k")).first()[0] / 10_000
        hot = F.broadcast(bands.where(F.col("k") >= most))
        cold = members.join(hot.select("band"), "band", "left_anti").join(bands.where(F.col("k") < most), "band")
        return members.join(hot, "band").unionByName(cold)

    def verify(self, pairs: DataFrame) -> None:
        """Adds the pairs (a, b) whose full sets are similar enough to the links."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = self.sets.join(sized(materialise(self.spark, ids, "pair-ids"), self.s.broadcast_rows), "doc_id", "left_semi")
        sets = materialise(self.spark, sets, "pair-sets")
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        # a leader stands in all pairs of its crowd
        named, most = pairs.select("a", "b"), self.s.broadcast_sets
        found = split_join(self.spark, named, left, "a", "b", most)
        found = split_join(self.spark, found, right, "b", "a", most, counted=named).withColumn("both", both)
        found = found.where(100 * F.col("both") >= self.s.percent * (F.size("x") + F.size("y") - F.col("both")))
        found = materialise(self.spark, found.select("a", "b"), "verified")
        # links already joined to stars say the same as before
        found = found if self.stars is None else found.union(self.stars)
        self.stars = components(self.spark, found, self.s.broadcast_rows)
        pairs = pairs.select("a", "b")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)

    def open_members(self, members: DataFrame) -> DataFrame:
        """Members, with their component so far, of the bands that hold more than one component."""
        if self.stars is None:
            known = members.withColumn("component", F.col("rep"))
        else:
            found = sized(self.stars.toDF("rep", "component"), self.s.broadcast_rows)
            known = members.drop("component").join(found, "rep", "left")
            known = known.withColumn("component", F.coalesce("component", "rep"))
        mixed = known.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("rep").alias("k"))
        return materialise(self.spark, self.meet(known, mixed.where("lo < hi").select("band", "k"), "mixed").drop("k"), "open")

    @staticmethod
    def few(members: DataFrame) -> bool:
        """Whether the pairs of different components within bands are few for the number of members."""
        parts = members.groupBy("band", "component").agg(F.count("rep").alias("k"))
        bands = parts.groupBy("band").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"))
        pairs, rows = bands.agg(F.sum((F.col("k") * F.col("k") - F.col("same")) / 2), F.sum("k")).first()
        return (pairs or 0) <= 4 * (rows or 0)

    def split(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of different components in bands with few of them, and rep, component of the members of
        crowded bands."""
        parts = members.groupBy("band", "component").agg(F.count("rep").alias("n"))
        bands = parts.groupBy("band").agg(
            F.sum("n").alias("k"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max_by("component", F.struct("n", "component")).alias("major")
        )
        crowded = F.col("k") * F.col("k") - F.col("same") > 2 * self.s.crowd * F.col("k")
        rows = self.meet(members, bands.select("band", "k", "major", crowded.alias("crowded")), "bands").drop("k")
        rows = materialise(self.spark, rows, "split")
        # of a band's members, those of its largest component meet only the others
        few = rows.where("not crowded").select("band", "rep", "n", "component", (F.col("component") == F.col("major")).alias("most"))
        a = sized(few.where("not most"), self.s.broadcast_rows).alias("a")
        met = few.alias("b").join(a, F.col("a.band") == F.col("b.band")).where(
            (F.col("a.component") != F.col("b.component"))
            & (F.col("b.most") | (F.col("a.rep") < F.col("b.rep")))
            & _long_enough(F.col("a.n"), F.col("b.n"), self.s.percent)
        )
        pairs = met.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))
        return pairs, materialise(self.spark, rows.where("crowded").select("rep", "component").distinct(), "crowd")

    def rare_pairs(self, crowd: DataFrame) -> DataFrame:
        """Pairs (a, b) of ``crowd`` (rep, component) of different components that share a shingle where
        similar sets must; a superset of the similar pairs."""
        s = self.s
        crowd = sized(crowd, s.broadcast_rows).withColumnRenamed("rep", "doc_id")
        sets = materialise(self.spark, self.sets.join(crowd, "doc_id"), "crowd-sets")
        rows = materialise(self.spark, rare_prefixes(sets, slot_counts(sets, s), s), "prefixes")
        # of a shingle's rows, those of its largest component meet only the others
        groups = rows.groupBy("shingle", "component").agg(F.count("n").alias("k"))
        groups = groups.groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count("k").alias("parts"))
        groups = materialise(self.spark, groups.where("parts > 1").drop("parts"), "shared-shingles")
        rows = split_join(self.spark, rows, groups, "shingle", "doc_id", s.broadcast_rows).withColumn("most", F.col("component") == F.col("major"))
        rows = materialise(self.spark, rows.drop("major"), "shared-rows")
        a = rows.where("not most").select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "place", "component")))
        b = rows.select("shingle", "most", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "place", "component")))
        least = F.ceil(F.lit(s.percent) * (F.col("n_a") + F.col("n_b")) / (100 + s.percent) - 1e-9)
        right = (F.col("component_a") != F.col("component_b")) & (F.col("most") | (F.col("doc_id_a") < F.col("doc_id_b")))
        right &= _long_enough(F.col("n_a"), F.col("n_b"), s.percent)
        right &= (F.col("place_a") <= F.col("n_a") - least + 1) & (F.col("place_b") <= F.col("n_b") - least + 1)
        found = split_join(self.spark, a, b, "shingle", "doc_id_a", s.broadcast_sets).where(right)
        return found.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))

    def untested(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti")

    def run(self) -> DataFrame:
        """rep, component of all classes that are linked."""
        percent, members = self.s.percent, self.members
        for k in range(self.s.rounds):
            members = self.open_members(members)
            if k and self.few(members):
                break
            order = F.col("rep") if k == 0 else F.xxhash64("rep", F.lit(k))
            leaders = members.groupBy("band").agg(F.min_by(F.struct("rep", "n", "component"), order).alias("lead"), F.count("rep").alias("k"))
            pairs = self.meet(members, leaders, "leaders").where(
                (F.col("component") != F.col("lead.component")) & _long_enough(F.col("n"), F.col("lead.n"), percent)
            )
            pairs = pairs.select(
                "rep", F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"), F.xxhash64("lead.rep").alias("o")
            )
            # a member meets a few new leaders a round; it has one in each of its bands at most
            met = F.slice(F.sort_array(F.collect_set(F.struct("o", "a", "b"))), 1, self.s.leaders)
            met = self.untested(pairs.distinct()).groupBy("rep").agg(met.alias("met"))
            pairs = materialise(self.spark, met.select(F.explode("met").alias("p")).select("p.a", "p.b").distinct(), "pairs")
            if pairs.isEmpty():
                break
            self.verify(pairs)
        pairs, crowd = self.split(self.open_members(members))
        if not crowd.isEmpty():
            pairs = pairs.union(self.rare_pairs(crowd))
        pairs = self.untested(pairs.distinct())
        pairs = materialise(self.spark, pairs, "pairs")
        if not pairs.isEmpty():
            self.verify(pairs)
        if self.stars is None:
            return self.spark.createDataFrame([], "rep long, component long")
        return self.stars.toDF("rep", "component")


def near_duplicates(spark: SparkSession, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``.

    ``component_id`` is the least doc_id that links of at least ``percent`` per cent Jaccard reach, the
    document itself included; ``kept`` marks it. Documents without a word have an empty set and link with
    nothing, and so do rows of a null doc_id (their component is null; they are kept). Texts of equal sets
    are linked. Repeated rows give repeated, equal rows; if rows of a doc_id have several texts, equal texts
    are linked for each, similar ones for the least of them. Texts of any length are read whole; an empty table gives no row. Only doc_id and text are read.
    """
    rows = judged_rows(spark, docs, s)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def judged_rows(spark: SparkSession, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, content, component_id: as ``near_duplicates``; ``linked``: the
    same for rows whose texts are linked, null for a class that is linked with no other."""
    search = _Search(spark, docs, s)
    classes = search.classes.join(sized(search.run(), s.broadcast_rows), "rep", "left")
    classes = classes.withColumns({"linked": F.coalesce("component", "rep"), "least": F.coalesce("component", "lo")})
    if search.several:
        # a component goes by a rep, which may be a hash: its least doc_id is looked up
        classes = materialise(spark, classes.drop("least"), "linked-classes")
        least = materialise(spark, classes.groupBy("linked").agg(F.min("lo").alias("least")), "least-ids")
        classes = split_join(spark, classes, least, "linked", "rep", s.broadcast_rows)
    # only classes of several documents, or linked ones, say something that a row does not know itself
    told = classes.where("lo < hi or least <> lo" + (" or linked <> lo" if search.several else "")).select("content", F.col("least").alias("component_id"), "linked")
    told = materialise(spark, told, "told")
    rows = search.rows.select("doc_id", "text_key", "n_shingles", "content")
    rows = split_join(spark, rows, told, "content", "doc_id", s.broadcast_rows, "left")
    return rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def removed_texts(spark: SparkSession, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text_key of the rows that go so that one text of each component stays: that of the component's doc_id,
    and of several such texts that of the least hash. Texts that are linked with none stay, whatever their doc_id."""
    rows = materialise(spark, judged_rows(spark, docs, s), "judged").where("content is not null and doc_id is not null")
    others = rows.where("doc_id <> component_id").select("doc_id", "text_key")
    own = rows.where("doc_id = component_id").select("doc_id", "text_key", F.coalesce("linked", F.xxhash64("content")).alias("linked"))
    several = own.groupBy("doc_id", "linked").agg(F.min("text_key").alias("stays"), F.max("text_key").alias("last")).where("stays < last").drop("last")
    more = own.join(several, ["doc_id", "linked"]).where("text_key <> stays").select("doc_id", "text_key")
    return others.union(more).distinct()
