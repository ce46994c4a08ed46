"""A Merkle manifest of a corpus: stored node rows that link to their parents, and a recursive query that climbs.

Every row of the corpus is a leaf of the tree of its language; the roots of these trees are the leaves of one
more tree, whose root stands for the corpus. A stored node row names its parent, which is the ancestor ``hop``
levels up, and the siblings on the way there. A recursive query starts from leaves, meets the row of the node
that each has reached, appends the siblings, folds the presented hash with them, and goes on from the parent.

Places in a tree come from a range sort whose partitions count their own rows, so that no language is one
task's work, and sixteen neighbours at most meet in a group.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import let, materialise, sized

#: The tree over the roots of the other trees.
TOP = -1


@dataclass(frozen=True)
class Settings:
    """``hop``: levels from a stored node to its parent. ``broadcast_rows``: tables of at most so many rows (nodes
    above the leaves, trees) are broadcast, larger ones joined by shuffle."""

    hop: int = 4
    broadcast_rows: int = 200_000


@dataclass
class Manifest:
    """Written tables of a corpus.

    ``leaves``: the columns of ``build``'s input but those that were hashed alone, leaf, presented (binary), and
    a parent link with steps; ``nodes``: tree, level, place, up_tree, up_level, up_place, steps of the nodes above;
    ``trees``: lang, tree, n, subroot (binary); ``root``: hex, null for an empty corpus."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (binary) of the values, each with its length, so that no two rows of values read alike."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def joined_hash(values: Column) -> Column:
    """SHA-256 (binary) of the hex texts of an array of digests, concatenated."""
    return F.unhex(F.sha2(F.array_join(F.transform(values, _hex), ""), 256))


def numbered(spark: SparkSession, rows: DataFrame, group: list[str], order: list[str], name: str, broadcast_rows: int) -> DataFrame:
    """``rows`` with ``place``, counted from 0 within each ``group`` in the ``order`` given, nulls first.

    A range sort deals rows out, the partitions' counts add up to offsets: a group may lie in many partitions."""
    keys = [*group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(spark, placed, name).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", *group).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_part", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    runs = sized(materialise(spark, runs, f"{name}-runs"), broadcast_rows)
    return placed.join(runs, ["_part", *group]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _levels(hashes: Column, count: Column, hop: int) -> Column:
    """Array of the levels (arrays of digests) that stand on ``hashes``, the first ``count`` of them, ``hashes`` first."""

    def up(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int")), lambda i: joined_hash(F.slice(last, 2 * i + 1, 2)))
        return F.concat(levels, F.array(pairs))

    steps = F.when(count > 0, F.sequence(F.lit(1), F.least(count, F.lit(hop)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(hashes), up)


def _steps(levels: Column, place: Column, count: Column) -> Column:
    """Array of (before, after): the siblings of the node at ``place`` of the lowest level and of its ancestors, up to
    ``count`` levels up; a null side has none."""

    def step(k: Column) -> Column:
        level, i = F.element_at(levels, k + 1), F.call_function("shiftright", place, k)
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.get(level, i - 1)).alias("before"), F.when(~odd, F.get(level, i + 1)).alias("after"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), step)).otherwise(F.array().cast("array<struct<before:binary,after:binary>>"))


def _linked(rows: DataFrame, trees: DataFrame, level: int, s: Settings) -> DataFrame:
    """``rows`` (tree, place, hash, and more) of a level with up_tree, up_level, up_place, steps, and on the first of the
    nodes below a common parent ``above``, its digest, and ``last``, whether it is the root of its tree. ``trees``: tree,
    n (nodes of the tree at this level).

    Up to 2**hop neighbours meet in a group, so a group is small however large its tree."""
    width = 1 << s.hop
    own = F.struct("place", "hash", *(c for c in rows.columns if c not in ("tree", "place", "hash")))
    groups = rows.join(trees.select("tree", "n"), "tree").groupBy("tree", "n", F.shiftright("place", s.hop).alias("up"))
    groups = groups.agg(F.sort_array(F.collect_list(own)).alias("own"))
    # as many levels as it takes to get from n nodes to one, hop at most
    count = F.when(F.col("n") >= width, s.hop).otherwise(F.ceil(F.log2(F.col("n").cast("double")) - 1e-9)).cast("int")
    groups = groups.withColumn("count", count).withColumn("levels", _levels(F.transform("own", lambda x: x["hash"]), F.col("count"), s.hop))
    links = groups.select("tree", "n", "up", "levels", "count", F.explode("own").alias("x"))
    last, top, place = F.col("n") <= width, F.col("tree") == TOP, (F.col("x.place") % width).cast("int")
    link = lambda root, other, kind: F.when(last, F.when(~top, root)).otherwise(other).cast(kind)
    return links.select(
        "tree", F.lit(level).alias("level"), "x.*",
        link(F.lit(TOP), F.col("tree"), "long").alias("up_tree"),
        link(F.lit(0), F.lit(level + 1), "int").alias("up_level"),
        link(F.col("tree"), F.col("up"), "long").alias("up_place"),
        _steps(F.col("levels"), place, F.col("count")).alias("steps"),
        F.when(place == 0, F.element_at(F.element_at("levels", -1), 1)).alias("above"), last.alias("last"), "up",
    )


def _grown(spark: SparkSession, rows: DataFrame, trees: DataFrame, s: Settings, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(linked rows of each level, roots (tree, hash)) of the trees over ``rows`` (tree, place, hash, and more)."""
    levels, roots = [], None
    while True:
        linked = materialise(spark, _linked(rows, sized(trees, s.broadcast_rows), len(levels), s), f"{name}-{len(levels)}")
        levels.append(linked)
        above = linked.where("above is not null")
        found = above.where("last").select("tree", F.col("above").alias("hash"))
        roots = found if roots is None else roots.union(found)
        rows = above.where("not last").select("tree", F.col("up").alias("place"), F.col("above").alias("hash"))
        if rows.isEmpty():
            return levels, roots
        trees = trees.select("tree", F.ceil(F.col("n") / (1 << s.hop)).cast("long").alias("n"))


def build(spark: SparkSession, rows: DataFrame, s: Settings = Settings()) -> Manifest:
    """``rows``: doc_id, lang, leaf and presented (binary: the digest of a row, and what is held against it).

    Leaves of a language stand by doc_id, null first; rows of one doc_id by their digest, equal ones in any order."""
    leaves = materialise(spark, rows.select("doc_id", "lang", "leaf", "presented"), "leaves")
    languages = materialise(spark, leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    trees = numbered(spark, languages, [], ["lang"], "trees", s.broadcast_rows).withColumnRenamed("place", "tree")
    trees = materialise(spark, trees, "tree-ids")
    known = sized(trees, s.broadcast_rows)
    own = leaves.join(known.select(F.col("lang").alias("_lang"), "tree"), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang", "lang")
    own = numbered(spark, own, ["tree"], ["doc_id", "leaf", "presented"], "placed", s.broadcast_rows)
    linked, subroots = _grown(spark, own.withColumnRenamed("leaf", "hash"), trees, s, "tree")
    subroots = materialise(spark, subroots.withColumnRenamed("hash", "subroot"), "subroots")
    trees = materialise(spark, trees.join(sized(subroots, s.broadcast_rows), "tree"), "tree-roots")
    top = trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("hash"))
    count = materialise(spark, top.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "top-size")
    above, root = _grown(spark, top, count, s, "top")
    nodes = [x.select("tree", "level", "place", "up_tree", "up_level", "up_place", "steps") for x in (*linked[1:], *above)]
    every = nodes[0]
    for x in nodes[1:]:
        every = every.union(x)
    found = root.select(_hex(F.col("hash")).alias("root")).first()
    return Manifest(linked[0].withColumnRenamed("hash", "leaf"), materialise(spark, every, "nodes"), trees, found and found["root"])


_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT doc_id, tree, leaf, up_tree, up_level, up_place,
         aggregate(steps, unhex(''), (p, s) -> concat(p, coalesce(s.before, unhex('')), coalesce(s.after, unhex('')))) AS proof,
         aggregate(steps, presented, (h, s) -> unhex(sha2(concat(lower(hex(coalesce(s.before, unhex('')))), lower(hex(h)), lower(hex(coalesce(s.after, unhex(''))))), 256))) AS folded
  FROM {leaves}
  UNION ALL
  SELECT {hint} c.doc_id, c.tree, c.leaf, n.up_tree, n.up_level, n.up_place,
         aggregate(n.steps, c.proof, (p, s) -> concat(p, coalesce(s.before, unhex('')), coalesce(s.after, unhex('')))),
         aggregate(n.steps, c.folded, (h, s) -> unhex(sha2(concat(lower(hex(coalesce(s.before, unhex('')))), lower(hex(h)), lower(hex(coalesce(s.after, unhex(''))))), 256)))
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_place = n.place
)
SELECT * FROM climb LIMIT ALL
"""


def climb(spark: SparkSession, manifest: Manifest, s: Settings = Settings()) -> DataFrame:
    """doc_id, tree, leaf, proof (digests, joined), folded (all binary) of every leaf, once it has reached the root."""
    few = manifest.nodes.count() <= s.broadcast_rows
    names = {k: f"_{k}_{uuid.uuid4().hex}" for k in ("leaves", "nodes")}
    manifest.leaves.createOrReplaceTempView(names["leaves"])
    manifest.nodes.createOrReplaceTempView(names["nodes"])
    found = spark.sql(_CLIMB.format(hint="/*+ BROADCAST(n) */" if few else "", **names)).where("up_tree is null")
    for name in names.values():
        spark.catalog.dropTempView(name)
    return found.select("doc_id", "tree", "leaf", "proof", "folded")


def proofs(spark: SparkSession, rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row per row of ``rows`` (doc_id, lang, leaf,
    presented).

    ``proof_sha256`` is the SHA-256 of the siblings' hex texts from the leaf to the root, ``folded_root`` what the
    presented digest folds to with them, ``verified`` whether that is the root. A null lang is a tree of its own, the
    first; a null doc_id stands before all others of its tree. Repeated rows are leaves of their own, with equal or
    neighbouring places. The only leaf of a tree is its root, an empty table gives no row.
    """
    manifest = build(spark, rows, s)
    trees = sized(manifest.trees.select("tree", "subroot"), s.broadcast_rows)
    found = climb(spark, manifest, s).join(trees, "tree")
    root = F.lit(manifest.root).cast("string")
    return found.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(_hex(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"), (_hex(F.col("folded")) == root).alias("verified"),
    )


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf, presented of ``docs``; where ``tampered`` holds, what is presented has one more in n_chars.

    All five columns are hashed, whole texts included; nulls and empty texts read differently. Other columns are not
    read."""
    d, more = [F.col(c) for c in ("doc_id", "source", "lang")], F.col("n_chars") + 1
    leaf = leaf_hash(*d, F.col("n_chars"), F.col("text"))
    other = leaf_hash(*d, more, F.col("text"))
    return docs.select("doc_id", "lang", let(leaf, lambda x: F.struct(x.alias("leaf"), F.when(tampered, other).otherwise(x).alias("presented"))).alias("x")).select(
        "doc_id", "lang", "x.leaf", "x.presented"
    )
