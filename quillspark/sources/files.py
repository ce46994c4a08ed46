"""File tables: discovery, predicates, snapshots and their differences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, file_name

# Extensions a scan takes in.
EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".odt", ".rtf", ".txt", ".xls", ".xlsx", ".ods", ".csv", ".ppt", ".pptx", ".odp", ".jpg", ".jpeg",
    ".png", ".tiff", ".tif", ".bmp", ".webp", ".md", ".markdown", ".rst", ".tex", ".epub", ".mobi", ".html", ".htm",
)


def scan(spark: SparkSession, roots: list[str], with_hash: bool = False) -> DataFrame:
    """path, size, mtime, extension, sha256 (null without hash) of all files below the roots."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    digest = F.sha2("content", 256) if with_hash else F.lit(None).cast("string")
    return rows.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), extension(F.col("path")).alias("extension"), digest.alias("sha256")
    )


def below(path: Column, roots: tuple[str, ...]) -> Column:
    """The path from the longest of ``roots`` on that it lies under; else as it is."""
    rest = path
    for root in sorted(roots, key=len):
        head = root.rstrip("/") + "/"
        rest = F.when(path.startswith(head), F.substr(path, F.lit(len(head) + 1))).otherwise(rest)
    return rest


def skipped_folder(path: Column, excluded: tuple[str, ...], roots: tuple[str, ...] = ()) -> Column:
    """Whether a folder of the path, below its root, is hidden or excluded, in any case."""
    parts = F.split(below(path, roots), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda x: x.startswith(".") | F.lower(x).isin(*map(str.lower, excluded)))


def skipped_file(path: Column, names: tuple[str, ...] = (), excluded: tuple[str, ...] = (), supported: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether the file is hidden, has one of ``names`` or an ``excluded`` extension, in any case, or none that is ``supported``."""
    name, ext = file_name(path), extension(path)
    low = lambda x: [v.lower() for v in x] or [""]
    return name.startswith(".") | F.lower(name).isin(*low(names)) | ext.isin(*low(excluded)) | ~ext.isin(*low(supported))


def diff(old: DataFrame, new: DataFrame, by_hash: bool = False) -> DataFrame:
    """path, change (new, modified, deleted, unchanged) over the union of two snapshots."""
    o, n = old.alias("o"), new.alias("n")
    differs = F.col("o.mtime") != F.col("n.mtime")
    if by_hash:
        differs = differs & ~F.col("o.sha256").eqNullSafe(F.col("n.sha256"))
    change = F.when(F.col("o.path").isNull(), "new").when(F.col("n.path").isNull(), "deleted").when(differs, "modified").otherwise("unchanged")
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("o.path", "n.path").alias("path"), change.alias("change"))


def save_state(snapshot: DataFrame, folder: str, version: int) -> None:
    """Writes a snapshot under a name of its own, and its version to the log once it is whole; earlier ones stay."""
    snapshot.write.mode("overwrite").parquet(f"{folder}/snapshot-{version}")
    log = snapshot.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"))
    log.write.mode("append").parquet(f"{folder}/versions")


def load_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest version of a saved snapshot; no rows where none is saved yet."""
    try:
        newest = spark.read.schema("version long").parquet(f"{folder}/versions").agg(F.max("version")).first()[0]
    except AnalysisException:  # there is no such folder
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/snapshot-{newest}")


def clear_state(spark: SparkSession, folder: str, schema: str, version: int) -> None:
    """An empty version on top: the next difference takes every file for new."""
    save_state(spark.createDataFrame([], schema), folder, version)


def ingest_outcome(checked: DataFrame, most: int = 10) -> DataFrame:
    """success, queued, skipped, errors of one batch of requests (id, path, error; null: queued); of the errors
    the first ``most`` by id, joined by lines."""
    bad = F.col("error").isNotNull()
    counts = checked.agg(F.count_if(~bad).alias("queued"), F.count_if(bad).alias("skipped"))
    first = checked.where(bad).orderBy("id").limit(most).select("id", F.concat_ws(": ", "error", "path").alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x["line"])
    errors = first.agg(F.array_join(lines, "\n").alias("errors"))  # one row, as are the counts
    return counts.crossJoin(errors).select((F.col("skipped") == 0).alias("success"), "queued", "skipped", "errors")


def request_error(path: Column, exists: Column, is_file: Column, readable: Column) -> Column:
    """What keeps a path from being queued, the first fault; null: nothing."""
    return (
        F.when(~path.startswith("/"), "not absolute").when(~exists, "missing").when(~is_file, "not a file").when(~readable, "not readable")
    )
