"""Written tables in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, a local run gets a temporary folder; a cluster is refused,
    because a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(spark: SparkSession, df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again, which cuts its lineage.

    ``small``: the rows are known to be few, so that a few files hold them."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df.coalesce(8) if small else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]
