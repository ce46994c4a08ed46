"""Task queue, event log and failures as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialise


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "normal", 1).otherwise(2)


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """New tasks (file_path, task_type, id) without a pending one of the same path and type; the first of equal ones."""
    first = W.partitionBy("file_path", "task_type").orderBy("id")
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return new.join(tasks.where("status = 'pending'").select("file_path", "task_type"), ["file_path", "task_type"], "left_anti")


def next_tasks(tasks: DataFrame, *by: str) -> DataFrame:
    """The pending task of the best priority and then the longest wait, for each group."""
    order = F.struct(priority_rank(F.col("priority")), "added_at", "id")
    return tasks.where("status = 'pending'").groupBy(*by).agg(F.min_by("id", order).alias("id"))


def latest_status(events: DataFrame) -> DataFrame:
    """task, status, started_at, retries from a log of (task, seq, ts, status)."""
    order = F.struct("ts", "seq")
    return events.groupBy("task").agg(
        F.max_by("status", order).alias("status"), F.max(F.when(F.col("status") == "processing", F.col("ts"))).alias("started_at"), F.count_if(F.col("status") == "failed").alias("failures")
    )


def retry_failed(tasks: DataFrame, most: int = 3) -> DataFrame:
    again = (F.col("status") == "failed") & (F.col("retry_count") < most)
    return tasks.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "retried": again})


def reset_stuck(tasks: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Tasks in processing for longer than the limit, or without a start, are pending again."""
    late = F.col("started_at").isNull() | (F.unix_seconds(now) - F.unix_seconds(F.col("started_at").cast("timestamp")) > seconds)
    return tasks.withColumn("status", F.when((F.col("status") == "processing") & late, "pending").otherwise(F.col("status")))


def stats(tasks: DataFrame) -> DataFrame:
    """kind, value, n: tasks by status, and pending ones by priority."""
    a = tasks.groupBy(F.lit("status").alias("kind"), F.col("status").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    b = tasks.where("status = 'pending'").groupBy(F.lit("priority").alias("kind"), F.col("priority").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return a.union(b)


def error_runs(events: DataFrame, failed: str) -> DataFrame:
    """task, longest: the longest run of failures without a break in a log of (task, seq, ts, status).

    A range sort cuts the log into pieces, and a task's rows of a piece are summed up by their length, the runs that they
    begin and end with and their longest run. Two neighbouring sums make one, so a task of most rows is no task's sort."""
    keys = ["task", "ts", "seq"]
    rows = events.select(*keys, F.coalesce(F.col("status") == failed, F.lit(False)).alias("bad"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("task", "bad", F.monotonically_increasing_id().alias("at"))
    rows = materialise(events.sparkSession, rows, "sorted-log").withColumn("piece", F.shiftright("at", 33))
    island = F.col("at") - F.row_number().over(W.partitionBy("piece", "task", "bad").orderBy("at"))
    runs = rows.withColumn("island", island).groupBy("piece", "task", "bad", "island").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    run = F.when(F.col("bad"), F.col("n")).otherwise(0)
    pieces = runs.groupBy("piece", "task").agg(
        F.sum("n").alias("length"), F.min_by(run, "at").alias("leading"), F.max_by(run, "at").alias("trailing"), F.max(run).alias("longest")
    )

    def joined(a: Column, b: Column) -> Column:
        """The sum of a task's pieces so far and the next piece."""
        across = a["trailing"] + b["leading"]
        whole = lambda x: x["leading"] == x["length"]
        return F.struct(
            (a["length"] + b["length"]).alias("length"),
            F.when(whole(a), a["length"] + b["leading"]).otherwise(a["leading"]).alias("leading"),
            F.when(whole(b), a["trailing"] + b["length"]).otherwise(b["trailing"]).alias("trailing"),
            F.greatest(a["longest"], b["longest"], across).alias("longest"),
        )

    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("length", "leading", "trailing", "longest")))
    parts = F.sort_array(F.collect_list(F.struct("piece", "length", "leading", "trailing", "longest")))  # one for each piece at most
    return pieces.groupBy("task").agg(parts.alias("x")).select("task", F.aggregate("x", none, joined)["longest"].alias("longest"))


def failed_files(events: DataFrame) -> DataFrame:
    """task, failed_at, retry_count of tasks that failed after their last success, from a log of (task, seq, ts, status)."""
    at = F.struct("ts", "seq")
    done = events.where("status = 'completed'").groupBy("task").agg(F.max(at).alias("done"))
    rows = events.where("status = 'failed'").join(done, "task", "left").where(F.col("done").isNull() | (at > F.col("done")))
    return rows.groupBy("task").agg(F.max("ts").alias("failed_at"), (F.count("seq") - 1).alias("retry_count"))


def purge(failures: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Failures no older than ``days``."""
    return failures.where(F.col("failed_at") > now - F.make_dt_interval(F.lit(days)))


def triage(failed: DataFrame, most: int = 8) -> DataFrame:
    """kind, extension, n of failed files (extension, error): formats that are not supported, the ``most``
    frequent extensions, and contents that cannot be read in one row."""
    # What an error of the format says, and extensions without a reader.
    says = ("unsupported", "not supported", "no extractor", "format", "no handler", "handler returned false")
    unread = (".epub", ".mobi", ".azw", ".cbz", ".cbr")
    of_format = F.lower(F.coalesce("error", F.lit(""))).rlike("|".join(says)) | F.col("extension").isin(*unread)
    kind = F.when(of_format, "format").otherwise("content")
    rows = failed.select(kind.alias("kind"), F.when(of_format, F.col("extension")).alias("extension"))
    n = rows.groupBy("kind", "extension").agg(F.count(F.lit(1)).alias("n"))
    top = n.where("kind = 'format'").orderBy(F.desc("n"), "extension").limit(most)
    return top.union(n.where("kind = 'content'"))


def transitions(events: DataFrame) -> DataFrame:
    """task, status, started_at, completed_at, error, retry_count from a log of (task, seq, ts, status, error): the
    last status, the last start, the end of a task that is over, the error of a failed one. Only failures that say
    what went wrong count as retries."""
    at = F.struct("ts", "seq")
    over = F.col("status").isin("completed", "failed", "cancelled")
    rows = events.groupBy("task").agg(
        F.max_by(F.struct("status", "ts", "error"), at).alias("last"), F.max(F.when(F.col("status") == "processing", F.col("ts"))).alias("started_at"),
        F.count_if((F.col("status") == "failed") & (F.coalesce("error", F.lit("")) != "")).alias("retry_count"),
    )
    rows = rows.select("task", "last.*", "started_at", "retry_count")
    return rows.select(
        "task", "status", "started_at", F.when(over, F.col("ts")).alias("completed_at"), F.when(F.col("status") == "failed", F.col("error")).alias("error"), "retry_count"
    )


def stats_by(tasks: DataFrame) -> DataFrame:
    """kind, value, n: tasks by status and by type, and pending ones by priority, in one pass."""
    pending = F.when(F.col("status") == "pending", F.col("priority"))
    rows = tasks.select("status", "task_type", pending.alias("priority"))
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in rows.columns))).alias("x"))
    return cells.select("x.kind", "x.value").where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def newest(tasks: DataFrame, status: str, limit: int) -> DataFrame:
    return tasks.where(F.col("status") == status).orderBy(F.desc("added_at"), "id").limit(limit)


def without_completed(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tasks that are not completed, and how many were dropped."""
    done = F.col("status").eqNullSafe("completed")
    return tasks.where(~done), tasks.agg(F.count_if(done).alias("removed"))


def failure_reasons(failures: DataFrame) -> DataFrame:
    """reason, n, retryable: failed files (error, retry_count) by what went wrong; ``unknown`` if it is not said."""
    reason = F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.lit("unknown"))
    return failures.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("retry_count") < 3).alias("retryable"))


def worker_counters(events: DataFrame) -> DataFrame:
    """worker, processed, failed, consecutive_errors (failures since the last success), longest: from a log of
    (worker, seq, ts, status)."""
    at = F.struct("ts", "seq")
    good, bad = F.col("status") == "completed", F.col("status") == "failed"
    last = events.where(good).groupBy("worker").agg(F.max(at).alias("last"))
    rows = events.where(good | bad).join(last, "worker", "left")
    counted = rows.groupBy("worker").agg(
        F.count_if(good).alias("processed"), F.count_if(bad).alias("failed"), F.count_if(bad & (F.col("last").isNull() | (at > F.col("last")))).alias("consecutive_errors")
    )
    return counted.join(error_runs(events.withColumnRenamed("worker", "task"), "failed").withColumnRenamed("task", "worker"), "worker")
