"""Job states from an event table: latest state, views, timing, counts, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm


def _order() -> Column:
    return F.struct("ts", "event_id")


def latest(events: DataFrame) -> DataFrame:
    """The last state of each job by event time, ties by event id."""
    last = F.max_by(F.struct("status", "error", "ts", "event_id"), _order())
    return events.groupBy("job_id").agg(last.alias("last")).select("job_id", "last.*")


def _ended(status: Column) -> Column:
    return status.isin(fv.COMPLETED, fv.FAILED)


def _last_known(name: str) -> Column:
    """The value of the last event that has one."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), _order())).alias(name)


def records(events: DataFrame) -> DataFrame:
    """One record per job: state, error, file, created, started, completed.

    ``created_at`` is the first event, ``started_at`` the last PROCESSING
    event, ``completed_at`` the last COMPLETED or FAILED event, as later
    updates replace earlier ones.
    """
    status, ts = F.col("status"), F.col("ts")
    grouped = events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "error"), _order()).alias("last"),
        _last_known("filename"),
        _last_known("size_bytes"),
        F.min("ts").alias("created_at"),
        F.max(F.when(status == fv.PROCESSING, ts)).alias("started_at"),
        F.max(F.when(_ended(status), ts)).alias("completed_at"),
    )
    return grouped.select(
        "job_id",
        "last.status",
        "last.error",
        "filename",
        nm.rounded_megabytes(F.col("size_bytes")).alias("file_size_mb"),
        "created_at",
        "started_at",
        "completed_at",
    )


def status_view(jobs: DataFrame) -> DataFrame:
    """The fields that a status request shows for the state of the job."""
    status = F.col("status")
    ended = _ended(status)
    return jobs.select(
        "job_id",
        "status",
        "filename",
        "created_at",
        F.when(status == fv.PROCESSING, F.col("started_at")).alias("started_at"),
        F.when(ended, F.col("completed_at")).alias("completed_at"),
        F.when(status == fv.COMPLETED, F.lit(True)).alias("result_available"),
        F.when(status == fv.FAILED, F.col("error")).alias("error"),
    )


def recent(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest jobs, ties by id, with end time or error where they apply."""
    status = F.col("status")
    shown = jobs.select(
        "job_id",
        "status",
        "filename",
        "created_at",
        F.when(status == fv.COMPLETED, F.col("completed_at")).alias("completed_at"),
        F.when(
            status == fv.FAILED, F.coalesce("error", F.lit(fv.UNKNOWN_ERROR))
        ).alias("error"),
    )
    return shown.orderBy(F.desc("created_at"), "job_id").limit(limit)


def health(jobs: DataFrame) -> DataFrame:
    """Number of jobs, and of those still pending or processing."""
    active = F.col("status").isin(fv.PENDING, fv.PROCESSING)
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(active).alias("active_jobs")
    )


def timing(events: DataFrame) -> DataFrame:
    """Start, end and duration of each job in seconds."""
    status, ts = F.col("status"), F.col("ts")
    spans = events.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.min(F.when(status == fv.PROCESSING, ts)).alias("first_started_at"),
        F.max(F.when(_ended(status), ts)).alias("last_completed_at"),
    )
    micros = _micros(F.col("last_completed_at")) - _micros(F.col("first_started_at"))
    return spans.withColumn("duration_ms", F.floor(micros / 1000))


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def without_deleted(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Jobs that are not in the table of deleted ids."""
    return jobs.join(deleted.select("job_id").distinct(), "job_id", "left_anti")


def deleted_jobs(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """What a deletion reports: each deleted job with its state, or not found."""
    wanted = deleted.select("job_id").distinct()
    states = jobs.select("job_id", "filename", "status")
    return wanted.join(states, "job_id", "left").withColumn("found", F.col("status").isNotNull())


def results(jobs: DataFrame, extracted: DataFrame) -> DataFrame:
    """Results of the completed jobs next to the job data."""
    done = jobs.where(F.col("status") == fv.COMPLETED).select(
        "job_id", "filename", "file_size_mb", "created_at", "completed_at"
    )
    return extracted.join(done, "job_id", "inner")
