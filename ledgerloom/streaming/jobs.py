"""Current state per job from a stream of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import jobs


def start(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the last state of each job of each batch, then stop at the end of the input.

    No state is kept between batches, so it cannot grow: a batch leaves its own last
    event of a job, and ``current`` takes the newest of what all batches left.  Late
    events lose there, and a repeated batch adds rows that change nothing.
    """

    def save(arrived: DataFrame, _: int) -> None:
        jobs.latest(arrived).write.mode("append").parquet(out)

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, out: str, into: str) -> None:
    """Write one row per job to a new folder, for readers to go on from.

    Start the stream with the new folder afterwards; the old one can be removed when
    no reader uses it.
    """
    current(spark, out).write.mode("errorifexists").parquet(into)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest written state of each job."""
    written = spark.read.parquet(out)
    last = F.max_by(F.struct("status", "error", "ts", "event_id"), F.struct("ts", "event_id"))
    return written.groupBy("job_id").agg(last.alias("last")).select("job_id", "last.*")
