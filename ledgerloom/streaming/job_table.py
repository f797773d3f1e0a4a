"""Current state per job, kept by key while the job is open.

The state store holds the last event of each job that has not ended, and of jobs that
ended so recently that an event in time may still come.  A job that leaves the state
store is written once, so a status is one row in one of two places, both of which a
reader can ask for a single job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom import folders
from ledgerloom import fixed_values as fv
from ledgerloom.operators import jobs

#: How much older than the newest event an event may arrive.
LATENESS = "1 day"

_STATE = "status STRING, error STRING, ts_us BIGINT, event_id BIGINT"
_ENDED = (fv.COMPLETED, fv.FAILED)


def _last_of_task(batches: Iterator) -> Iterator:
    """The last event of each job among those of an Arrow batch."""
    for events in batches:
        ordered = events.sort_values(["ts_us", "event_id"], na_position="first")
        yield ordered.drop_duplicates("job_id", keep="last")


def _step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
    """Keep the last event of a job; hand it out when the job leaves the state."""
    import pandas as pd

    if state.hasTimedOut:
        last = state.get
        state.remove()
        yield pd.DataFrame([(*key, *last)], columns=["job_id", "status", "error", "ts_us", "event_id"])
        return
    last = state.get if state.exists else None
    for events in batches:
        for status, error, at, number in zip(
            events["status"], events["error"], events["ts_us"], events["event_id"]
        ):
            if last is None or (at, number) > (last[2], last[3]):
                last = (
                    None if pd.isna(status) else status,
                    None if pd.isna(error) else error,
                    int(at),
                    int(number),
                )
    state.update(last)
    if last[0] in _ENDED:
        # Once the watermark is past the last event, no older one can come in time.
        state.setTimeoutTimestamp(max(last[2] // 1000, state.getCurrentWatermarkMs()) + 1)


def start(events: DataFrame, ended: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Follow a stream of job events to the end of its input, then stop.

    Every task first reduces the events of a job to the last one, so a job with very many
    events reaches the keyed state as one row per task and Arrow batch.  Jobs that ended
    more than ``lateness`` before the newest event are appended to the table ``ended`` and
    leave the state, whose size follows the number of open jobs.

    An event that is older than the newest one by more than ``lateness`` when it arrives
    is dropped and counted in the query's progress (``dropped``); such events need
    ``streaming.jobs``, which takes events of any age.  ``event_id`` and ``ts`` are set.
    """
    number = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    chosen = events.select("job_id", "status", "error", number, "event_id")
    key = chosen.schema["job_id"].dataType.simpleString()
    reduced = chosen.mapInPandas(
        _last_of_task, f"job_id {key}, status STRING, error STRING, ts_us BIGINT, event_id BIGINT"
    )
    followed = (
        reduced.withColumn("at", F.timestamp_micros("ts_us"))
        .withWatermark("at", lateness)
        .groupBy("job_id")
        .applyInPandasWithState(
            _step,
            f"job_id {key}, {_STATE}",
            _STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return (
        followed.writeStream.format("parquet")
        .outputMode("append")
        .option("path", ended)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late, in the batches whose progress is still known."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )


def open_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last event of each job in the state store, as of the last finished batch."""
    stored = spark.read.format("statestore").load(checkpoint)
    return _timed(stored.select("key.job_id", "value.groupState.*"))


def _timed(states: DataFrame) -> DataFrame:
    at = F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts")
    return states.select("job_id", "status", "error", at, "event_id")


def current(spark: SparkSession, ended: str, checkpoint: str) -> DataFrame:
    """The state of each job: of open ones from the state store, of others as written.

    A job that went on after it had left the state is in both places; its newest event
    counts.
    """
    states = open_states(spark, checkpoint)
    if folders.exists(spark, ended):
        states = states.unionByName(_timed(spark.read.parquet(ended)))
    return jobs.latest(states)
