"""The keyed job state: equal to the batch, bounded by open jobs, late events."""

import datetime

import pytest

from ledgerloom.catalog import inputs as inp
from ledgerloom.operators import jobs as batch_jobs
from ledgerloom.streaming import job_table

KIND = "event_id BIGINT, job_id BIGINT, ts TIMESTAMP_NTZ, status STRING, filename STRING, size_bytes BIGINT, error STRING"
START = datetime.datetime(2024, 5, 1)


def event(number, job, hours, status, error=None):
    return (number, job, START + datetime.timedelta(hours=hours), status, f"{job}.pdf", 1, error)


class Feed:
    """A folder that events are put into, and the stream that follows it."""

    def __init__(self, spark, folder, lateness):
        self.spark, self.lateness = spark, lateness
        self.source, self.ended, self.checkpoint = (f"{folder}/{n}" for n in ("in", "ended", "checkpoint"))
        self.events = []

    def put(self, *events):
        self.events += events
        self.frame(events).coalesce(1).write.mode("append").parquet(self.source)
        return self.run()

    def frame(self, events):
        return self.spark.createDataFrame(list(events), KIND)

    def run(self):
        arriving = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", "1").parquet(self.source)
        query = job_table.start(arriving, self.ended, self.checkpoint, self.lateness)
        query.awaitTermination()
        return query

    def open(self):
        return sorted(r.job_id for r in job_table.open_states(self.spark, self.checkpoint).collect())

    def written(self):
        return sorted(r.job_id for r in self.spark.read.parquet(self.ended).collect())

    def current(self):
        return sorted(map(tuple, job_table.current(self.spark, self.ended, self.checkpoint).collect()))

    def batch(self, events=None):
        return sorted(map(tuple, batch_jobs.latest(self.frame(events or self.events)).collect()))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path, "2 hours")


def test_ended_jobs_leave_the_state(feed):
    feed.put(event(1, 1, 0, "PENDING"), event(2, 2, 0, "PENDING"), event(3, 3, 1, "PROCESSING"))
    feed.put(event(4, 1, 2, "COMPLETED"), event(5, 2, 2, "FAILED", "broken"), event(6, 4, 9, "PENDING"))
    assert feed.current() == feed.batch()
    assert feed.open() == [3, 4] and feed.written() == [1, 2]
    feed.put(*[event(100 + j, j, 20 + j, "COMPLETED") for j in range(10, 60)])
    feed.put(event(200, 5, 100, "PENDING"))
    assert feed.open() == [3, 4, 5] and len(feed.written()) == 52
    assert feed.current() == feed.batch()
    feed.run()  # nothing new: nothing is written twice
    assert len(feed.written()) == 52 and feed.current() == feed.batch()


def test_late_events_in_time_lose_and_later_ones_are_dropped(feed):
    feed.put(event(1, 1, 10, "COMPLETED"), event(2, 2, 10, "PROCESSING"))
    # An hour late: taken, and older than what is known.
    query = feed.put(event(3, 1, 9, "PROCESSING"), event(4, 2, 9, "PENDING"), event(5, 3, 9, "PENDING"))
    assert job_table.dropped(query) == 0
    assert feed.current() == feed.batch() and [r[1] for r in feed.current()] == ["COMPLETED", "PROCESSING", "PENDING"]
    known = list(feed.events)
    feed.put(event(6, 9, 30, "PENDING"))
    query = feed.put(event(7, 1, 11, "FAILED", "too late"), event(8, 2, 12, "FAILED", "too late"))
    assert job_table.dropped(query) == 2
    assert feed.current() == feed.batch([*known, event(6, 9, 30, "PENDING")])


def test_a_job_that_goes_on_after_it_ended_has_one_state(feed):
    feed.put(event(1, 1, 0, "COMPLETED"), event(2, 2, 50, "PENDING"))
    assert feed.written() == [1]
    feed.put(event(3, 1, 51, "PROCESSING"))
    assert feed.open() == [1, 2] and feed.current() == feed.batch()


def test_ties_in_time_go_by_event(feed):
    feed.put(event(2, 1, 0, "COMPLETED"), event(1, 1, 0, "PENDING"), event(3, 2, 0, "PENDING"), event(4, 2, 0, "FAILED"))
    assert feed.current() == feed.batch()


def test_one_job_with_many_events(spark, feed):
    feed.put(*[event(n, 7, n / 1000, "PROCESSING") for n in range(3000)], event(5000, 8, 3, "PENDING"))
    assert feed.current() == feed.batch() and feed.open() == [7, 8]


def test_equals_the_batch_on_the_event_table(spark, small, tmp_path):
    events = inp.job_events(spark, small)
    feed = Feed(spark, tmp_path, "1 hour")
    ordered = events.orderBy("ts", "event_id").collect()
    step = -(-len(ordered) // 3)
    for at in range(0, len(ordered), step):
        feed.frame(ordered[at : at + step]).select(*[f.split()[0] for f in KIND.split(", ")]).coalesce(
            1
        ).write.mode("append").parquet(feed.source)
        feed.run()
    assert feed.current() == sorted(map(tuple, batch_jobs.latest(events).collect()))
    ended = {r[0] for r in feed.current() if r[1] in ("COMPLETED", "FAILED")}
    newest = max(r.ts for r in ordered)
    late = {r[0] for r in feed.current() if r[3] >= newest - datetime.timedelta(hours=1)}
    assert set(feed.open()) & ended <= late
