"""Streams give the batch result, and restarts change nothing."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.catalog import inputs as inp
from ledgerloom.operators import jobs as batch_jobs
from ledgerloom.plans import invoices
from ledgerloom.schemas import Settings
from ledgerloom.streaming import intake, jobs, ledger

DAY = datetime.date(2024, 1, 1)


def same(left, right):
    left, right = left.drop("fecha_registro"), right.drop("fecha_registro")
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_intake_judges_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        intake.start(
            spark, str(folder), out, checkpoint, Settings(max_size_mb=1), files_per_batch=2
        ).awaitTermination()
        intake.judge_empty(spark, str(folder), out, Settings(max_size_mb=1))
        return {r.filename: r.code for r in intake.verdicts(spark, out).collect()}

    for i in range(5):
        (folder / f"{i}.pdf").write_bytes(b"%PDF" if i % 2 else b"no")
    assert run() == {"0.pdf": 400, "1.pdf": None, "2.pdf": 400, "3.pdf": None, "4.pdf": 400}
    (folder / "late.txt").write_bytes(b"%PDF")
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "huge.pdf").write_bytes(b"%PDF" + b"x" * (2 << 20))
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, str(1 << 20))  # opening the huge file would fail
    try:
        got = run()
        assert len(got) == 8 and got["empty.pdf"] == 400 and got["huge.pdf"] == 413
        assert len(run()) == 8 and intake.verdicts(spark, out).count() == 8
    finally:
        spark.conf.unset(limit)


def test_job_states_equal_the_batch(spark, small, tmp_path):
    events = inp.job_events(spark, small)
    source = str(tmp_path / "events")
    out, checkpoint = str(tmp_path / "states"), str(tmp_path / "checkpoint")
    # Late events: the second part holds the earlier half of the time range.
    middle = events.approxQuantile("event_id", [0.5], 0.0)[0]
    for part in (events.where(F.col("event_id") > middle), events.where(F.col("event_id") <= middle)):
        part.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(source)
        jobs.start(arriving, out, checkpoint).awaitTermination()
    assert same(jobs.current(spark, out), batch_jobs.latest(events))
    rows = spark.read.parquet(out).count()
    jobs.start(arriving, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == rows
    compacted = str(tmp_path / "compacted")
    jobs.compact(spark, out, compacted)
    assert same(jobs.current(spark, compacted), batch_jobs.latest(events))
    assert spark.read.parquet(compacted).count() == batch_jobs.latest(events).count() <= rows


def test_reply_intake_is_idempotent(spark, small, tmp_path):
    replies = inp.replies(spark, small).select("doc_id", "content", "total_tokens")
    source, path = str(tmp_path / "replies"), str(tmp_path / "ledger")
    replies.repartition(3).write.parquet(source)
    expected = invoices.to_ledger(replies, DAY)

    def run(checkpoint):
        arriving = (
            spark.readStream.schema(replies.schema).option("maxFilesPerTrigger", "1").parquet(source)
        )
        ledger.start(arriving, path, str(tmp_path / checkpoint), DAY).awaitTermination()
        return spark.read.parquet(path)

    assert same(run("first"), expected)
    assert same(run("first"), expected)
    # A lost checkpoint delivers everything again, and a key sent twice stays single.
    assert same(run("second"), expected)
    replies.where("doc_id < 5").write.mode("append").parquet(source)
    assert same(run("first"), expected)


def test_accepted_reply_wins_over_a_rejected_one(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = spark.createDataFrame(
        [(1, "", 1), (1, '{"moneda":"PEN"}', 2), (1, "zzz", 3), (2, "bad", 1)],
        "doc_id BIGINT, content STRING, total_tokens BIGINT",
    )
    ledger.append_new(batch, path, DAY)
    rows = spark.read.parquet(path).collect()
    assert [(r.id, r.moneda) for r in rows] == [(1, "PEN")]
