"""The key index beside the ledger: answers, what is read, and runs that end early."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom import folders
from ledgerloom.catalog import inputs as inp
from ledgerloom.sinks import tables
from ledgerloom.plans import invoices
from ledgerloom.streaming import ledger
from ledgerloom.streaming.key_index import KeyIndex, Layout

DAY = datetime.date(2024, 1, 1)
LAYOUT = Layout(8, 512)


def rows(spark, first, last):
    return spark.range(first, last).withColumn("v", F.col("id") * 2)


def ids(frame):
    return set() if frame is None else {r[0] for r in frame.select("id").collect()}


def test_answers(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "ledger"), layout=LAYOUT)
    assert index.known(spark.range(5)) is None
    index.append(rows(spark, 0, 1000))
    index.append(rows(spark, 3000, 3500))
    again = KeyIndex(spark, str(tmp_path / "ledger"))
    assert again.layout == LAYOUT
    assert ids(again.known(spark.range(900, 3100))) == set(range(900, 1000)) | set(range(3000, 3100))
    assert ids(again.known(spark.range(10_000, 10_100))) == set()


def test_text_keys_and_no_keys(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "ledger"), layout=LAYOUT)
    index.append(spark.range(300).select(F.concat(F.lit("k"), "id").alias("id")))
    index.append(spark.createDataFrame([], "id STRING"))
    asked = spark.createDataFrame([("k7",), ("k300",), ("",)], "id STRING")
    assert ids(index.known(asked)) == {"k7"}
    assert index.known(spark.createDataFrame([], "id STRING")) is None


def bytes_read(frame):
    return sum(len(open(name.removeprefix("file://").removeprefix("file:"), "rb").read()) for name in frame.inputFiles())


def test_what_a_batch_of_new_keys_reads_does_not_follow_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    index = KeyIndex(spark, path, layout=Layout(8, 1 << 14))
    read, size = [], []
    for first, last in ((0, 200_000), (200_000, 400_000), (400_000, 800_000)):
        index.append(rows(spark, first, last))
        possible = index.possible(spark.range(10**7 + first, 10**7 + first + 50))
        assert all("-keys/filters/" in name for name in possible.inputFiles())
        read.append(bytes_read(possible))
        size.append(folders.size(spark, path))
    assert size[-1] > 3.5 * size[0] and read[-1] < 2 * read[0]
    assert read[-1] <= 8 * (1 << 14) * 13  # a word of 8 bytes, its number of 4 and a little more
    # Few keys open few buckets.
    one = index.possible(spark.range(10**9, 10**9 + 1))
    assert len({name.split("bucket=")[1].split("/")[0] for name in one.inputFiles()}) == 1


def test_filters_are_replaced_not_piled_up(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "ledger"), layout=LAYOUT)
    for turn in range(4):
        index.append(rows(spark, 100 * turn, 100 * turn + 100))
    for name in folders.names(spark, f"{index.index}/filters"):
        if name.startswith("bucket="):
            files = [f for f in folders.names(spark, f"{index.index}/filters/{name}") if f.startswith("part")]
            assert len(files) == 1
    assert folders.names(spark, f"{index.index}/pending") == []


@pytest.mark.parametrize("written", ["aside", "ledger", "part of the ledger"])
def test_a_run_that_ended_early_is_finished(spark, tmp_path, written):
    path = str(tmp_path / "ledger")
    index = KeyIndex(spark, path, layout=LAYOUT)
    index.append(rows(spark, 0, 100))
    rows(spark, 100, 200).write.parquet(f"{index.index}/pending/left")
    rows(spark, 500, 600).write.parquet(f"{index.index}/pending/torn")
    folders.remove(spark, f"{index.index}/pending/torn/_SUCCESS")
    if written != "aside":
        rows(spark, 100, 200 if written == "ledger" else 150).write.mode("append").parquet(path)
    again = KeyIndex(spark, path)
    again.repair()
    assert sorted(r[0] for r in spark.read.parquet(path).select("id").collect()) == list(range(200))
    assert ids(again.known(spark.range(0, 700))) == set(range(200))
    assert folders.names(spark, f"{index.index}/pending") == []


def test_a_ledger_without_an_index_gets_one(spark, small, tmp_path):
    path = str(tmp_path / "ledger")
    replies = inp.replies(spark, small).select("doc_id", "content", "total_tokens")
    tables.append_ledger(invoices.to_ledger(replies.where("doc_id % 2 = 0"), DAY), path)
    ledger.append_new(replies, path, DAY)
    ledger.append_new(replies, path, DAY)
    got = sorted(r[0] for r in spark.read.parquet(path).select("id").collect())
    assert got == sorted(r[0] for r in invoices.to_ledger(replies, DAY).select("id").collect())


def test_a_rejected_reply_does_not_block_a_later_one(spark, tmp_path):
    path = str(tmp_path / "ledger")
    kind = "doc_id BIGINT, content STRING, total_tokens BIGINT"
    ledger.append_new(spark.createDataFrame([(1, "no", 1), (2, '{"moneda":"PEN"}', 1)], kind), path, DAY)
    ledger.append_new(spark.createDataFrame([(1, '{"moneda":"USD"}', 1), (2, '{"moneda":"USD"}', 1)], kind), path, DAY)
    assert sorted((r.id, r.moneda) for r in spark.read.parquet(path).collect()) == [(1, "USD"), (2, "PEN")]
