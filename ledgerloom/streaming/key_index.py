"""Which keys a ledger holds, answered without reading the ledger.

Keys are dealt over hash buckets.  Each bucket has its keys and a Bloom filter of them
with a fixed number of 64-bit words; a key sets four bits of one word.  A batch reads the
filters of its own buckets and opens the keys of a bucket only where a filter hits.  What
a batch of new keys reads is therefore bounded by the size of the filters and does not
follow the ledger.

    index/layout          number of buckets and words
    index/filters/bucket= words of the bucket's filter
    index/keys/bucket=    keys of the bucket
    index/pending/<name>  rows on their way into the ledger
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import folders


@dataclass(frozen=True)
class Layout:
    """Buckets, and 64-bit words of a bucket's filter.

    At four keys a word about one new key in 300 opens a bucket for nothing; choose
    buckets times words as a quarter of the keys that are expected.
    """

    buckets: int = 32
    words: int = 32768


def _placed(keys: DataFrame, layout: Layout) -> DataFrame:
    """Keys with their bucket, their word and the bits they set in it."""
    spread = F.xxhash64(F.col("id"), F.lit(2))
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(spread, {6 * i}) & 63 as int))") for i in range(4)]
    mask: Column = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return keys.select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(layout.buckets)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(layout.words)).cast("int").alias("word"),
        spread.alias("spread"),
    ).select("id", "bucket", "word", mask.alias("mask"))


class KeyIndex:
    """The keys of the ledger at ``path``, kept below ``index``."""

    def __init__(self, spark: SparkSession, path: str, index: str | None = None, layout: Layout = Layout()):
        self.spark, self.path = spark, path
        self.index = index or f"{path.rstrip('/')}-keys"
        self.layout = self._stored_layout(layout)

    def _stored_layout(self, wanted: Layout) -> Layout:
        """The layout the index was made with; a new index covers the ledger as it is."""
        place = f"{self.index}/layout"
        if folders.complete(self.spark, place):
            row = self.spark.read.parquet(place).first()
            return Layout(row["buckets"], row["words"])
        self.layout = wanted
        for part in ("filters", "keys", "pending"):
            folders.remove(self.spark, f"{self.index}/{part}")
        held = self._ledger_keys()
        if held is not None:
            self.add(held)
        row = [(wanted.buckets, wanted.words)]
        self.spark.createDataFrame(row, "buckets INT, words INT").coalesce(1).write.mode(
            "overwrite"
        ).parquet(place)
        return wanted

    def _ledger_keys(self) -> DataFrame | None:
        if not any(not name.startswith(("_", ".")) for name in folders.names(self.spark, self.path)):
            return None
        return self.spark.read.parquet(self.path).select("id").distinct()

    def _tables(self, part: str, buckets: set[int]) -> DataFrame | None:
        """One part of the index for the given buckets; no other folder is listed or read."""
        there = set(folders.names(self.spark, f"{self.index}/{part}"))
        own = [f"{self.index}/{part}/bucket={b}" for b in sorted(buckets) if f"bucket={b}" in there]
        if not own:
            return None
        return self.spark.read.option("basePath", f"{self.index}/{part}").parquet(*own)

    def possible(self, keys: DataFrame) -> DataFrame | None:
        """Keys whose bits are all set, with their bucket; None if no filter is there."""
        if not folders.names(self.spark, f"{self.index}/filters"):
            return None
        placed = _placed(keys, self.layout)
        filters = self._tables("filters", _buckets(placed))
        if filters is None:
            return None
        hit = F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")
        return placed.join(filters, ["bucket", "word"]).where(hit).select("id", "bucket").distinct()

    def known(self, keys: DataFrame) -> DataFrame | None:
        """Those of the distinct keys ``id`` that the ledger holds; None if there are none.

        The driver sees the numbers of the buckets, of which there is a fixed number.
        """
        possible = self.possible(keys)
        if possible is None:
            return None
        held = self._tables("keys", _buckets(possible))
        if held is None:
            return None
        return possible.select("id").join(held.select("id"), "id", "left_semi")

    def add(self, keys: DataFrame) -> None:
        """Put keys of the ledger into their buckets; adding a key again changes no answer.

        The filter of a bucket is written anew, then its older files go.  Older files hold
        a part of the newer one's bits, so a run that ends in between does no harm.
        """
        placed = _placed(keys, self.layout)
        buckets = _buckets(placed)
        if not buckets:
            return
        placed.select("id", "bucket").repartition("bucket").write.mode("append").partitionBy(
            "bucket"
        ).parquet(f"{self.index}/keys")
        words = placed.select("bucket", "word", F.col("mask").alias("bits"))
        older = self._tables("filters", buckets)
        if older is not None:
            words = words.unionByName(older.select("bucket", "word", "bits"))
        before = {
            f"{self.index}/filters/bucket={b}/{name}"
            for b in buckets
            for name in folders.names(self.spark, f"{self.index}/filters/bucket={b}")
        }
        words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits")).repartition(
            "bucket"
        ).write.mode("append").partitionBy("bucket").parquet(f"{self.index}/filters")
        for name in before:
            folders.remove(self.spark, name)

    def append(self, rows: DataFrame) -> None:
        """Append rows with new keys to the ledger and the index.

        The rows are first written aside.  A run that ends before they are in both places
        is finished by ``repair``, so no row is lost and none is there twice.
        """
        place = f"{self.index}/pending/{uuid.uuid4().hex}"
        rows.write.parquet(place)
        waiting = self.spark.read.schema(rows.schema).parquet(place)
        waiting.write.mode("append").parquet(self.path)
        self.add(waiting.select("id"))
        folders.remove(self.spark, place)

    def repair(self) -> None:
        """Finish what an earlier run left; only then is the ledger's key column read."""
        for name in folders.names(self.spark, f"{self.index}/pending"):
            place = f"{self.index}/pending/{name}"
            if folders.complete(self.spark, place):
                waiting = self.spark.read.parquet(place)
                held = self._ledger_keys()
                left = waiting if held is None else waiting.join(held, "id", "left_anti")
                left.write.mode("append").parquet(self.path)
                self.add(waiting.select("id"))
            folders.remove(self.spark, place)


def _buckets(placed: DataFrame) -> set[int]:
    return {row["bucket"] for row in placed.select("bucket").distinct().collect()}
