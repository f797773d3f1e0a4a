"""Fixity audit of WARC replicas by Merkle trees.

Records are hashed; hashes of ordered offset ranges are hashed again, range by range,
up to one root.  Two replicas compare roots and then only the children of ranges that
differ, so that an audit of sound copies reads a few rows and a fault is found in as
many steps as the tree is high.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved

#: Bits of a place within a volume, of the smallest range, and of each further level.
VOLUME_BITS, RANGE_BITS, LEVEL_BITS = 26, 16, 4
#: Capture time of pages that have none.
CAPTURED = "1970-01-01T00:00:00Z"
#: Characters that stand in a URI as they are.
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_URI = ":/?#[]@!$&'()*+,;=%~-._"


def record(page_id: object, url: str | None, html: str | None, date: str = CAPTURED) -> bytes:
    """A page as a WARC resource record: its text alone, without the head of a response.

    Characters that a URI can't hold are quoted, a URL without a scheme becomes a URN, and a
    page without a URL is named by its id.
    """
    body = (html or "").encode()
    target = quote(url, safe=_URI) if url else f"urn:page:{quote(str(page_id), safe='')}"
    if not _SCHEME.match(target):
        target = f"urn:url:{target}"
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {target}")
    head = (
        "WARC/1.0\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{own}>\r\n"
        f"WARC-Date: {date}\r\n"
        f"WARC-Target-URI: {target}\r\n"
        f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def archive(
    pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", date: str = CAPTURED
) -> DataFrame:
    """Pages as WARC records: `place, volume, offset, page_id, record`.

    `place` is where a record starts among all bytes of the archive.  A volume is a stretch
    of 64 MB of it, and a record belongs to the volume that it starts in.  Records are
    ordered by hashes of their pages, so their places are the same however the pages are
    dealt over files and tasks.  They are shuffled once, in ranges of these hashes; a task
    counts within its range, and the sums of the ranges, one number each, give the rest.
    Nulls are empty texts; repeated pages are records of their own.  `date` is the capture
    time of all records, as the pages have none.  Other columns are not kept.
    """
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{html}`").cast("string").alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"k1": F.xxhash64("page_id", "url", "html"), "k2": F.xxhash64("html", "url", F.lit(1))})
    order = ["k1", "k2", "row"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("page_id", "url", "html")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            records = [record(*page, date) for page in zip(*(c.to_pylist() for c in batch.columns))]
            starts = []
            for own in records:
                starts.append(start)
                start += len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(records), pa.int32()),
                    pa.array(starts, pa.int64()),
                    batch.column(0),
                    pa.array(records, pa.binary()),
                ],
                ["part", "start", "page_id", "record"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    found = saved(
        sorted_.mapInArrow(placed, f"part int, start long, page_id {kind}, record binary"), "fixity-records"
    )
    sums = found.groupBy("part").agg(F.sum(F.length("record").cast("long")).alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    # One row for each partition of the sort, which is what bounds the window and the broadcast.
    at = found.join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("start"))
    return at.select(
        "place",
        F.call_function("shiftright", F.col("place"), F.lit(VOLUME_BITS)).alias("volume"),
        F.col("place").bitwiseAND(F.lit((1 << VOLUME_BITS) - 1)).alias("offset"),
        "page_id",
        "record",
    )


def leaves(replica: DataFrame) -> DataFrame:
    """Hash and length of each record of a replica `(place, record)`, written.

    Records that repeat a place and bytes are one; different bytes at one place are
    hashed together, in order.
    """
    hashed = replica.select(
        "place", F.sha2("record", 256).alias("hash"), F.length("record").cast("long").alias("length")
    ).distinct()
    one = hashed.groupBy("place").agg(
        F.sort_array(F.collect_list(F.struct("hash", "length"))).alias("all")
    )
    return saved(
        one.select(
            "place",
            F.when(F.size("all") == 1, F.col("all")[0]["hash"])
            .otherwise(F.sha2(F.array_join("all.hash", ","), 256))
            .alias("hash"),
            F.col("all")[0]["length"].alias("length"),
        ),
        "fixity-leaves",
    )


def ranges(nodes: DataFrame, bits: int) -> DataFrame:
    """The next level: hashes of the nodes of each range of `2 ** bits` places, in order.

    A node is hashed with its place, so a record that moves counts as changed.
    """
    listed = F.sort_array(F.collect_list(F.struct("place", "hash")))
    text = F.array_join(F.transform(listed, lambda n: F.concat_ws(":", n["place"], n["hash"])), ",")
    return nodes.groupBy(F.call_function("shiftright", F.col("place"), F.lit(bits)).alias("place")).agg(
        F.sha2(text, 256).alias("hash")
    )


def tree(hashes: DataFrame, top: int) -> list[DataFrame]:
    """Levels from the records to the root, whose only place is 0; each is written.

    A range holds what starts in it: at most as many records as fit into 64 KB, and
    sixteen ranges above that.  `top` is the greatest place of any replica.
    """
    levels = [hashes.select("place", "hash")]
    levels.append(saved(ranges(levels[0], RANGE_BITS), "fixity-level"))
    top >>= RANGE_BITS
    while top:
        levels.append(saved(ranges(levels[-1], LEVEL_BITS), "fixity-level"))
        top >>= LEVEL_BITS
    return levels


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """Places whose hashes differ or that one side lacks."""
    a = one.select("place", F.col("hash").alias("a"))
    b = two.select("place", F.col("hash").alias("b"))
    return a.join(b, "place", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("place")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records in which two replicas `(place, record)` differ.

    Columns `place, volume, offset, length, other_length, hash, other_hash, fault`;
    the fault is `changed`, `missing` (in the second) or `added`.  Equal replicas,
    and two empty ones, give an empty result.  A null record has no hash and counts
    as changed where the other has one.
    """
    sides = [leaves(replica) for replica in (one, two)]
    top = max(side.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0] for side in sides)
    trees = [tree(side, top) for side in sides]
    wrong = saved(differing(trees[0][-1], trees[1][-1]), "fixity-wrong")
    for depth in range(len(trees[0]) - 2, -1, -1):
        bits = RANGE_BITS if depth == 0 else LEVEL_BITS
        up = F.call_function("shiftright", F.col("place"), F.lit(bits))
        above = wrong.withColumnRenamed("place", "above")
        below = [t[depth].join(above, up == F.col("above"), "left_semi") for t in trees]
        wrong = saved(differing(*below), "fixity-wrong")
    a, b = (
        side.join(wrong, "place", "left_semi").select(
            "place", F.col("hash").alias(f"hash_{n}"), F.col("length").alias(f"length_{n}")
        )
        for n, side in zip("ab", sides)
    )
    fault = (
        F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "added").otherwise("changed")
    )
    joined = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "place", "full")
    return joined.select(
        "place",
        F.call_function("shiftright", F.col("place"), F.lit(VOLUME_BITS)).alias("volume"),
        F.col("place").bitwiseAND(F.lit((1 << VOLUME_BITS) - 1)).alias("offset"),
        F.col("length_a").alias("length"),
        F.col("length_b").alias("other_length"),
        F.col("hash_a").alias("hash"),
        F.col("hash_b").alias("other_hash"),
        fault.alias("fault"),
    )


def decayed(replica: DataFrame, one_in: int = 100) -> DataFrame:
    """A copy of an archive as it may come back from a failing disk.

    By a hash of its place, one record in `one_in` has a byte set to zero, and one in
    four times as many is lost.
    """
    draw = F.pmod(F.xxhash64(F.lit("decay"), F.col("place")), F.lit(4 * one_in))
    size = F.length("record")
    at = F.pmod(F.xxhash64(F.lit("byte"), F.col("place")), size).cast("int")
    hit = F.concat(
        F.col("record").substr(F.lit(1), at),
        F.unhex(F.lit("00")),
        F.col("record").substr(at + 2, size),
    )
    return replica.filter(draw != 4).withColumn(
        "record", F.when(draw < 4, hit).otherwise(F.col("record"))
    )
