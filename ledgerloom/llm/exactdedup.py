"""Exact duplicates by sorting content.

Texts are range-partitioned by sampled splitters and sorted, so that equal texts lie
next to each other; whole texts of neighbours are compared, and one row of each run
of equals stays.  Range and order go by the first characters, the digest and the id:
splitters are short however long texts are, and a text that fills many partitions is
cut by id.  Runs that go on in the next partition are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import release, saved, text_of

#: Characters of a text that lead the sort key.
HEAD = 32


def duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    largest: bool = False,
) -> DataFrame:
    """One row per row of `docs`: `doc_id, keep_id, group_size, kept, text_sha256`.

    Rows are equal when their texts are after `normalise` (none: as they are); null is
    the empty text.  Of equal rows the one with the least id stays, or with `largest`
    the greatest; rows without an id come last, and of rows that agree in id as well
    exactly one stays.  A group without any id has a null `keep_id`.  Other columns are
    not read.  An empty table gives an empty result.

    Texts are shuffled once.  The driver sees two numbers per sorted partition.
    """
    spark = docs.sparkSession
    rows = saved(_numbered(docs, id_column, text, normalise, largest), "dedup-rows", compression="zstd")
    data, edges = rows.filter("not edge"), rows.filter("edge")
    best = F.max("doc_id") if largest else F.min("doc_id")
    runs = data.groupBy("part", "run").agg(F.count("*").alias("size"), best.alias("best"))
    moved = spark.createDataFrame(
        _continued(edges), "part int, run long, head_part int, head_run long"
    )
    placed = runs.join(moved, ["part", "run"], "left").select(
        "part",
        "run",
        "size",
        "best",
        F.coalesce("head_part", "part").alias("head_part"),
        F.coalesce("head_run", "run").alias("head_run"),
    )
    total = F.max("best") if largest else F.min("best")
    groups = placed.groupBy("head_part", "head_run").agg(
        F.sum("size").alias("group_size"), total.alias("keep_id")
    )
    # A run lies in one partition, so no key of this join holds more rows than one task had.
    whole = placed.join(groups, ["head_part", "head_run"]).select(
        "part",
        "run",
        ((F.col("head_part") == F.col("part")) & (F.col("head_run") == F.col("run"))).alias("head"),
        "group_size",
        "keep_id",
    )
    return data.join(whole, ["part", "run"]).select(
        "doc_id", "keep_id", "group_size", (F.col("first") & F.col("head")).alias("kept"), "text_sha256"
    )


def _numbered(docs, id_column, text, normalise, largest) -> DataFrame:
    """Rows with the partition and the run of equal texts that they lie in."""
    value = text_of(text)
    value = text_of(normalise(value)) if normalise else value
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), value.alias("text"))
    number = F.desc_nulls_last("doc_id") if largest else F.asc_nulls_last("doc_id")
    keyed = rows.select(
        "doc_id",
        F.substring("text", 1, HEAD).alias("head"),
        F.sha2("text", 256).alias("text_sha256"),
        F.col("text").cast("binary").alias("content"),
    )
    ordered = keyed.repartitionByRange("head", "text_sha256", number).sortWithinPartitions(
        "head", "text_sha256", "content", number
    )
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return ordered.select("doc_id", "text_sha256", "content").mapInArrow(
        _runs,
        f"part int, run long, first boolean, doc_id {kind}, text_sha256 string, "
        "edge boolean, first_text binary, last_text binary",
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; at the end one row with both outer texts."""
    names = ["part", "run", "first", "doc_id", "text_sha256", "edge", "first_text", "last_text"]
    part, run, first, last, kind = TaskContext.get().partitionId(), -1, None, None, pa.int64()

    def out(count, runs, starts, ids, digests, edge, outer):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(count, part, np.int32)),
                pa.array(runs, pa.int64()),
                pa.array(starts, pa.bool_()),
                ids,
                digests,
                pa.array([edge] * count),
                *[pa.array([text] * count, pa.binary()) for text in outer],
            ],
            names,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, kind = batch.column("content"), batch.column("doc_id").type
        starts = np.ones(batch.num_rows, bool)
        starts[1:] = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        before, end = texts[0].as_py(), texts[-1].as_py()
        starts[0] = last is None or before != last
        runs = run + np.cumsum(starts)
        first, last, run = before if first is None else first, end, int(runs[-1])
        yield out(
            batch.num_rows, runs, starts, batch.column("doc_id"), batch.column("text_sha256"), False, (None, None)
        )
        del texts, batch
        release()
    if last is not None:
        nothing = pa.nulls(1, kind), pa.nulls(1, pa.string())
        yield out(1, [run], [False], *nothing, True, (first, last))


def _continued(edges: DataFrame) -> list[tuple[int, int, int, int]]:
    """First runs that go on from an earlier partition, with the run where they begin.

    The outer texts of neighbouring partitions are compared in tasks.  The list has an
    entry at most for each partition of the sort.
    """
    spark = edges.sparkSession
    last_run = {r["part"]: r["run"] for r in edges.select("part", "run").collect()}
    parts = sorted(last_run)
    if len(parts) < 2:
        return []
    after = spark.createDataFrame(list(zip(parts, parts[1:])), "part int, next int")
    nearby = (
        after.join(edges.select("part", "last_text"), "part")
        .join(edges.select(F.col("part").alias("next"), "first_text"), "next")
        .filter(F.col("last_text") == F.col("first_text"))
    )
    joined = {r["next"]: r["part"] for r in nearby.select("part", "next").collect()}
    heads: dict[int, tuple[int, int]] = {}
    for part in parts:
        if part in joined:
            before = joined[part]
            own = before, last_run[before]
            heads[part] = heads.get(before, own) if last_run[before] == 0 else own
    return [(part, 0, *head) for part, head in heads.items()]


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Ids of the rows that stay, with the size of their group."""
    return duplicates(docs, **options).filter("kept").select("doc_id", "group_size", "text_sha256")
