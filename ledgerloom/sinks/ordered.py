"""The ledger in list order with a directory of its files, for direct access to any page.

Rows are range-partitioned by time, newest first, and id, and each part is cut into files in
that order.  The directory has one row a file: its first and last key, its rows, and how many
rows lie before it.  A page opens the files that hold it and sorts their rows only, however
deep it lies.

    path/rows-<name>       files in list order
    path/directory-<nnn>   the directory; the last complete one counts
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import folders

#: Rows of a file, by which a page is sorted at most twice over.
ROWS_PER_FILE = 100_000
#: A task writes so many files, as long as they have so many rows at most.  Each task sends samples
#: and its result to the driver, so small files take no task each.
FILES_PER_TASK, ROWS_PER_TASK = 100, 500_000

_ORDER = ("fecha_registro", "id")


def write(headers: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the ledger in list order with a new directory; readers see it when it is whole."""
    _publish(headers.sparkSession, path, _written(headers, path, rows_per_file), None)


def append(headers: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Add rows to the ledger.

    Rows that are all newer than what is stored become files in front of the others.  Any
    older or equally old row has its place between stored ones, so then all is written anew.
    """
    spark = headers.sparkSession
    known = directory(spark, path)
    if known is None:
        write(headers, path, rows_per_file)
        return
    oldest = headers.agg(F.min("fecha_registro"), F.count("*"), F.count("fecha_registro")).first()
    newest = known.agg(F.max("first.fecha_registro")).first()[0]
    if not oldest[1]:
        return
    in_front = oldest[1] == oldest[2] and (newest is None or oldest[0] > newest)
    if in_front:
        _publish(spark, path, _written(headers, path, rows_per_file), known)
    else:
        stored = _rows(spark, known)
        write(stored.unionByName(headers.select(*stored.columns)), path, rows_per_file)


def _written(headers: DataFrame, path: str, rows_per_file: int) -> str:
    place = f"{path}/rows-{uuid.uuid4().hex}"
    rows_per_task = max(rows_per_file, min(ROWS_PER_TASK, FILES_PER_TASK * rows_per_file))
    tasks = max(1, -(-headers.count() // rows_per_task))
    order = (F.desc_nulls_last("fecha_registro"), F.asc("id"))
    ordered = headers.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(place)
    return place


def _publish(spark: SparkSession, path: str, place: str, known: DataFrame | None) -> None:
    """Write the directory of new files and the known ones; one row a file throughout."""
    key = F.struct(*_ORDER)
    place_in_list = F.struct(
        F.col("fecha_registro").isNull().alias("undated"),
        (-F.unix_micros(F.col("fecha_registro").cast("timestamp"))).alias("back"),
        F.col("id"),
    )
    files = (
        spark.read.parquet(place)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(
            F.count("*").alias("rows"),
            F.min_by(key, place_in_list).alias("first"),
            F.max_by(key, place_in_list).alias("last"),
            F.min(place_in_list).alias("at"),
        )
    )
    if known is not None:
        files = files.unionByName(known.drop("before"))
    # As many rows as there are files, so one task may put them in order.
    earlier = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbers = [int(n.removeprefix("directory-")) for n in folders.names(spark, path) if n.startswith("directory-")]
    files.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).coalesce(1).write.parquet(
        f"{path}/directory-{max(numbers, default=0) + 1:06d}"
    )


def directory(spark: SparkSession, path: str) -> DataFrame | None:
    """``file, rows, first, last, at, before`` of the newest complete directory."""
    places = [f"{path}/{n}" for n in folders.names(spark, path) if n.startswith("directory-")]
    whole = [place for place in places if folders.complete(spark, place)]
    return spark.read.parquet(whole[-1]) if whole else None


def _rows(spark: SparkSession, known: DataFrame) -> DataFrame:
    return spark.read.parquet(*[r["file"] for r in known.select("file").collect()])


def page(spark: SparkSession, path: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest headers first: skip ``offset``, keep ``limit``; ties by id, undated last.

    The directory names the files that hold these rows: one, or two where the page lies
    on a border, as long as a file has at least ``limit`` rows.  The last file of a task may
    have fewer, and a page across it opens three.
    """
    known = directory(spark, path)
    if known is None:
        raise ValueError(f"no ordered ledger at {path}")
    holds = (F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)
    own = known.where(holds).orderBy("before").select("file", "before").collect()
    if not own:
        return spark.read.parquet(known.select("file").first()["file"]).limit(0)
    rows = spark.read.parquet(*[r["file"] for r in own])
    ordered = rows.orderBy(F.desc_nulls_last("fecha_registro"), "id")
    return ordered.offset(offset - own[0]["before"]).limit(limit)


def clean(spark: SparkSession, path: str) -> None:
    """Remove files and directories that the newest directory does not name."""
    known = directory(spark, path)
    if known is None:
        return
    used = {r["file"].rstrip("/").split("/")[-2] for r in known.select("file").collect()}
    last = max(
        n for n in folders.names(spark, path) if n.startswith("directory-") and folders.complete(spark, f"{path}/{n}")
    )
    for name in folders.names(spark, path):
        if (name.startswith("rows-") and name not in used) or (name.startswith("directory-") and name < last):
            folders.remove(spark, f"{path}/{name}")
