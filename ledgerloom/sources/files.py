"""Landing folders: content scan, metadata scan, full listing, file writer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text as tx
from ledgerloom.schemas import BINARY

PDF_GLOB = "*.[pP][dD][fF]"


def _reader_options(only_pdf: bool) -> dict[str, str]:
    options = {"recursiveFileLookup": "true"}
    if only_pdf:
        options["pathGlobFilter"] = PDF_GLOB
    return options


def scan_files(spark: SparkSession, folder: str, only_pdf: bool = True) -> DataFrame:
    """Every non-empty file with name, size and content.

    Filters on ``length`` reach the scan, and the content of a file is read
    only where ``content`` is used.
    """
    reader = spark.read.format("binaryFile").options(**_reader_options(only_pdf))
    return _described(reader.load(folder))


def scan_file_stream(
    spark: SparkSession, folder: str, only_pdf: bool = True, files_per_batch: int = 100_000
) -> DataFrame:
    """The same as a stream of newly arrived files."""
    reader = spark.readStream.format("binaryFile").schema(BINARY)
    options = {**_reader_options(only_pdf), "maxFilesPerTrigger": str(files_per_batch)}
    return _described(reader.options(**options).load(folder))


def _described(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        tx.base_name(F.col("path")).alias("filename"),
        F.col("length").alias("size_bytes"),
        "modificationTime",
        "content",
        # For a file source the column name is what keeps the pushed filter.
        "length",
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name and size of every file, empty files included, without content.

    The binary file source leaves out files of zero bytes.  One task lists the
    folder itself; its sub-folders are spread over the tasks, and each is listed
    with all that lies below it.  No name passes through the driver.
    """
    base = _as_uri(folder)
    entries = "path STRING, filename STRING, size_bytes BIGINT, is_folder BOOLEAN"
    columns = ["path", "filename", "size_bytes", "is_folder"]
    chunk = 10_000

    def frames(found: list) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        for start in range(0, len(found), chunk):
            rows = [
                (info.path, info.base_name, info.size, info.type == fs.FileType.Directory)
                for info in found[start : start + chunk]
            ]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"size_bytes": "Int64"})

    def top_level(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for _ in batches:
            source, root = fs.FileSystem.from_uri(base)
            yield from frames(source.get_file_info(fs.FileSelector(root, recursive=False)))

    def below(batches: Iterator) -> Iterator:
        from pyarrow import fs

        source, _ = fs.FileSystem.from_uri(base)
        for batch in batches:
            yield batch[~batch["is_folder"]]
            for path in batch.loc[batch["is_folder"], "path"]:
                inside = source.get_file_info(fs.FileSelector(path, recursive=True))
                yield from frames([info for info in inside if info.type == fs.FileType.File])

    tasks = 4 * spark.sparkContext.defaultParallelism
    top = spark.createDataFrame([(base,)], "folder STRING").mapInPandas(top_level, entries)
    every = top.repartition(tasks, "path").mapInPandas(below, entries)
    return every.select("path", "filename", "size_bytes")


def write_files(files: DataFrame, folder: str, buckets: int = 16) -> int:
    """Write one file per row of ``(filename, content)`` from the tasks.

    A file is written under a private name and then moved, so a repeated task
    leaves the same files behind.  Returns the number of files.
    """
    base = _as_uri(folder)

    def writing(batches: Iterator) -> Iterator:
        import uuid
        import zlib

        import pandas as pd
        from pyarrow import fs as task_fs

        target, root = task_fs.FileSystem.from_uri(base)
        for bucket in range(buckets):
            target.create_dir(f"{root}/part{bucket:03d}", recursive=True)
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"]):
                bucket = zlib.crc32(name.encode("utf-8")) % buckets
                place = f"{root}/part{bucket:03d}"
                private = f"{place}/.{uuid.uuid4().hex}"
                with target.open_output_stream(private) as sink:
                    sink.write(content)
                target.move(private, f"{place}/{name}")
            yield pd.DataFrame({"written": [len(batch)]})

    counts = files.select("filename", "content").mapInPandas(writing, "written BIGINT")
    return counts.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def starts_with_magic() -> Column:
    """The content begins with the bytes of ``%PDF``."""
    return F.expr(f"startswith(content, X'{fv.PDF_MAGIC_HEX}')")


def _as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
