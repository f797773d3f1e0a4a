"""Incremental file intake: every new file is judged once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ledgerloom.operators.intake import upload_verdict
from ledgerloom.plans.intake import landed_verdicts, landing_options
from ledgerloom.schemas import DEFAULTS, Settings
from ledgerloom.sources import files, landing


_FACTS = ("filename", "size_bytes", "has_pdf_magic")
_VERDICT = ("filename", "size_bytes", "accepted", "code", "reason")
_READ, _EMPTY = "read", "empty"


def start(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    files_per_batch: int = 100_000,
) -> StreamingQuery:
    """Append a verdict for each file that arrived since the last run, then stop.

    The file sink commits a batch as a whole, so a restart with the same
    checkpoint neither loses nor repeats a file.
    """
    limit = settings.max_size_bytes
    arrived = files.scan_file_stream(
        spark, folder, only_pdf=False, files_per_batch=files_per_batch
    )
    # The filters on length reach the scan, so that no oversized file is opened.
    readable = arrived.where(F.col("length") <= limit).withColumn(
        "has_pdf_magic", files.starts_with_magic()
    )
    oversized = arrived.where(F.col("length") > limit).withColumn("has_pdf_magic", F.lit(False))
    judged = upload_verdict(
        readable.select(*_FACTS).union(oversized.select(*_FACTS)), settings
    ).select(*_VERDICT)
    return (
        judged.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/{_READ}")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow(
    spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Append a verdict for each file that arrived since the last run, empty ones included.

    The landing source hands out each name once for its log, which lies beside the
    checkpoint, and the file sink commits a batch as a whole: a restart neither loses nor
    repeats a file.
    """
    arrived = landing.stream(spark, folder, f"{checkpoint}-log", **landing_options(settings))
    return (
        landed_verdicts(arrived, settings)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/{_READ}")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def judge_empty(spark: SparkSession, folder: str, out: str, settings: Settings = DEFAULTS) -> None:
    """Append verdicts for files of no bytes, which the file source does not show.

    Names come from a listing; those judged before are left out, so a run may be
    repeated.
    """
    empty = files.list_files(spark, folder).where("size_bytes = 0")
    judged = upload_verdict(empty.withColumn("has_pdf_magic", F.lit(False)), settings)
    new = judged.select(*_VERDICT)
    known = _read(spark, f"{out}/{_EMPTY}")
    if known is not None:
        new = new.join(known.select("filename"), "filename", "left_anti").select(*_VERDICT)
    new.write.mode("append").parquet(f"{out}/{_EMPTY}")


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    """All verdicts so far: of files that were read and of empty ones."""
    parts = [_read(spark, f"{out}/{name}") for name in (_READ, _EMPTY)]
    found = [part for part in parts if part is not None]
    if not found:
        raise ValueError(f"no verdicts below {out}")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(*_VERDICT)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
