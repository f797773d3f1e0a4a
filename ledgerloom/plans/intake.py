"""Verdicts for a landing folder, reading content only where it decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators.intake import upload_verdict
from ledgerloom.schemas import DEFAULTS, Settings
from ledgerloom.sources import files, landing


def folder_verdicts(
    spark: SparkSession, folder: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """``filename, size_bytes, accepted, code, reason`` for every PDF file of a folder.

    Files above the limit and empty files are judged from their metadata; the
    size filter of the other branch reaches the scan, so no oversized file is
    opened.
    """
    limit = settings.max_size_bytes
    columns = ["filename", "size_bytes", "has_pdf_magic"]
    scanned = files.scan_files(spark, folder)
    readable = (
        scanned.where(F.col("length") <= limit)
        .withColumn("has_pdf_magic", files.starts_with_magic())
        .select(columns)
    )
    oversized = (
        scanned.where(F.col("length") > limit)
        .withColumn("has_pdf_magic", F.lit(False))
        .select(columns)
    )
    empty = (
        files.list_files(spark, folder)
        .where((F.col("size_bytes") == 0) & F.endswith(F.lower("filename"), F.lit(".pdf")))
        .withColumn("has_pdf_magic", F.lit(False))
        .select(columns)
    )
    return upload_verdict(readable.unionByName(oversized).unionByName(empty), settings)


def landed_verdicts(landed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``filename, size_bytes, accepted, code, reason`` of files of the landing source.

    The source is opened with ``landing_options``: files above the limit are not read, and
    of others only the bytes that decide.
    """
    begins = F.expr(f"startswith(head, X'{fv.PDF_MAGIC_HEX}')")
    facts = landed.select("filename", "size_bytes", F.coalesce(begins, F.lit(False)).alias("has_pdf_magic"))
    return upload_verdict(facts, settings).select("filename", "size_bytes", "accepted", "code", "reason")


def landing_options(settings: Settings = DEFAULTS) -> dict[str, int]:
    return {"head": len(fv.PDF_MAGIC_HEX) // 2, "max_bytes": settings.max_size_bytes}


def pdf_verdicts(spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Verdicts on every PDF file of a folder, empty ones included, from one listing."""
    landed = landing.scan(spark, folder, **landing_options(settings))
    named = landed.where(F.endswith(F.lower("filename"), F.lit(".pdf")))
    return landed_verdicts(named, settings)
