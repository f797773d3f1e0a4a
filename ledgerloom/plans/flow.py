"""From files to results in one plan: the first error of a document stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators import intake, texts
from ledgerloom.plans import documents
from ledgerloom.schemas import DEFAULTS, Settings
from ledgerloom.sources import extractors


def ingested(
    files: DataFrame, readers: dict[str, extractors.PageReader], settings: Settings = DEFAULTS
) -> DataFrame:
    """Judge, open and read files ``(doc_id, filename, file_path, size_bytes, has_pdf_magic, content)``.

    A file that the upload checks reject is not opened.  Adds ``status, error,
    processing_stage, extraction_method, pages``; the rows are those of ``files``.
    ``doc_id`` must be unique.
    """
    judged = intake.upload_verdict(files, settings)
    given = judged.select(
        "doc_id", "filename", "file_path", "size_bytes", F.col("reason").alias("upload_error")
    )
    accepted = judged.select("doc_id", F.when(F.col("accepted"), F.col("content")).alias("content"))
    read = extractors.extract_first(accepted, readers, settings).withColumnRenamed("doc_id", "key")
    opened = given.join(read, F.col("doc_id").cast("string") == F.col("key")).drop("key")
    facts = opened.withColumns({"needs_pass": F.lit(False), "first_page_ok": F.lit(True)})
    verdict = intake.ingestion_verdict(facts, settings)
    return verdict.withColumn("error", F.coalesce("upload_error", "error")).withColumns(
        {
            "status": F.when(F.col("error").isNull(), F.lit(fv.PROCESSING)).otherwise(
                F.lit(fv.FAILED)
            ),
            "processing_stage": F.lit(fv.STAGES[0]),
        }
    )


def results(
    files: DataFrame,
    readers: dict[str, extractors.PageReader],
    model_replies: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The result of every file: verdicts, reading with fallback, prompt, reply.

    A reply counts only for a file that got as far as its request.  ``request_digest``
    tells which request the result is of; it is null where none was made.
    """
    prepared = documents.prepare(ingested(files, readers, settings), settings)
    asked = prepared.withColumn("request_digest", texts.request_digest(settings))
    return documents.finish(asked, model_replies, settings, "extraction_method", "request_digest")
