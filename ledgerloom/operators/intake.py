"""Verdicts on uploaded files: name, size, content, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm
from ledgerloom.functions import text as tx
from ledgerloom.schemas import DEFAULTS, Settings


def _limit_text(limit_mb: float) -> str:
    return str(int(limit_mb)) if float(limit_mb).is_integer() else str(limit_mb)


def upload_verdict(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``accepted, code, reason`` by the first check that fails.

    Checks in order: has a name, name ends in .pdf, declared type (only where
    the table has ``content_type``), size, leading bytes.  Needs ``filename,
    size_bytes, has_pdf_magic``.
    """
    before, between, after = fv.TOO_LARGE_TEXT
    too_large = F.concat(
        F.lit(before),
        nm.one_decimal(nm.megabytes(F.col("size_bytes"))),
        F.lit(between + _limit_text(settings.max_size_mb) + after),
    )
    checks: list[tuple[Column, int, Column]] = [
        (tx.is_blank(F.col("filename")), fv.NO_NAME[0], F.lit(fv.NO_NAME[1])),
        (
            ~F.endswith(F.lower("filename"), F.lit(".pdf")),
            fv.NOT_PDF_NAME[0],
            F.lit(fv.NOT_PDF_NAME[1]),
        ),
    ]
    if "content_type" in files.columns:
        other_type = F.coalesce(F.col("content_type") != "application/pdf", F.lit(True))
        checks.append((other_type, fv.NOT_PDF_TYPE[0], F.lit(fv.NOT_PDF_TYPE[1])))
    checks += [
        (F.col("size_bytes") > settings.max_size_bytes, fv.TOO_LARGE_CODE, too_large),
        (
            ~F.coalesce(F.col("has_pdf_magic"), F.lit(False)),
            fv.NOT_PDF_CONTENT[0],
            F.lit(fv.NOT_PDF_CONTENT[1]),
        ),
    ]
    code, reason = F, F
    for condition, number, text in checks:
        code = code.when(condition, F.lit(number))
        reason = reason.when(condition, text)
    return files.withColumns({"code": code, "reason": reason}).withColumn(
        "accepted", F.col("code").isNull()
    )


def integrity_message() -> Column:
    """What opening the file showed to be wrong; empty when nothing is."""
    error = F.col("open_error")
    return (
        F.when(error == "corrupt", F.lit(fv.CORRUPT_FILE))
        .when(error == "empty", F.lit(fv.EMPTY_FILE))
        .when(F.col("needs_pass"), F.lit(fv.PASSWORD_FILE))
        .when(F.col("page_count") == 0, F.lit(fv.ZERO_PAGES))
        .when(~F.col("first_page_ok"), F.lit(fv.UNREADABLE_PAGE))
        .when(error.isNotNull(), F.concat(F.lit(fv.OTHER_OPEN_ERROR), error))
        .otherwise(F.lit(""))
    )


def integrity_verdict(files: DataFrame) -> DataFrame:
    """Add ``is_valid, message, pages`` from what opening the file showed.

    Needs ``open_error`` (``corrupt``, ``empty`` or another text), ``needs_pass``,
    ``page_count`` and ``first_page_ok``.
    """
    return files.withColumn("message", integrity_message()).withColumns(
        {
            "is_valid": F.col("message") == "",
            "pages": F.when(F.col("message") == "", F.col("page_count")).otherwise(F.lit(0)),
        }
    )


def ingestion_verdict(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The whole first step: add ``error, status`` and the facts about a valid file.

    Checks in order: the file exists (``size_bytes`` is known), its size, its
    integrity, and that some strategy found text (``extraction_method``).
    Facts of a file that failed are null.
    """
    size = F.col("size_bytes")
    shown_mb = nm.one_decimal(nm.megabytes(size))
    before, between, after = fv.OVERSIZE_TEXT
    oversize = F.concat(
        F.lit(before), shown_mb, F.lit(between + _limit_text(settings.max_size_mb) + after)
    )
    method = F.coalesce("extraction_method", F.lit(fv.NO_METHOD))
    error = (
        F.when(size.isNull(), F.concat(F.lit(fv.FILE_MISSING), F.col("file_path")))
        .when(size > settings.max_size_bytes, oversize)
        .when(F.col("integrity") != "", F.col("integrity"))
        .when(method == fv.NO_METHOD, F.lit(fv.NO_TEXT_FOUND))
    )
    head, middle, tail = fv.VALIDATED_TEXT
    message = F.concat(
        F.lit(head),
        F.col("page_count").cast("string"),
        F.lit(middle),
        shown_mb,
        F.lit(tail),
        F.col("extraction_method"),
    )
    judged = files.withColumn("integrity", integrity_message()).withColumn("error", error)
    fine = F.col("error").isNull()
    return judged.withColumns(
        {
            "status": F.when(fine, F.lit(fv.PROCESSING)).otherwise(F.lit(fv.FAILED)),
            "file_size_mb": F.when(fine, nm.megabytes(size)),
            "page_count": F.when(fine, F.col("page_count")),
            "extraction_method": F.when(fine, F.col("extraction_method")),
            "password_protected": F.when(fine, F.lit(False)),
            "has_extractable_text": F.when(fine, F.lit(True)),
            "validation_status": F.when(fine, F.lit(fv.PASSED)),
            "extraction_strategy": F.when(fine, F.lit(fv.NATIVE_TEXT)),
            "message": F.when(fine, message),
        }
    ).drop("integrity")


def metadata_columns(files: DataFrame) -> DataFrame:
    """Add the document properties of ``meta``, empty where absent."""
    names = ("title", "author", "creator", "producer")
    return files.withColumns(
        {
            f"pdf_{name}": F.coalesce(F.try_element_at("meta", F.lit(name)), F.lit(""))
            for name in names
        }
    )


def sizes(files: DataFrame) -> DataFrame:
    """Add the size in MB as stored (two decimals) and as shown (one decimal)."""
    size = F.col("size_bytes")
    return files.withColumns(
        {
            "file_size_mb": nm.rounded_megabytes(size, 2),
            "shown_mb": nm.one_decimal(nm.megabytes(size)),
        }
    )
