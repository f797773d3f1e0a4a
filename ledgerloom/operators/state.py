"""Processing state of a document: defaults, log, merged debug values, result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm
from ledgerloom.functions import text as tx


def initial(documents: DataFrame, model: str = fv.DEFAULT_MODEL) -> DataFrame:
    """State of newly arrived documents; needs ``doc_id, file_path, file_size``."""
    no_lines = F.array().cast("array<string>")
    return documents.select(
        "doc_id",
        "file_path",
        tx.base_name(F.col("file_path")).alias("filename"),
        "file_size",
        F.lit(None).cast("string").alias("raw_text"),
        F.lit(None).cast("string").alias("cleaned_text"),
        F.lit(fv.FIRST_STAGE).alias("processing_stage"),
        F.lit(fv.PROCESSING).alias("status"),
        F.lit(0).cast("bigint").alias("tokens_used"),
        F.lit(0.0).alias("processing_time"),
        F.lit(0.0).alias("cost_estimate"),
        F.lit(model).alias("llm_model"),
        F.lit(0.0).alias("confidence_score"),
        F.lit(0.0).alias("completeness_score"),
        no_lines.alias("messages"),
        no_lines.alias("errors"),
        no_lines.alias("warnings"),
    )


def add_line(lines: str, at: Column, message: Column) -> Column:
    """The list with one more log line; a null message adds nothing."""
    return F.when(
        message.isNotNull(), F.array_append(F.col(lines), tx.log_line(at, message))
    ).otherwise(F.col(lines))


def log(
    states: DataFrame,
    at: Column,
    message: Column | None = None,
    warning: Column | None = None,
    error: Column | None = None,
) -> DataFrame:
    """Append log lines; an error also sets FAILED, which nothing takes back."""
    changes = {}
    if message is not None:
        changes["messages"] = add_line("messages", at, message)
    if warning is not None:
        changes["warnings"] = add_line("warnings", at, warning)
    if error is not None:
        changes["errors"] = add_line("errors", at, error)
        changes["status"] = F.when(error.isNotNull(), F.lit(fv.FAILED)).otherwise(
            F.col("status")
        )
    return states.withColumns(changes)


def enter_stage(states: DataFrame, at: Column, stage: str) -> DataFrame:
    """Set the stage and log it, for documents that have not failed."""
    going = F.col("status") != fv.FAILED
    staged = states.withColumn(
        "processing_stage", F.when(going, F.lit(stage)).otherwise(F.col("processing_stage"))
    )
    return log(staged, at, message=F.when(going, F.lit(fv.STAGE_MESSAGE + stage)))


def merge_maps(first: Column, second: Column) -> Column:
    """Union of two maps in which the second wins, under any session setting."""
    only_first = F.map_filter(
        first, lambda key, _: ~F.array_contains(F.map_keys(second), key)
    )
    return F.map_concat(only_first, second)


def result(states: DataFrame, *more: str) -> DataFrame:
    """What a finished document reports: control, extracted fields, metrics, ``more``."""
    return states.select(
        "doc_id",
        "processing_stage",
        "status",
        "error",
        "extracted_data",
        "field_count",
        "tokens_used",
        nm.token_cost(F.col("tokens_used")).alias("cost_estimate"),
        "llm_model",
        *more,
    )
