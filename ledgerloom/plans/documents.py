"""From document text to prompts, and from replies to finished documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text as tx
from ledgerloom.operators import pages, replies, state, texts
from ledgerloom.schemas import DEFAULTS, Settings


def prepare(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Assemble, verify, clean and prompt documents that carry ``pages``.

    The whole step is a projection over one row per document.  The first error
    of a document stays, and later steps leave a failed document alone.
    """
    assembled = pages.extraction_verdict(pages.assemble(documents, settings))
    going = F.col("status") != fv.FAILED
    usable = assembled.withColumn("raw_text", F.when(going, F.col("raw_text")))
    prompted = texts.prompts(texts.clean(usable).withColumnRenamed("error", "first_error"))
    return prompted.withColumn("error", F.coalesce("first_error", "error")).drop("first_error")


def trace(
    ingested: DataFrame, model_replies: DataFrame, at: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Stage, status and log lists of each document after all four steps.

    ``ingested`` comes from ``intake.ingestion_verdict`` and carries ``pages``.
    A failed document takes part in no further step and logs nothing more.
    """
    no_lines = F.array().cast("array<string>")
    failed_first = F.col("error")
    started = ingested.withColumns(
        {
            "status": F.lit(fv.PROCESSING),
            "processing_stage": F.lit(fv.STAGES[0]),
            "messages": no_lines,
            "warnings": no_lines,
            "errors": no_lines,
        }
    )
    first = state.log(
        state.enter_stage(started, at, fv.STAGES[0]),
        at,
        message=F.col("message"),
        error=failed_first,
    )
    # Text of documents that failed is not needed any more.
    going = F.col("status") != fv.FAILED
    assembled = pages.assemble(
        state.enter_stage(first, at, fv.STAGES[1]).withColumn(
            "pages", F.when(going, F.col("pages"))
        ),
        settings,
    )
    no_text = going & tx.is_blank(F.col("raw_text"))
    before, between, after = fv.EXTRACTED_TEXT
    extracted = F.concat(
        F.lit(before),
        F.col("total_characters").cast("string"),
        F.lit(between),
        F.col("pages_with_text").cast("string"),
        F.lit(after),
    )
    second = state.log(
        assembled,
        at,
        message=F.when(going & ~no_text, extracted),
        error=F.when(no_text, F.lit(fv.NO_ASSEMBLED_TEXT)),
    )
    cleaned = texts.cleaning_message(texts.clean(state.enter_stage(second, at, fv.STAGES[2])))
    third = state.log(
        cleaned,
        at,
        message=F.when(going, F.col("message")),
        warning=F.when(going, F.col("warning")),
    )
    kept = third.select(
        "doc_id", "status", "processing_stage", "messages", "warnings", "errors"
    )
    judged = replies.one_per_document(model_replies, with_data=False).select(
        "doc_id", "accepted", "field_count", F.col("error").alias("reply_error")
    )
    joined = state.enter_stage(kept, at, fv.STAGES[3]).join(judged, "doc_id", "left")
    head, tail = fv.EXTRACTED_FIELDS
    accepted = F.coalesce("accepted", F.lit(False))
    fields = F.concat(F.lit(head), F.col("field_count").cast("string"), F.lit(tail))
    no_reply = F.coalesce("reply_error", F.lit(fv.REPLY_STEP_ERROR + fv.BAD_REPLY))
    last = state.log(
        joined,
        at,
        message=F.when(going & accepted, fields),
        error=F.when(going & ~accepted, no_reply),
    )
    return last.withColumn(
        "status", F.when(going, F.lit(fv.COMPLETED)).otherwise(F.lit(fv.FAILED))
    ).select("doc_id", "status", "processing_stage", "messages", "warnings", "errors")


def finish(
    prepared: DataFrame, model_replies: DataFrame, settings: Settings = DEFAULTS, *more: str
) -> DataFrame:
    """Join prepared documents with their replies and report each document.

    A document whose prompt could not be made has failed in the last step, whatever
    reply there is.  ``more`` names columns of ``prepared`` to report as well.
    """
    reached = F.when(F.col("status") == fv.FAILED, F.col("processing_stage")).otherwise(
        F.lit(fv.STAGES[3])
    )
    failed = F.col("status") == fv.FAILED
    slim = prepared.select(
        "doc_id",
        F.when(failed, F.coalesce("error", F.lit("")))
        .otherwise(F.concat(F.lit(fv.REPLY_STEP_ERROR), F.col("error")))
        .alias("error"),
        reached.alias("processing_stage"),
        *more,
    )
    answered = replies.with_reply(slim, model_replies)
    return state.result(answered.withColumn("llm_model", F.lit(settings.model)), *more)
