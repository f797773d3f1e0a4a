"""Model replies: fence removal, strict gate, typed invoices, tokens and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm
from ledgerloom.functions import replies as rp
from ledgerloom.functions import text as tx
from ledgerloom.functions.rows import present
from ledgerloom.schemas import INVOICE_FIELDS


def unfence(replies: DataFrame) -> DataFrame:
    """Add ``body``: the reply without code fence and outer white space."""
    return replies.withColumn("body", tx.unfence(F.col("content")))


def gate(replies: DataFrame) -> DataFrame:
    """Add ``body, accepted, status, error``; a missing reply has failed too."""
    return (
        unfence(replies)
        .withColumn("accepted", rp.is_json_object(F.col("body")))
        .withColumns(
            {
                "status": F.when(F.col("accepted"), F.lit(fv.COMPLETED)).otherwise(
                    F.lit(fv.FAILED)
                ),
                "error": F.when(~F.col("accepted"), F.lit(fv.REPLY_STEP_ERROR + fv.BAD_REPLY)),
            }
        )
    )


def parse(replies: DataFrame) -> DataFrame:
    """Gate the replies and add the contract fields and ``raw``.

    Rejected replies keep their row, with null fields.  ``raw`` holds the
    amounts as written.
    """
    gated = gate(replies)
    raw = F.when(F.col("accepted"), rp.parse_raw(F.col("body")))
    return gated.withColumn("raw", raw).withColumns(rp.to_stored(F.col("raw")))


def picked(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """The one reply of each document that counts, for every use of replies.

    An accepted reply goes first; among these, and among rejected ones, the least
    text and then the least number of tokens.  Columns ``doc_id, accepted, body,
    total_tokens``.  The reduction has a map-side part, so a document with very many
    replies reaches the shuffle as one row per task.  Tokens of replies that do not
    count are counted nowhere.
    """
    judged = replies.select(
        F.col(key).alias("doc_id"),
        F.struct(
            (~rp.is_json_object(tx.unfence(F.col("content")))).alias("rejected"), "content", "total_tokens"
        ).alias("rank"),
    )
    # The text travels once; what stands within the fence is taken from it afterwards.
    best = judged.groupBy("doc_id").agg(F.min("rank").alias("best"))
    return best.select(
        "doc_id",
        (~F.col("best.rejected")).alias("accepted"),
        tx.unfence(F.col("best.content")).alias("body"),
        "best.total_tokens",
    )


def accepted_invoices(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """The accepted reply of each document, as a typed invoice keyed by ``id``.

    Gate and parse run once per reply, the parse only on what counts.  ``body`` is the
    reply as it was received, for audits.
    """
    parsed = picked(replies, key).select(
        F.col("doc_id").alias("id"),
        "total_tokens",
        "body",
        present(F.when(F.col("accepted"), rp.parse_raw(F.col("body")))).alias("raw"),
    )
    return parsed.withColumns(rp.to_stored(F.col("raw"))).select(
        "id", *INVOICE_FIELDS, "raw", "total_tokens", "body"
    )


def field_count(replies: DataFrame) -> DataFrame:
    """Add ``field_count``: different top-level keys of an accepted reply."""
    return gate(replies).withColumn(
        "field_count", F.when(F.col("accepted"), rp.key_count(F.col("body")))
    )


def token_cost(replies: DataFrame) -> DataFrame:
    """Tokens and cost of the accepted reply of each document.

    Only the reply that counts adds to the metrics; see ``picked``.
    """
    per_document = (
        picked(replies)
        .where("accepted")
        .select("doc_id", F.coalesce("total_tokens", F.lit(0)).alias("tokens_used"))
    )
    return per_document.withColumn("cost_estimate", nm.token_cost(F.col("tokens_used")))


def one_per_document(replies: DataFrame, with_data: bool = True) -> DataFrame:
    """Verdict, counts and invoice of the reply that counts, one row per document.

    Without the extracted invoice, the reply is gated but not parsed.
    """
    accepted = F.col("accepted")
    chosen = picked(replies)
    if with_data:
        raw = F.when(accepted, rp.parse_raw(F.col("body")))
        chosen = chosen.withColumn("raw", raw).withColumns(rp.to_stored(F.col("raw")))
    columns = [
        "doc_id",
        "accepted",
        F.when(accepted, F.lit(fv.COMPLETED)).otherwise(F.lit(fv.FAILED)).alias("status"),
        F.when(~accepted, F.lit(fv.REPLY_STEP_ERROR + fv.BAD_REPLY)).alias("error"),
        F.when(accepted, rp.key_count(F.col("body"))).alias("field_count"),
        F.when(accepted, F.coalesce("total_tokens", F.lit(0))).alias("tokens"),
    ]
    if with_data:
        columns.append(F.when(accepted, F.struct(*INVOICE_FIELDS)).alias("extracted_data"))
    return chosen.select(*columns)


def with_reply(documents: DataFrame, replies: DataFrame, with_data: bool = True) -> DataFrame:
    """Each document with its reply verdict; no reply means failed.

    The reply is reduced to verdict and invoice before the join, so no reply
    text is shuffled.  An earlier error of the document stays.
    """
    judged = (
        one_per_document(replies, with_data)
        .drop("status")
        .withColumnRenamed("error", "reply_error")
    )
    joined = documents.join(judged, "doc_id", "left")
    failure = F.when(
        F.coalesce("accepted", F.lit(False)), F.lit(None).cast("string")
    ).otherwise(F.coalesce("reply_error", F.lit(fv.REPLY_STEP_ERROR + fv.BAD_REPLY)))
    fine = F.col("error").isNull()
    columns = {
        "status": F.when(fine, F.lit(fv.COMPLETED)).otherwise(F.lit(fv.FAILED)),
        "tokens_used": F.when(fine, F.col("tokens")).otherwise(F.lit(0)),
        "field_count": F.when(fine, F.col("field_count")).otherwise(F.lit(0)),
    }
    if with_data:
        columns["extracted_data"] = F.when(fine, F.col("extracted_data"))
    return (
        joined.withColumn("error", F.coalesce("error", failure))
        .withColumns(columns)
        .drop("accepted", "reply_error", "tokens")
    )
