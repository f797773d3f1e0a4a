"""Document text: cleaning, prompts, request rows, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm
from ledgerloom.functions import text as tx
from ledgerloom.functions.rows import present
from ledgerloom.schemas import DEFAULTS, Settings


def clean(documents: DataFrame, source: str = "raw_text") -> DataFrame:
    """Add the cleaned text and what cleaning changed.

    Uppercasing can lengthen a text, so fewer than zero characters may have
    been removed.  Empty text stays uncleaned and gives a warning.
    """
    raw = F.col(source)
    empty = tx.is_blank(raw)
    cleaned = documents.withColumn("cleaned_text", F.when(~empty, tx.normalize(raw)))
    removed = F.length(source) - F.length("cleaned_text")
    percent = F.bround(removed / F.length(source) * F.lit(100.0), 2)
    return cleaned.withColumns(
        {
            "cleaning_applied": ~empty,
            "characters_removed": removed,
            "removal_percentage": F.when(~empty, percent),
            "final_text_length": F.length("cleaned_text"),
            "warning": F.when(empty, F.lit(fv.NOTHING_TO_CLEAN)),
        }
    )


def cleaning_message(documents: DataFrame) -> DataFrame:
    """Add the progress message of the cleaning step."""
    before, between, after = fv.CLEANED_TEXT
    percent = F.col("characters_removed") / F.length("raw_text") * F.lit(100.0)
    message = F.concat(
        F.lit(before),
        F.col("characters_removed").cast("string"),
        F.lit(between),
        nm.one_decimal(percent),
        F.lit(after),
    )
    return documents.withColumn("message", message)


def prompts(documents: DataFrame) -> DataFrame:
    """Add ``system_prompt, user_prompt, error``.

    The text is put between the two halves of the template as it is; it is
    never used as a pattern or a replacement.
    """
    prefix, suffix = fv.USER_PROMPT.split(fv.PROMPT_PLACEHOLDER)
    empty = tx.is_blank(F.col("cleaned_text"))
    user = F.concat(F.lit(prefix), F.col("cleaned_text"), F.lit(suffix))
    return documents.withColumns(
        {
            "system_prompt": F.when(~empty, F.lit(fv.SYSTEM_PROMPT)),
            "user_prompt": F.when(~empty, user),
            "error": F.when(empty, F.lit(fv.NO_PROMPT_TEXT)),
        }
    )


def prompted(documents: DataFrame) -> DataFrame:
    """``doc_id, system_prompt, user_prompt`` of the documents that have a prompt."""
    both = F.struct("system_prompt", "user_prompt")
    return documents.select(
        "doc_id", present(F.when(F.col("user_prompt").isNotNull(), both)).alias("prompt")
    ).select("doc_id", "prompt.*")


def request(settings: Settings = DEFAULTS) -> Column:
    """The chat request of ``system_prompt, user_prompt`` as JSON."""

    def message(role: str, column: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(column).alias("content"))

    body = F.struct(
        F.lit(settings.model).alias("model"),
        F.array(message("system", "system_prompt"), message("user", "user_prompt")).alias(
            "messages"
        ),
        F.lit(settings.max_tokens).alias("max_tokens"),
        F.lit(settings.temperature).alias("temperature"),
        F.lit(settings.top_p).alias("top_p"),
    )
    return F.to_json(body)


def requests(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One chat request per prompted document: ``doc_id, request`` as JSON."""
    return prompted(documents).select("doc_id", request(settings).alias("request"))


def request_digest(settings: Settings = DEFAULTS) -> Column:
    """SHA-256 of the request of a document, null where it has no prompt."""
    return F.when(F.col("user_prompt").isNotNull(), F.sha2(request(settings), 256))


def prompt_preview(user_prompt: Column) -> Column:
    """Beginning of a prompt as it is logged."""
    return F.concat(F.substring(user_prompt, 1, fv.PROMPT_PREVIEW_CHARS), F.lit("..."))


def reply_preview(content: Column) -> Column:
    """Beginning of a reply as it is logged."""
    return F.substring(tx.strip(content), 1, fv.REPLY_PREVIEW_CHARS)


def chunks(
    documents: DataFrame,
    source: str = "cleaned_text",
    size: int = fv.CHUNK_TOKENS,
    overlap: int = fv.CHUNK_OVERLAP,
) -> DataFrame:
    """``doc_id, chunk_no, chunk``: all words of each text in chunks that overlap.

    Words stand for tokens.  A text without words has no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than a chunk")
    words = F.filter(F.split(F.trim(source), r"\s+"), lambda w: w != "")
    spent = documents.select("doc_id", words.alias("words"))
    step = size - overlap
    count = F.greatest(F.ceil((F.size("words") - overlap) / step), F.lit(1)).cast("int")
    numbers = F.when(F.size("words") > 0, F.sequence(F.lit(1), count)).otherwise(
        F.array().cast("array<int>")
    )
    return spent.select("doc_id", "words", F.explode(numbers).alias("chunk_no")).select(
        "doc_id",
        "chunk_no",
        F.array_join(F.slice("words", (F.col("chunk_no") - 1) * step + 1, F.lit(size)), " ").alias("chunk"),
    )
