"""Page text: numbering, text gate, choice of method, assembly.

Pages come as ``pages ARRAY<STRUCT<page_no, text>>`` in the row of their
document, so the whole path from file to prompt needs no shuffle.  For page
tables with one row per page there is a grouped form whose state is one text
per wanted page, whatever the number of rows of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text as tx
from ledgerloom.schemas import DEFAULTS, Settings


def page_array(text: Column, separator: str = "\n", limit: int | None = None) -> Column:
    """Pages of a text, numbered from 1; only the first ``limit`` when given."""
    parts = F.split(text, separator, -1 if limit is None else limit + 1)
    if limit is not None:
        parts = F.slice(parts, 1, limit)
    return F.transform(
        parts,
        lambda page, index: F.struct(
            (index + 1).cast("int").alias("page_no"), tx.strip(page).alias("text")
        ),
    )


def page_rows(documents: DataFrame, separator: str = "\n") -> DataFrame:
    """One row per page: ``doc_id, page_no, text``."""
    parts = F.split("text", separator)
    return documents.select("doc_id", F.posexplode(parts).alias("position", "page")).select(
        "doc_id",
        (F.col("position") + 1).alias("page_no"),
        tx.strip(F.col("page")).alias("text"),
    )


def _page_block(number: Column, text: Column) -> Column:
    before, between, after = fv.PAGE_HEADER
    return F.concat(
        F.lit(before), number.cast("string"), F.lit(between), text, F.lit(after)
    )


def _kept(pages: Column, settings: Settings) -> Column:
    """The first pages, trimmed, without those that are too short."""
    first = F.filter(pages, lambda page: page["page_no"] <= settings.max_pages)
    trimmed = F.transform(
        first,
        lambda page: F.struct(
            page["page_no"].alias("page_no"), tx.strip(page["text"]).alias("text")
        ),
    )
    return F.filter(trimmed, lambda page: F.length(page["text"]) > settings.min_page_chars)


def assemble(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``raw_text, pages_with_text, total_characters`` from ``pages``."""
    blocks = F.transform("kept", lambda page: _page_block(page["page_no"], page["text"]))
    return (
        documents.withColumn("kept", _kept(F.col("pages"), settings))
        .withColumn("raw_text", F.array_join(blocks, ""))
        .withColumn("pages_with_text", F.size("kept"))
        .withColumn("total_characters", F.length(tx.strip(F.col("raw_text"))))
        .drop("kept")
    )


def assemble_rows(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Assembly of a table ``(doc_id, page_no, text)``; documents without a kept page drop out.

    A document with very many page rows meets the page filter first and then
    keeps the different texts of each wanted page in partial aggregates.  Several texts
    of one page number are blocks of their own, in order of the text; equal ones are
    one.
    """
    body = tx.strip(F.col("text"))
    kept = pages.select("doc_id", "page_no", body.alias("text")).where(
        F.col("page_no").between(1, settings.max_pages)
        & (F.length("text") > settings.min_page_chars)
    )
    grouped = kept.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("page_no", "text"))).alias("pages")
    )
    blocks = F.transform("pages", lambda page: _page_block(page["page_no"], page["text"]))
    return (
        grouped.withColumn("raw_text", F.array_join(blocks, ""))
        .withColumn("pages_with_text", F.size("pages"))
        .withColumn("total_characters", F.length(tx.strip(F.col("raw_text"))))
        .drop("pages")
    )


def has_text(text: Column, settings: Settings = DEFAULTS, separator: str = "\n") -> Column:
    """More letters and digits on the first page than the minimum; null counts as none."""
    first = F.substring_index(text, separator, 1)
    return F.coalesce(tx.alphanumerics(first) > settings.min_alphanumerics, F.lit(False))


def text_gate(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``meaningful_chars`` and ``has_extractable_text`` for the first page."""
    first = tx.strip(F.substring_index("text", "\n", 1))
    return documents.withColumn(
        "meaningful_chars", F.coalesce(tx.alphanumerics(first), F.lit(0))
    ).withColumn("has_extractable_text", F.col("meaningful_chars") > settings.min_alphanumerics)


def _method_name(rank: Column) -> Column:
    name = F
    for position, method in enumerate(fv.EXTRACTION_METHODS, 1):
        name = name.when(rank == position, F.lit(method))
    return name.otherwise(F.lit(fv.NO_METHOD))


def choose_method(attempts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """First strategy, by priority, whose text passes the gate; else ``none``.

    The state per document is one integer, so this is a hash aggregate with a
    map-side part.
    """
    ok = has_text(F.col("text"), settings)
    best = attempts.groupBy("doc_id").agg(
        F.min(F.when(ok, F.col("priority"))).alias("best")
    )
    return best.select(
        "doc_id",
        _method_name(F.col("best")).alias("extraction_method"),
        F.col("best").isNotNull().alias("has_extractable_text"),
    )


def first_method(*texts: Column, settings: Settings = DEFAULTS) -> Column:
    """The same choice for attempts that lie next to each other in one row."""
    name = F
    for method, text in zip(fv.EXTRACTION_METHODS, texts):
        name = name.when(has_text(text, settings), F.lit(method))
    return name.otherwise(F.lit(fv.NO_METHOD))


def page_map(pages: Column, settings: Settings = DEFAULTS) -> Column:
    """Kept pages as a map from page number to text, for use at the edge."""
    return F.map_from_entries(_kept(pages, settings))


def chosen_text(
    choices: DataFrame, attempts: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Each document with the text of its method; no choice means the default method.

    Attempts that fail the gate cannot have been chosen; they are left out before the
    join, but for those of the default method.
    """
    wanted = choices.select(
        "doc_id",
        F.coalesce("extraction_method", F.lit(fv.DEFAULT_METHOD)).alias("method"),
    )
    able = has_text(F.col("text"), settings) | (F.col("method") == fv.DEFAULT_METHOD)
    texts = attempts.where(able).select("doc_id", "method", "text")
    return wanted.join(texts, ["doc_id", "method"], "inner")


def first_text(*texts: Column, settings: Settings = DEFAULTS) -> Column:
    """Method and text of the first attempt in a row that passes the gate, or null."""
    chosen = F
    for method, text in zip(fv.EXTRACTION_METHODS, texts):
        pair = F.struct(F.lit(method).alias("method"), text.alias("text"))
        chosen = chosen.when(has_text(text, settings), pair)
    return chosen.otherwise(F.lit(None))


def extraction_verdict(documents: DataFrame) -> DataFrame:
    """Add ``status, error, processing_stage``: without assembled text a document has failed.

    A document that comes in with an error, or as failed, keeps its error, status and
    stage; where it brings no stage it failed in the first one.
    """
    have = documents.columns
    none = F.lit(None).cast("string")
    error = F.col("error") if "error" in have else none
    failed = error.isNotNull()
    if "status" in have:
        failed = failed | F.coalesce(F.col("status") == fv.FAILED, F.lit(False))
    stage = F.col("processing_stage") if "processing_stage" in have else none
    blank = tx.is_blank(tx.strip(F.col("raw_text")))
    return documents.withColumns(
        {
            "status": F.when(failed | blank, F.lit(fv.FAILED)).otherwise(F.lit(fv.PROCESSING)),
            "error": F.when(failed, error).when(blank, F.lit(fv.NO_ASSEMBLED_TEXT)),
            "processing_stage": F.when(
                failed, F.coalesce(stage, F.lit(fv.STAGES[0]))
            ).otherwise(F.lit(fv.STAGES[1])),
        }
    )
