"""The invoice ledger: stored rows, items, detail, paging, lookups, statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import replies as rp
from ledgerloom.functions import text as tx
from ledgerloom.schemas import DEFAULTS, INVOICE_FIELDS, ITEM_FIELDS, ITEMS, Settings


def as_of(day: datetime.date | None) -> Column:
    """The date an invoice is stored under: given, or today."""
    return F.current_date() if day is None else F.lit(day)


def with_description(items: Column) -> Column:
    """Items that are stored: those with a description."""
    return F.coalesce(
        F.filter(items, lambda item: item["descripcion"] != ""), F.array().cast(ITEMS)
    )


def raw_payload(invoices: DataFrame) -> DataFrame:
    """Add ``datos_raw``, for audits: the text as received, or else the invoice as JSON.

    Invoices that come from replies bring their ``body``, with every key it had.
    """
    if "body" in invoices.columns:
        return invoices.withColumn("datos_raw", F.col("body"))
    whole = F.struct(*[F.col(name) for name in INVOICE_FIELDS])
    return invoices.withColumn("datos_raw", rp.payload_text(whole))


def header_columns(day: datetime.date | None, settings: Settings) -> list[Column]:
    return [
        F.col("id"),
        tx.invoice_code(F.col("id"), settings.code_width).alias("codigo_factura"),
        as_of(day).alias("fecha_emision"),
        F.col("codigo_cliente"),
        F.col("razon_social_cliente"),
        F.col("direccion_cliente"),
        F.col("distrito"),
        F.col("forma_pago"),
        F.col("moneda"),
        F.col("subtotal"),
        F.col("igv"),
        F.col("total"),
        F.col("detraccion.porcentaje").alias("detraccion_porcentaje"),
        F.col("detraccion.monto").alias("detraccion_monto"),
        F.col("filename").alias("archivo_pdf_path"),
        F.lit(fv.STORED_STATE).alias("estado"),
    ]


def header(
    invoices: DataFrame, day: datetime.date | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """The stored header row of each nested invoice, without the audit payload."""
    return invoices.select(*header_columns(day, settings))


def stored(
    invoices: DataFrame,
    day: datetime.date | None = None,
    settings: Settings = DEFAULTS,
    registered_at: Column | None = None,
) -> DataFrame:
    """Header, audit payload, stored items and registration time in one nested row."""
    at = F.current_timestamp() if registered_at is None else registered_at
    return raw_payload(invoices).select(
        *header_columns(day, settings),
        "datos_raw",
        with_description(F.col("items")).alias("items"),
        at.alias("fecha_registro"),
    )


def item_rows(invoices: DataFrame) -> DataFrame:
    """Stored items, one per row, with the id of their invoice."""
    kept = with_description(F.col("items"))
    return invoices.select(F.col("id").alias("factura_id"), F.inline(kept)).select(
        "factura_id", *ITEM_FIELDS
    )


def numbered_items(invoices: DataFrame) -> DataFrame:
    """All items in list order with their number from 1."""
    return invoices.select(
        F.col("id").alias("factura_id"), F.posexplode("items").alias("position", "item")
    ).select("factura_id", (F.col("position") + 1).alias("item_no"), "item.*")


def stored_item_counts(invoices: DataFrame) -> DataFrame:
    """Stored items per invoice, with the warning for an invoice without items."""
    return invoices.select(
        "id",
        F.size(with_description(F.col("items"))).alias("items_stored"),
        F.coalesce(F.size("items") == 0, F.lit(True)).alias("saved_without_items"),
    )


def detail(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Header columns next to each of its items; a header without items keeps one row.

    The pairs come from an inner join, which adaptive execution can split on
    both sides when one invoice holds a large share of the items; an outer join
    could only be split on the header side.  Headers without items are found
    against the distinct keys of the items.
    """
    lines = items.withColumnRenamed("factura_id", "id")
    item_columns = [name for name in lines.columns if name != "id"]
    pairs = headers.join(lines, "id", "inner")
    alone = headers.join(lines.select("id").distinct(), "id", "left_anti")
    empty = [F.lit(None).cast(lines.schema[name].dataType).alias(name) for name in item_columns]
    return pairs.select(*headers.columns, *item_columns).unionByName(
        alone.select(*headers.columns, *empty)
    )


def nested(headers: DataFrame, items: DataFrame, order: str) -> DataFrame:
    """Header columns with ``items``, the header's lines as one list in order.

    A header without items gets an empty list.  The list is one row by definition, so
    an invoice of very many lines is one long row; everything else in the plan is
    sized by tasks.  From the stored nested ledger no shuffle is needed: its rows
    have their items already.
    """
    columns = [order, *[name for name in items.columns if name not in ("factura_id", order)]]
    lists = items.groupBy(F.col("factura_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("items")
    )
    joined = headers.join(lists, "id", "left")
    none = F.array().cast(lists.schema["items"].dataType)
    return joined.select(*headers.columns, F.coalesce("items", none).alias("items"))


def by_currency(headers: DataFrame) -> DataFrame:
    """The statistics of each currency; null is a group of its own."""
    return headers.groupBy("moneda").agg(
        F.count(F.lit(1)).alias("total_facturas"),
        F.sum("total").alias("monto_total"),
        F.avg("total").alias("promedio_factura"),
        F.countDistinct("codigo_cliente").alias("total_clientes"),
    )


def repeated(headers: DataFrame) -> DataFrame:
    """Invoices that look the same: one client, currency and total, several ids.

    One row a group, with its least and greatest id and its size; invoices without a
    client or total are not compared.
    """
    return (
        headers.where(F.col("codigo_cliente").isNotNull() & F.col("total").isNotNull())
        .groupBy("codigo_cliente", "moneda", "total")
        .agg(
            F.count(F.lit(1)).alias("times"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
        )
        .where("times > 1")
    )


def page(headers: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest headers first: skip ``offset``, keep ``limit``; ties by id.

    For deep pages use ``page_after``: skipping has to sort what it skips.
    """
    return headers.orderBy(F.desc("fecha_registro"), "id").offset(offset).limit(limit)


def page_after(headers: DataFrame, when: Column, key: Column, limit: int = 50) -> DataFrame:
    """The page that follows the row with the given time and id."""
    later = (F.col("fecha_registro") < when) | (
        (F.col("fecha_registro") == when) & (F.col("id") > key)
    )
    return headers.where(later).orderBy(F.desc("fecha_registro"), "id").limit(limit)


def lookup(requested: DataFrame, headers: DataFrame) -> DataFrame:
    """Each requested id once, with its header if there is one and ``found``."""
    wanted = requested.select("id").distinct()
    marked = headers.withColumn("found", F.lit(True))
    return wanted.join(marked, "id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def missing(requested: DataFrame, headers: DataFrame) -> DataFrame:
    """Requested ids that the ledger does not hold."""
    return requested.select("id").distinct().join(headers.select("id"), "id", "left_anti")


def statistics(headers: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of invoices, sum and mean of the totals, number of clients."""
    clients = (
        F.approx_count_distinct("codigo_cliente")
        if approximate
        else F.countDistinct("codigo_cliente")
    )
    return headers.agg(
        F.count(F.lit(1)).alias("total_facturas"),
        F.sum("total").alias("monto_total"),
        F.avg("total").alias("promedio_factura"),
        clients.alias("total_clientes"),
    )
