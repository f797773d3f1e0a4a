"""Invoice arithmetic on item tables and on nested invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as nm
from ledgerloom.schemas import MONEY


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def item_subtotals(items: DataFrame) -> DataFrame:
    """Replace ``subtotal`` by whole quantity times unit price."""
    return items.withColumn(
        "subtotal", nm.item_subtotal(F.col("cantidad"), F.col("precio_unitario"))
    )


def _totals_from(subtotal: Column) -> dict[str, Column]:
    return {
        "subtotal": nm.money(subtotal),
        "igv": nm.vat(subtotal),
        "total": nm.total_with_vat(subtotal),
    }


def totals(headers: DataFrame, items: DataFrame) -> DataFrame:
    """``id, subtotal, igv, total`` of every header from its items; no items means 0.

    Items are summed before they meet the headers, so a header with very many
    items reaches the join as one row.
    """
    sums = items.groupBy(F.col("factura_id").alias("id")).agg(
        F.sum(F.coalesce("subtotal", _zero())).alias("items_sum")
    )
    joined = headers.select("id").join(sums, "id", "left")
    known = F.coalesce(F.col("items_sum"), _zero())
    return joined.select("id", *[v.alias(k) for k, v in _totals_from(known).items()])


def nested_sum(items: Column) -> Column:
    """Sum of the item subtotals of one invoice; missing ones count as 0."""
    return F.coalesce(
        F.aggregate(
            items,
            F.lit(0).cast("decimal(38,2)"),
            lambda done, item: (done + F.coalesce(item["subtotal"], _zero())).cast(
                "decimal(38,2)"
            ),
        ),
        F.lit(0).cast("decimal(38,2)"),
    )


def recompute(invoices: DataFrame) -> DataFrame:
    """Nested invoices with item subtotals, totals and deduction computed anew."""
    fresh_items = F.transform(
        "items",
        lambda item: item.withField(
            "subtotal", nm.item_subtotal(item["cantidad"], item["precio_unitario"])
        ),
    )
    recomputed = invoices.withColumn("items", fresh_items)
    recomputed = recomputed.withColumns(_totals_from(nested_sum(F.col("items"))))
    amount = nm.deduction(
        F.col("total"), F.col("detraccion.porcentaje"), F.col("detraccion.monto")
    )
    return recomputed.withColumn(
        "detraccion",
        F.when(
            F.col("detraccion").isNotNull(),
            F.struct(
                F.col("detraccion.porcentaje").alias("porcentaje"), amount.alias("monto")
            ),
        ),
    )


def deductions(invoices: DataFrame) -> DataFrame:
    """Add ``monto`` from ``total, detraccion_porcentaje`` and ``old_monto``."""
    return invoices.withColumn(
        "monto",
        nm.deduction(F.col("total"), F.col("detraccion_porcentaje"), F.col("old_monto")),
    )
