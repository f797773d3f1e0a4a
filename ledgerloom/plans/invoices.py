"""From model replies to a checked ledger and its statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as nm
from ledgerloom.operators import checks, ledger, money, replies
from ledgerloom.schemas import DEFAULTS, MONEY, Settings


def checked(model_replies: DataFrame) -> DataFrame:
    """Accepted invoices with their violations and the recomputed amounts."""
    invoices = checks.violations(replies.accepted_invoices(model_replies))
    again = money.nested_sum(
        F.transform(
            "items",
            lambda x: F.struct(
                nm.item_subtotal(x["cantidad"], x["precio_unitario"]).alias("subtotal")
            ),
        )
    )
    return invoices.withColumn("recomputed_total", nm.total_with_vat(again))


def to_ledger(
    model_replies: DataFrame,
    day: datetime.date | None = None,
    settings: Settings = DEFAULTS,
    filename: str | None = None,
    registered_at: Column | None = None,
) -> DataFrame:
    """Nested ledger rows of the accepted replies."""
    invoices = replies.accepted_invoices(model_replies).withColumn(
        "filename", F.lit(filename).cast("string")
    )
    return ledger.stored(invoices, day, settings, registered_at)


def overview(model_replies: DataFrame) -> DataFrame:
    """One row: ledger statistics, stored items, and how many invoices break a rule."""
    invoices = checked(model_replies)
    stored_items = F.size(ledger.with_description(F.col("items")))
    return invoices.agg(
        F.count(F.lit(1)).alias("total_facturas"),
        F.sum("total").alias("monto_total"),
        F.avg("total").alias("promedio_factura"),
        F.countDistinct("codigo_cliente").alias("total_clientes"),
        F.sum(stored_items).alias("items_stored"),
        F.count_if(F.size("violations") > 0).alias("with_violations"),
        F.count_if(~nm.within_tolerance(F.col("total"), F.col("recomputed_total"))).alias(
            "total_differs"
        ),
        F.sum("recomputed_total").cast("decimal(28,2)").alias("recomputed_sum"),
        F.sum(F.coalesce("total", F.lit(0).cast(MONEY))).alias("stored_sum"),
    )
