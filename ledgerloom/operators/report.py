"""The invoice report as a long table: one row per label and value."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm
from ledgerloom.functions import text as tx
from ledgerloom.schemas import MONEY


def _line(section: str, number: Column | int, label: str, value: Column) -> Column:
    position = F.lit(number) if isinstance(number, int) else number
    return F.struct(
        F.lit(section).alias("section"),
        position.cast("int").alias("row_no"),
        F.lit(label).alias("label"),
        value.cast("string").alias("value"),
    )


def _or_zero(value: Column, as_type: str = MONEY) -> Column:
    return F.coalesce(value, F.lit(0).cast(as_type))


def _item_lines(item: Column, index: Column) -> Column:
    number = index + 1
    section = fv.SECTION_ITEMS
    quantity = _or_zero(item["cantidad"], "decimal(18,4)")
    return F.array(
        _line(
            section,
            number,
            fv.LABEL_DESCRIPTION,
            F.coalesce(item["descripcion"], F.lit(fv.NOT_AVAILABLE)),
        ),
        _line(section, number, fv.LABEL_QUANTITY, nm.shortest_text(quantity)),
        _line(
            section, number, fv.LABEL_PRICE, nm.money_text(_or_zero(item["precio_unitario"]))
        ),
        _line(
            section,
            number,
            fv.LABEL_ITEM_SUBTOTAL,
            nm.money_text(_or_zero(item["subtotal"])),
        ),
    )


def rows(invoices: DataFrame, generated_at: datetime.datetime | Column) -> DataFrame:
    """``factura_id, moneda, section, row_no, label, value`` for every invoice."""
    return listed(invoices, generated_at).select("factura_id", "moneda", F.inline("lines"))


def listed(invoices: DataFrame, generated_at: datetime.datetime | Column) -> DataFrame:
    """``factura_id, moneda, lines``: the report of each invoice as one list.

    All lines of an invoice are built from its own row in one pass over the
    input.  Needs the contract fields and ``filename``.
    """
    at = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    currency = F.coalesce(F.col("moneda"), F.lit(fv.DEFAULT_CURRENCY))

    def shown(name: str) -> Column:
        return tx.or_not_available(F.col(name))

    def amount(value: Column) -> Column:
        return nm.currency_text(F.col("report_currency"), _or_zero(value))

    document = F.array_compact(
        F.array(
            F.when(
                ~tx.is_blank(F.col("filename")),
                _line(fv.SECTION_DOCUMENT, 1, fv.LABEL_FILE, F.col("filename")),
            ),
            _line(
                fv.SECTION_DOCUMENT,
                2,
                fv.LABEL_GENERATED,
                F.date_format(at, fv.REPORT_TIME_FORMAT),
            ),
        )
    )
    client = F.array(
        _line(fv.SECTION_CLIENT, 1, fv.LABEL_CLIENT_CODE, shown("codigo_cliente")),
        _line(fv.SECTION_CLIENT, 2, fv.LABEL_NAME, shown("razon_social_cliente")),
        _line(fv.SECTION_CLIENT, 3, fv.LABEL_ADDRESS, shown("direccion_cliente")),
        _line(fv.SECTION_CLIENT, 4, fv.LABEL_DISTRICT, shown("distrito")),
    )
    items = F.when(
        F.coalesce(F.size("items") > 0, F.lit(False)),
        F.flatten(F.transform("items", _item_lines)),
    ).otherwise(
        F.array(_line(fv.SECTION_ITEMS, 0, fv.LABEL_NO_ITEMS, F.lit(None)))
    )
    sums = F.array(
        _line(fv.SECTION_TOTALS, 1, fv.LABEL_SUBTOTAL, amount(F.col("subtotal"))),
        _line(fv.SECTION_TOTALS, 2, fv.LABEL_VAT, amount(F.col("igv"))),
        _line(fv.SECTION_TOTALS, 3, fv.LABEL_TOTAL, amount(F.col("total"))),
    )
    percent = _or_zero(F.col("detraccion.porcentaje"), "decimal(9,2)")
    withheld = _or_zero(F.col("detraccion.monto"))
    deduction = F.when(
        (percent > 0) | (withheld > 0),
        F.array(
            _line(
                fv.SECTION_DEDUCTION,
                1,
                fv.LABEL_PERCENT,
                F.concat(nm.shortest_text(percent), F.lit("%")),
            ),
            _line(fv.SECTION_DEDUCTION, 2, fv.LABEL_DEDUCTION, amount(withheld)),
        ),
    )
    payment = F.array(
        _line(fv.SECTION_PAYMENT, 1, fv.LABEL_PAYMENT, shown("forma_pago")),
        _line(fv.SECTION_PAYMENT, 2, fv.LABEL_CURRENCY, F.col("report_currency")),
    )
    blocks = F.flatten(
        F.array_compact(F.array(document, client, items, sums, deduction, payment))
    )
    return invoices.withColumn("report_currency", currency).select(
        F.col("id").alias("factura_id"),
        F.col("report_currency").alias("moneda"),
        blocks.alias("lines"),
    )
