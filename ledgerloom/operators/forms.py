"""Edit form: from form texts to a payload, and from an invoice to form texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as nm
from ledgerloom.schemas import MONEY

_TEXT_FIELDS = (
    "codigo_cliente",
    "razon_social_cliente",
    "direccion_cliente",
    "distrito",
    "forma_pago",
    "moneda",
)
_AMOUNTS = ("subtotal", "igv", "total")


def _read_item(item: Column) -> Column:
    return F.struct(
        F.coalesce(item["descripcion"], F.lit("")).alias("descripcion"),
        nm.read_integer(item["cantidad"]).cast("decimal(18,4)").alias("cantidad"),
        nm.read_number(item["precio_unitario"]).alias("precio_unitario"),
        nm.read_number(item["subtotal"]).alias("subtotal"),
    )


def form_items(forms: DataFrame) -> DataFrame:
    """Read the item texts; keep items with a description or a positive quantity."""
    read = F.transform("items", _read_item)
    return forms.withColumn("items", read).withColumn(
        "items",
        F.filter("items", lambda item: (item["descripcion"] != "") | (item["cantidad"] > 0)),
    )


def payload(forms: DataFrame) -> DataFrame:
    """Form texts as an invoice: empty text and zero amounts become null.

    A deduction exists when its percent or its amount is positive.
    """
    percent = nm.read_number(F.col("porcentaje_detraccion"), "decimal(9,2)")
    amount = nm.read_number(F.col("monto_detraccion"))
    withheld = F.when(
        (percent > 0) | (amount > 0),
        F.struct(percent.alias("porcentaje"), amount.alias("monto")),
    )
    texts = {name: F.nullif(F.col(name), F.lit("")) for name in _TEXT_FIELDS}
    amounts = {name: nm.null_if_zero(nm.read_number(F.col(name))) for name in _AMOUNTS}
    return (
        form_items(forms)
        .withColumns({**texts, **amounts, "detraccion": withheld})
        .drop("porcentaje_detraccion", "monto_detraccion")
    )


def _two_decimals(value: Column) -> Column:
    return F.when(value != 0, value.cast(MONEY).cast("string")).otherwise(F.lit(""))


def fill(invoices: DataFrame) -> DataFrame:
    """Invoice values as the form shows them.

    Missing fields are empty, a missing deduction shows 0 and 0, and item
    prices and subtotals have two decimals, blank when they are 0 or missing.
    """

    def item(x: Column) -> Column:
        quantity = F.when(x["cantidad"] != 0, nm.shortest_text(x["cantidad"])).otherwise("")
        return F.struct(
            F.coalesce(x["descripcion"], F.lit("")).alias("descripcion"),
            quantity.alias("cantidad"),
            _two_decimals(x["precio_unitario"]).alias("precio_unitario"),
            _two_decimals(x["subtotal"]).alias("subtotal"),
        )

    texts = {name: F.coalesce(name, F.lit("")) for name in _TEXT_FIELDS}
    amounts = {
        name: F.coalesce(nm.shortest_text(F.col(name)), F.lit("")) for name in _AMOUNTS
    }
    absent = F.col("detraccion").isNull()

    def withheld(part: str) -> Column:
        shown = F.coalesce(nm.shortest_text(F.col(f"detraccion.{part}")), F.lit(""))
        return F.when(absent, F.lit("0")).otherwise(shown)

    return invoices.withColumns(
        {
            **texts,
            **amounts,
            "porcentaje_detraccion": withheld("porcentaje"),
            "monto_detraccion": withheld("monto"),
            "items": F.transform("items", item),
        }
    ).drop("detraccion")


def items_present(invoices: DataFrame) -> DataFrame:
    """Add ``items_present``: there is an item list and it is not empty."""
    return invoices.withColumn(
        "items_present", F.coalesce(F.size("items") > 0, F.lit(False))
    )
