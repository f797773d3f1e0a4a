"""Contract checks: one boolean per rule, gathered in ``violations``.

Every check looks at one nested invoice only, so checking is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm
from ledgerloom.operators.money import nested_sum
from ledgerloom.schemas import MONEY


def _or_null(value: Column, rule: Column) -> Column:
    return value.isNull() | rule


def client_code_ok(code: Column) -> Column:
    return _or_null(code, F.regexp_like(code, F.lit(fv.CLIENT_CODE_PATTERN)))


def client_code_kind(code: Column) -> Column:
    """``RUC`` for 11 digits, ``DNI`` for 8, null otherwise."""
    length = F.when(F.regexp_like(code, F.lit(fv.CLIENT_CODE_PATTERN)), F.length(code))
    return F.when(length == 11, F.lit("RUC")).when(length == 8, F.lit("DNI"))


def payment_ok(method: Column) -> Column:
    return _or_null(method, method.isin(*fv.PAYMENT_METHODS))


def currency_ok(currency: Column, strict: bool = True) -> Column:
    allowed = fv.CURRENCIES_STRICT if strict else fv.CURRENCIES_FORM
    return _or_null(currency, currency.isin(*allowed))


def uppercase_ok(text: Column) -> Column:
    return _or_null(text, text == F.upper(text))


def no_punctuation_ok(text: Column) -> Column:
    return _or_null(text, ~F.regexp_like(text, F.lit("[,()]")))


def two_decimals_ok(raw: Column) -> Column:
    """No amount of the reply has more than two decimals."""

    def fine(value: Column) -> Column:
        return F.coalesce(F.round(value, 2) == value, F.lit(True))

    header = fine(raw["subtotal"]) & fine(raw["igv"]) & fine(raw["total"])
    withheld = fine(raw["detraccion"]["monto"]) & fine(raw["detraccion"]["porcentaje"])
    lines = F.coalesce(
        F.forall(raw["items"], lambda x: fine(x["precio_unitario"]) & fine(x["subtotal"])),
        F.lit(True),
    )
    return header & withheld & lines


def item_arithmetic_ok(items: Column) -> Column:
    """Each item subtotal is quantity times price."""
    return F.coalesce(
        F.forall(
            items,
            lambda x: nm.within_tolerance(
                x["subtotal"], nm.money(x["cantidad"] * x["precio_unitario"])
            ),
        ),
        F.lit(True),
    )


def sum_ok(subtotal: Column, items_sum: Column) -> Column:
    """Header subtotal is the sum of the items; a header without subtotal passes."""
    return _or_null(subtotal, nm.within_tolerance(subtotal, items_sum))


def vat_ok(base: Column, igv: Column) -> Column:
    """VAT is its share of the base; a reply without VAT passes."""
    return _or_null(igv, nm.within_tolerance(igv, nm.vat(base)))


def total_ok(base: Column, total: Column) -> Column:
    """Total is the base with VAT; a reply without total passes."""
    return _or_null(total, nm.within_tolerance(total, nm.total_with_vat(base)))


def deduction_ok(total: Column, withheld: Column) -> Column:
    """The amount is its share of the total, where a deduction is present."""
    wanted = nm.deduction(total, withheld["porcentaje"])
    amount = F.coalesce(withheld["monto"], F.lit(0).cast(MONEY))
    fine = nm.within_tolerance(amount, F.coalesce(wanted, F.lit(0).cast(MONEY)))
    return withheld.isNull() | fine


def has_items_ok(items: Column) -> Column:
    return F.coalesce(F.size(items) >= 1, F.lit(False))


RULES = (
    "client_code",
    "payment",
    "currency",
    "address_upper",
    "address_punctuation",
    "district_upper",
    "decimals",
    "item_arithmetic",
    "items_sum",
    "vat",
    "total",
    "deduction",
    "has_items",
)


def _verdicts(strict_currency: bool) -> dict[str, Column]:
    c = F.col
    # VAT and total are computed from the subtotal, or else from the items.
    base = F.coalesce(c("subtotal"), nm.money(c("items_sum")))
    return {
        "client_code": client_code_ok(c("codigo_cliente")),
        "payment": payment_ok(c("forma_pago")),
        "currency": currency_ok(c("moneda"), strict_currency),
        "address_upper": uppercase_ok(c("direccion_cliente")),
        "address_punctuation": no_punctuation_ok(c("direccion_cliente")),
        "district_upper": uppercase_ok(c("distrito")),
        "decimals": two_decimals_ok(c("raw")),
        "item_arithmetic": item_arithmetic_ok(c("items")),
        "items_sum": sum_ok(c("subtotal"), c("items_sum")),
        "vat": vat_ok(base, c("igv")),
        "total": total_ok(base, c("total")),
        "deduction": deduction_ok(c("total"), c("detraccion")),
        "has_items": has_items_ok(c("items")),
    }


def check(invoices: DataFrame, strict_currency: bool = True) -> DataFrame:
    """Add one ``ok_<rule>`` column per rule."""
    summed = invoices.withColumn("items_sum", nested_sum(F.col("items")))
    return summed.withColumns(
        {f"ok_{rule}": ok for rule, ok in _verdicts(strict_currency).items()}
    ).drop("items_sum")


def violations(invoices: DataFrame, strict_currency: bool = True) -> DataFrame:
    """Add ``violations ARRAY<STRING>``: the names of the rules not kept."""
    broken = [
        F.when(~ok, F.lit(rule)) for rule, ok in _verdicts(strict_currency).items()
    ]
    summed = invoices.withColumn("items_sum", nested_sum(F.col("items")))
    return summed.withColumn("violations", F.array_compact(F.array(*broken))).drop("items_sum")


def summary(invoices: DataFrame, strict_currency: bool = True) -> DataFrame:
    """``rule, invoices, failing, share`` for every rule, from one pass.

    All counts are taken in one global aggregate, which leaves a single row,
    and only that row is turned into one row per rule.
    """
    checked = check(invoices, strict_currency)
    counts = checked.agg(
        F.count(F.lit(1)).alias("invoices"),
        *[F.count_if(~F.col(f"ok_{rule}")).alias(rule) for rule in RULES],
    )
    lines = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failing")) for r in RULES]
    )
    return counts.select("invoices", F.inline(lines)).select(
        "rule",
        "invoices",
        "failing",
        F.round(F.try_divide(F.col("failing"), F.col("invoices")), 6).alias("share"),
    )


def completeness(invoices: DataFrame, least: float = fv.COMPLETENESS) -> DataFrame:
    """Add ``completeness_score``, the share of filled contract fields, and ``complete``.

    A field is filled when it is not null, not an empty text and not an empty list; a
    deduction when it has a percentage.
    """
    texts = ("codigo_cliente", "razon_social_cliente", "direccion_cliente", "distrito")
    filled = [F.coalesce(F.col(n) != "", F.lit(False)) for n in (*texts, "forma_pago", "moneda")]
    filled += [F.col(n).isNotNull() for n in ("subtotal", "igv", "total", "detraccion.porcentaje")]
    filled.append(F.coalesce(F.size("items") > 0, F.lit(False)))
    share = sum((f.cast("int") for f in filled), F.lit(0)) / F.lit(float(len(filled)))
    return invoices.withColumn("completeness_score", share).withColumn(
        "complete", F.col("completeness_score") >= least
    )
