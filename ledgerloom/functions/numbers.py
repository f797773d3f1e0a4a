"""Number expressions: sizes, lenient reading, money, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.schemas import MONEY

_INTEGER_PREFIX = r"\A\s*([+-]?[0-9]+)"
_NUMBER_PREFIX = r"\A\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def megabytes(size_bytes: Column) -> Column:
    return size_bytes / F.lit(float(fv.BYTES_PER_MB))


def rounded_megabytes(size_bytes: Column, digits: int = 2) -> Column:
    """Ties go to the even digit; the quotient is exact in binary."""
    return F.bround(megabytes(size_bytes), digits)


def one_decimal(value: Column) -> Column:
    """Text with one decimal, ties to even."""
    return F.format_string("%.1f", F.bround(value, 1))


def read_integer(text: Column) -> Column:
    """Leading integer of a text, 0 when there is none."""
    digits = F.regexp_extract(text, _INTEGER_PREFIX, 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def read_number(text: Column, as_type: str = MONEY) -> Column:
    """Leading decimal number of a text, 0 when there is none."""
    digits = F.regexp_extract(text, _NUMBER_PREFIX, 1)
    return F.coalesce(digits.try_cast(as_type), F.lit(0).cast(as_type))


def null_if_zero(value: Column) -> Column:
    return F.when(value != 0, value)


def money(value: Column) -> Column:
    """Two decimals, ties away from zero; null when it does not fit."""
    return value.try_cast(MONEY)


def item_subtotal(quantity: Column, price: Column) -> Column:
    """Whole part of the quantity times the price; unreadable parts count as 0."""
    whole = F.coalesce(quantity.try_cast("decimal(38,6)").try_cast("bigint"), F.lit(0))
    return money(whole * F.coalesce(price, F.lit(0).cast(MONEY)))


def vat(subtotal: Column) -> Column:
    return money(subtotal * F.lit(fv.VAT_RATE).cast("decimal(3,2)"))


def total_with_vat(subtotal: Column) -> Column:
    """Subtotal plus the unrounded VAT, rounded once."""
    return money(subtotal + subtotal * F.lit(fv.VAT_RATE).cast("decimal(3,2)"))


def deduction(total: Column, percent: Column, previous: Column | None = None) -> Column:
    """Share of the total withheld.

    A percent of 0 or none clears the amount; a percent without a positive
    total keeps the previous amount.
    """
    total = F.coalesce(total, F.lit(0).cast(MONEY))
    percent = F.coalesce(percent, F.lit(0).cast("decimal(9,2)"))
    kept = F.lit(None).cast(MONEY) if previous is None else previous
    amount = money(total * percent / F.lit(100))
    return F.when((total > 0) & (percent > 0), amount).when(percent == 0, None).otherwise(kept)


def within_tolerance(left: Column, right: Column) -> Column:
    """Equal up to one cent; false when only one side is missing."""
    close = F.abs(left - right) <= F.lit(fv.TOLERANCE).cast("decimal(3,2)")
    return F.coalesce(close, left.isNull() & right.isNull())


def token_cost(tokens: Column) -> Column:
    return tokens / F.lit(1000.0) * F.lit(fv.USD_PER_1000_TOKENS)


def model_cost(model: Column, read: Column, written: Column) -> Column:
    """Cost of a call by the prices of its model; null where the model has no price."""
    cost = F
    for name, (price, output_price) in fv.MODEL_PRICES.items():
        sum_ = read * F.lit(price) + written * F.lit(output_price)
        cost = cost.when(model == name, sum_ / F.lit(1000.0))
    return cost


def money_text(value: Column) -> Column:
    """``1,234.50``."""
    return F.format_number(value, 2)


def currency_text(currency: Column, value: Column) -> Column:
    """``PEN 1,234.50``."""
    return F.concat(currency, F.lit(" "), money_text(value))


def shortest_text(value: Column) -> Column:
    """A decimal without trailing zeros: ``12``, ``12.5``."""
    return F.regexp_replace(value.cast("string"), r"\.0+$|(\.[0-9]*[1-9])0+$", "$1")
