"""JSON expressions: strict object gate, typed parse, key count, payload text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import bind
from ledgerloom.schemas import MONEY, RAW_INVOICE

_STRICT = {"allowSingleQuotes": "false"}


def is_json_object(text: Column) -> Column:
    """True when the whole text is exactly one JSON object.

    ``from_json`` reads the first value and ignores what follows it.  The text
    is therefore read inside a list and again as a member of an object: after a
    complete value, only ``,`` or the closing bracket may follow in each
    context, and no continuation is valid in both.  The text passes both reads
    only when it is one value with nothing behind it.  Neither schema names a
    member of the text, so the reader checks it without building any value.  The
    text is computed once for all its uses.
    """
    return F.coalesce(bind(text, _is_one_object), F.lit(False))


def _is_one_object(text: Column) -> Column:
    in_list = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), "ARRAY<STRUCT<none: STRING>>", _STRICT
    )
    in_object = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")),
        "STRUCT<malformed: STRING>",
        {**_STRICT, "columnNameOfCorruptRecord": "malformed"},
    )
    return (
        text.startswith("{")
        & text.endswith("}")
        & (F.size(in_list) == 1)
        & in_object["malformed"].isNull()
        & ~_has_signed_infinity(text)
    )


def _has_signed_infinity(text: Column) -> Column:
    """The number tokens +INF, -INF and +Infinity, which only the reader knows.

    Looked for outside of string literals, and only where the letters occur.
    """
    unescaped = F.regexp_replace(text, r"\\.", "")
    outside = F.regexp_replace(unescaped, '"[^"]*"', "")
    found = F.regexp_like(outside, F.lit(r"[+-]INF|\+Infinity"))
    return F.when(text.contains("INF") | text.contains("+Infinity"), found).otherwise(False)


def parse_raw(text: Column) -> Column:
    """The invoice contract with amounts as wide as they were written."""
    return F.from_json(text, RAW_INVOICE, _STRICT)


def to_stored(raw: Column) -> dict[str, Column]:
    """Contract fields at their stored precision, by name.

    An amount that does not fit becomes null; one absurd reply must not end
    the job.
    """

    def item(x: Column) -> Column:
        return F.struct(
            x["descripcion"].alias("descripcion"),
            x["cantidad"].try_cast("decimal(18,4)").alias("cantidad"),
            x["precio_unitario"].try_cast(MONEY).alias("precio_unitario"),
            x["subtotal"].try_cast(MONEY).alias("subtotal"),
        )

    withheld = F.struct(
        raw["detraccion"]["porcentaje"].try_cast("decimal(9,2)").alias("porcentaje"),
        raw["detraccion"]["monto"].try_cast(MONEY).alias("monto"),
    )
    return {
        "codigo_cliente": raw["codigo_cliente"],
        "razon_social_cliente": raw["razon_social_cliente"],
        "direccion_cliente": raw["direccion_cliente"],
        "distrito": raw["distrito"],
        "items": F.transform(raw["items"], item),
        "forma_pago": raw["forma_pago"],
        "moneda": raw["moneda"],
        "subtotal": raw["subtotal"].try_cast(MONEY),
        "igv": raw["igv"].try_cast(MONEY),
        "total": raw["total"].try_cast(MONEY),
        "detraccion": F.when(raw["detraccion"].isNotNull(), withheld),
    }


def key_count(text: Column) -> Column:
    """Number of different top-level keys."""
    keys = F.map_keys(F.from_json(text, "MAP<STRING, STRING>", _STRICT))
    return F.size(F.array_distinct(keys))


def payload_text(fields: Column) -> Column:
    """Compact JSON that keeps null members."""
    return F.to_json(fields, {"ignoreNullFields": "false"})
