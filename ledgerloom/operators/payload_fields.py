"""Fields of payloads whose shape is not known: the VARIANT type, opened level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import replies as rp
from ledgerloom.schemas import INVOICE_FIELDS, ITEM_FIELDS

#: Paths of the contract; everything else in a payload is an extra field.
CONTRACT = frozenset(
    [
        *INVOICE_FIELDS,
        "items[]",
        *[f"items[].{name}" for name in ITEM_FIELDS],
        "detraccion.porcentaje",
        "detraccion.monto",
    ]
)

#: Levels that are opened by default.
DEPTH = 4

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def opened(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Add ``payload``: the body as VARIANT, null where it is not exactly one JSON object."""
    # The VARIANT reader ignores what follows the first value, so the gate comes first.
    whole = F.when(rp.is_json_object(F.col(body)), F.col(body))
    return payloads.withColumn("payload", F.try_parse_json(whole))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER, BOOLEAN or NULL."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return (
        F.when(name == "VOID", "NULL").when(name.isin(*_NUMBERS), "NUMBER").otherwise(name)
    )


def fields(payloads: DataFrame, body: str = "body", depth: int = DEPTH) -> DataFrame:
    """``path, type``: one row for each member and element of each payload.

    Members are named by their path, elements of a list share ``path[]``.  ``depth``
    levels are opened; what lies deeper shows as the OBJECT or ARRAY that holds it.
    Rows are exploded level by level, and only values that can be opened go on.
    """
    session = payloads.sparkSession
    level = opened(payloads, body).where("payload is not null").select(F.lit("").alias("path"), "payload")
    found = None
    for _ in range(depth):
        inner = session.sql(
            "select t.path as outer_path, e.key, e.value as payload "
            "from {level} t, lateral variant_explode(t.payload) e",
            level=level,
        )
        name = (
            F.when(F.col("key").isNull(), F.concat("outer_path", F.lit("[]")))
            .when(F.col("outer_path") == "", F.col("key"))
            .otherwise(F.concat_ws(".", "outer_path", "key"))
        )
        rows = inner.select(name.alias("path"), "payload", _kind(F.col("payload")).alias("type"))
        found = rows.select("path", "type") if found is None else found.union(rows.select("path", "type"))
        level = rows.where(F.col("type").isin("OBJECT", "ARRAY")).select("path", "payload")
    return found


def inventory(payloads: DataFrame, body: str = "body", depth: int = DEPTH) -> DataFrame:
    """``path, type, times, in_contract`` over all payloads.

    Each task counts its own fields first, so the shuffle has a row per path, type and task.
    """
    counted = fields(payloads, body, depth).groupBy("path", "type").agg(F.count("*").alias("times"))
    return counted.withColumn("in_contract", F.col("path").isin(*sorted(CONTRACT)))


def extras(payloads: DataFrame, body: str = "body", depth: int = DEPTH) -> DataFrame:
    """Fields outside of the contract, with how often each occurs with each type."""
    return inventory(payloads, body, depth).where(~F.col("in_contract")).drop("in_contract")


def shape(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row: the schema that holds all payloads, and their number."""
    return opened(payloads, body).agg(
        F.schema_of_variant_agg("payload").alias("schema"), F.count("payload").alias("payloads")
    )


def value_at(body: Column, path: str, kind: str) -> Column:
    """A member of a payload at a path like ``$.extra.name``; null if absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(body), path, kind)
