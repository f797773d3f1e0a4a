"""Ledger statistics from stored sketches that can be merged.

One row a day and currency holds counts, sums, a HyperLogLog sketch of the clients and a
quantile sketch of the totals.  Any range of days is answered from these rows, and an
update reads the days that are not stored yet.

    path/until-<day>   rows of the days up to that one that were not stored before
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import folders

#: Bits of the number of HyperLogLog registers: 2^14, a standard error of 0.8 %.
REGISTERS = 14
#: Size of a quantile sketch: ranks are within about 0.7 %.
QUANTILE_SIZE = 400

_UNTIL = "until-"


def daily(headers: DataFrame) -> DataFrame:
    """``day, moneda`` with invoices, invoices with a total, sum of totals and two sketches."""
    total = F.col("total").cast("double")
    return headers.groupBy(F.to_date("fecha_registro").alias("day"), "moneda").agg(
        F.count("*").alias("invoices"),
        F.count("total").alias("with_total"),
        F.sum("total").alias("total"),
        F.hll_sketch_agg("codigo_cliente", REGISTERS).alias("clients"),
        F.kll_sketch_agg_double(total, F.lit(QUANTILE_SIZE)).alias("totals"),
    )


def merged(stored: DataFrame, *by: str) -> DataFrame:
    """Statistics over stored rows, by any of their keys.

    ``total_clientes`` is an estimate, ``median`` and ``p95`` are quantiles by rank; counts
    and sums are exact.  Sketches merge on the map side, so a key with very many rows
    reaches the shuffle as one sketch a task.
    """
    united = stored.groupBy(*by).agg(
        F.sum("invoices").alias("total_facturas"),
        F.sum("total").alias("monto_total"),
        F.sum("with_total").alias("with_total"),
        F.hll_union_agg("clients").alias("clients"),
        F.kll_merge_agg_double("totals").alias("totals"),
    )
    some = F.col("with_total") > 0
    return united.select(
        *by,
        "total_facturas",
        "monto_total",
        F.try_divide("monto_total", "with_total").alias("promedio_factura"),
        F.hll_sketch_estimate("clients").alias("total_clientes"),
        F.when(some, F.kll_sketch_get_quantile_double("totals", F.lit(0.5))).alias("median"),
        F.when(some, F.kll_sketch_get_quantile_double("totals", F.lit(0.95))).alias("p95"),
    )


def stored_until(spark: SparkSession, path: str) -> datetime.date | None:
    """The last day that is stored."""
    days = [
        datetime.date.fromisoformat(name.removeprefix(_UNTIL))
        for name in folders.names(spark, path)
        if name.startswith(_UNTIL) and folders.complete(spark, f"{path}/{name}")
    ]
    return max(days, default=None)


def fresh(headers: DataFrame, after: datetime.date | None, until: datetime.date) -> DataFrame:
    """Headers of the days after one and up to another.

    Plain bounds on the stored column, which reach the scan.
    """
    first_left_out = datetime.datetime.combine(until + datetime.timedelta(days=1), datetime.time())
    kind = headers.schema["fecha_registro"].dataType
    rows = headers.where(F.col("fecha_registro") < F.lit(first_left_out).cast(kind))
    if after is None:
        return rows
    first = datetime.datetime.combine(after + datetime.timedelta(days=1), datetime.time())
    return rows.where(F.col("fecha_registro") >= F.lit(first).cast(kind))


def update(headers: DataFrame, path: str, until: datetime.date) -> None:
    """Store the days up to ``until`` that are not stored yet.

    A stored day is closed: rows that get an earlier time later are not counted until
    ``rebuild``.  Headers without a time belong to no day.  A run that ends early leaves
    nothing that counts.
    """
    spark = headers.sparkSession
    after = stored_until(spark, path)
    if after is not None and until <= after:
        return
    daily(fresh(headers, after, until)).write.mode("overwrite").parquet(f"{path}/{_UNTIL}{until.isoformat()}")


def rebuild(headers: DataFrame, path: str, until: datetime.date) -> None:
    """Store all days anew."""
    folders.remove(headers.sparkSession, path)
    update(headers, path, until)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows."""
    places = [
        f"{path}/{name}"
        for name in folders.names(spark, path)
        if name.startswith(_UNTIL) and folders.complete(spark, f"{path}/{name}")
    ]
    if not places:
        raise ValueError(f"no statistics at {path}")
    return spark.read.parquet(*places)
