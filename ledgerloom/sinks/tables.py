"""Writers: nested ledger, report files, request files, database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv


def append_ledger(stored: DataFrame, path: str) -> None:
    """Append header and items of each invoice as one nested row.

    One table, one job: a header can never be visible without its items.
    """
    stored.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ledger_item_view(ledger: DataFrame) -> DataFrame:
    """The items of a nested ledger, one per row."""
    return ledger.select(F.col("id").alias("factura_id"), F.inline("items"))


def export_report(report: DataFrame, path: str) -> None:
    """CSV files in one folder per known currency, and one for all others.

    Currencies are free text of a model, so their number is not bounded; the value
    stays a column.  The rebalance hint lets adaptive execution cut the output into
    files of even size, however unevenly the currencies are spread.
    """
    known = F.when(F.col("moneda").isin(*fv.CURRENCIES_FORM), F.col("moneda")).otherwise("other")
    (
        report.withColumn("currency_folder", known)
        .hint("rebalance", "currency_folder")
        .write.mode("errorifexists")
        .partitionBy("currency_folder")
        .option("header", True)
        .csv(path)
    )


def write_requests(requests: DataFrame, path: str) -> None:
    """Chat requests as JSON lines."""
    rows = requests.select(
        F.to_json(
            F.struct(
                F.col("doc_id").cast("string").alias("custom_id"),
                F.parse_json("request").alias("body"),
            )
        ).alias("value")
    )
    rows.write.mode("errorifexists").option("compression", "gzip").text(path)


def append_jdbc(rows: DataFrame, url: str, table: str, **properties: str) -> None:
    """Append rows to a database table in batches from the tasks."""
    options = {"batchsize": "10000", **properties}
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
