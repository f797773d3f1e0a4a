"""Table sources: Parquet, JSON payloads, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import replies as rp
from ledgerloom.functions import text as tx


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table read as a stream of files."""
    schema = table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(folder)
    )


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Edited invoice payloads, one JSON object per line, with the file name if sent.

    Every line is one row.  A line that is not exactly one JSON object has null
    fields, ``accepted`` false and the error; ``body`` is the line as received.
    """
    lines = spark.read.text(folder).select(tx.strip(F.col("value")).alias("body"))
    judged = lines.withColumn("accepted", rp.is_json_object(F.col("body")))
    whole = F.when(F.col("accepted"), rp.parse_raw(F.col("body")))
    name = F.get_json_object(F.when(F.col("accepted"), F.col("body")), "$._filename")
    parsed = judged.withColumn("raw", whole).withColumn("filename", name)
    fields = [value.alias(field) for field, value in rp.to_stored(F.col("raw")).items()]
    error = F.when(~F.col("accepted"), F.lit(fv.BAD_REPLY)).alias("error")
    return parsed.select(*fields, "filename", "body", "accepted", error)


def jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    **properties: str,
) -> DataFrame:
    """A database table read in parallel ranges of its numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=key, numPartitions=str(partitions))
        .options(lowerBound=str(lower), upperBound=str(upper), fetchsize="10000", **properties)
        .load()
    )
