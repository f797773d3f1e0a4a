"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import fresh_path

#: White space of the word rules: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Written tables of the blocks of `scratch` that are open, inner ones last.
_OPEN: list[list[str]] = []


def saved(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Cuts the lineage in a way that outlives lost executors, and fixes the values
    of anything that depends on how tasks were dealt.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    rows.write.options(**options).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that `saved` writes inside of the block when it ends.

    What is needed of them must have been written elsewhere by then.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.pop()
        jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(configuration).delete(place, True)


def text_of(column: str | Column) -> Column:
    """A text column with nulls as empty texts."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def row_key(id_column: str, text_column: str) -> Column:
    """Key of a row that repeated rows share and that two different texts do not."""
    return F.sha2(
        F.concat_ws(
            "\x00", F.coalesce(F.col(id_column).cast("string"), F.lit("\x01")), text_of(text_column)
        ),
        256,
    )


def free_name(rows: DataFrame, wanted: str) -> str:
    """A column name that the rows do not have yet."""
    taken = {name.lower() for name in rows.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def split_mix(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, over an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def release() -> None:
    """Give memory that Arrow holds for reuse back to the system.

    Workers live on between stages, and what each keeps counts against its executor.
    """
    pa.default_memory_pool().release_unused()


def vocabulary_path(file: str) -> str:
    """Default place of a public vocabulary file; a folder can be given by the caller."""
    return os.path.join("/opt/tokenizers", file)
