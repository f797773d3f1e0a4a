"""Reply intake: accepted replies become ledger rows, each key once."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans import invoices
from ledgerloom.schemas import DEFAULTS, Settings
from ledgerloom.streaming.key_index import KeyIndex


def append_new(
    batch: DataFrame, path: str, day: datetime.date | None = None, settings: Settings = DEFAULTS
) -> None:
    """Append the batch without the keys the ledger already holds.

    One accepted reply is kept per key, chosen as everywhere.  Which keys are there is
    answered by the key index beside the ledger, of which a batch opens its own buckets;
    the ledger itself is not read.  Running a batch again, also after it was written in
    part, adds nothing twice.  A ledger has one writer at a time.
    """
    index = KeyIndex(batch.sparkSession, path)
    index.repair()
    rows = invoices.to_ledger(batch, day, settings)
    known = index.known(batch.select(F.col("doc_id").alias("id")).distinct())
    if known is not None:
        rows = rows.join(known, "id", "left_anti")
    index.append(rows)


def start(
    replies: DataFrame,
    path: str,
    checkpoint: str,
    day: datetime.date | None = None,
    settings: Settings = DEFAULTS,
) -> StreamingQuery:
    """Move a stream of ``doc_id, content, total_tokens`` into the ledger, then stop."""

    def save(batch: DataFrame, _: int) -> None:
        append_new(batch, path, day, settings)

    return (
        replies.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
