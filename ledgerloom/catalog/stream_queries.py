"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.catalog import inputs as inp
from ledgerloom.catalog.file_queries import LIMIT, VERDICT_SQL, landing
from ledgerloom.catalog.job_queries import LATEST_SQL
from ledgerloom.catalog.registry import query
from ledgerloom.catalog.reply_queries import AS_OF, INVOICE_COLUMNS
from ledgerloom.sources.tables import table_stream
from ledgerloom.streaming import intake, job_table, jobs, ledger


@query("stream_intake", VERDICT_SQL)
def stream_intake(spark, folder):
    base = session.fresh_path(spark, "stream-intake")
    out = f"{base}/verdicts"
    intake.follow(spark, landing(spark, folder), out, f"{base}/checkpoint", LIMIT).awaitTermination()
    return intake.verdicts(spark, out)


@query("stream_job_state", LATEST_SQL)
def stream_job_state(spark, folder):
    base = session.fresh_path(spark, "stream-jobs")
    events = inp.job_events_from(spark, table_stream(spark, folder, "events"))
    jobs.start(events, f"{base}/states", f"{base}/checkpoint").awaitTermination()
    return jobs.current(spark, f"{base}/states")


@query("stream_job_table", LATEST_SQL)
def stream_job_table(spark, folder):
    base = session.fresh_path(spark, "stream-job-table")
    events = inp.job_events_from(spark, table_stream(spark, folder, "events"))
    job_table.start(events, f"{base}/ended", f"{base}/checkpoint").awaitTermination()
    return job_table.current(spark, f"{base}/ended", f"{base}/checkpoint")


LEDGER_SQL = (
    inp.cte(*inp.INVOICE_CTE)
    + "select v.id, 'FACT-' || upper(substring(sha256(v.id::varchar), 1, 8)) as codigo_factura, "
    f"'2024-06-30' as fecha_emision, {INVOICE_COLUMNS} v.subtotal, igv, total, "
    "(select count(*) from lines l where l.id = v.id and l.descripcion <> '') as items_stored "
    "from invoices v"
)


@query("stream_ledger", LEDGER_SQL)
def stream_ledger(spark, folder):
    base = session.fresh_path(spark, "stream-ledger")
    _take_in(spark, folder, base, "checkpoint")
    return _ledger(spark, base)


@query("stream_ledger_again", LEDGER_SQL)
def stream_ledger_again(spark, folder):
    """All replies twice, the second time without the first run's checkpoint."""
    base = session.fresh_path(spark, "stream-ledger")
    _take_in(spark, folder, base, "checkpoint")
    _take_in(spark, folder, base, "second")
    return _ledger(spark, base)


def _take_in(spark, folder, base, checkpoint):
    arriving = spark.readStream.schema(inp.replies(spark, folder).schema).parquet(
        inp.replies_path(spark, folder)
    )
    ledger.start(
        arriving.select("doc_id", "content", "total_tokens"),
        f"{base}/ledger",
        f"{base}/{checkpoint}",
        AS_OF,
    ).awaitTermination()


def _ledger(spark, base):
    return spark.read.parquet(f"{base}/ledger").select(
        "id",
        "codigo_factura",
        "fecha_emision",
        "codigo_cliente",
        "razon_social_cliente",
        "direccion_cliente",
        "distrito",
        "forma_pago",
        "moneda",
        "subtotal",
        "igv",
        "total",
        F.size("items").alias("items_stored"),
    )
