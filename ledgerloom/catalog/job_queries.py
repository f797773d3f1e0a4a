"""Queries over job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog import inputs as inp
from ledgerloom.catalog.registry import query, stamp
from ledgerloom.functions.rows import present
from ledgerloom.operators import jobs, replies
from ledgerloom.sources.tables import table

RECORD_CTE = inp.EVENT_CTE + [
    (
        "records",
        "select job_id, arg_max(status, (ts, event_id)) as status, "
        "min(ts) as created_at, max(ts) filter (where status = 'PROCESSING') as started_at, "
        "max(ts) filter (where status in ('COMPLETED', 'FAILED')) as completed_at, "
        "min(ts) filter (where status = 'PROCESSING') as first_started_at, "
        "max(filename) as filename, max(size_bytes) as size_bytes "
        "from fx_events group by job_id",
    ),
    (
        "numbered",
        "select *, row_number() over (partition by job_id order by ts desc, event_id desc) as n "
        "from fx_events",
    ),
    (
        "jobs",
        "select r.*, l.error, l.ts, l.event_id from records r "
        "join numbered l on l.job_id = r.job_id and l.n = 1",
    ),
]


def _jobs(spark, folder):
    return jobs.records(inp.job_events(spark, folder))


LATEST_SQL = (
    inp.cte(*RECORD_CTE)
    + f"select job_id, status, error, {stamp('ts')} as ts, event_id from jobs"
)


@query("job_latest", LATEST_SQL)
def job_latest(spark, folder):
    return jobs.latest(inp.job_events(spark, folder))


@query(
    "job_status_view",
    inp.cte(*RECORD_CTE)
    + f"select job_id, status, filename, {stamp('created_at')} as created_at, "
    f"case when status = 'PROCESSING' then {stamp('started_at')} end as started_at, "
    f"case when status in ('COMPLETED', 'FAILED') then {stamp('completed_at')} end "
    "as completed_at, case when status = 'COMPLETED' then true end as result_available, "
    "case when status = 'FAILED' then error end as error from jobs",
)
def job_status_view(spark, folder):
    return jobs.status_view(_jobs(spark, folder))


@query(
    "job_list",
    inp.cte(*RECORD_CTE)
    + f"select job_id, status, filename, {stamp('created_at')} as created_at, "
    f"case when status = 'COMPLETED' then {stamp('completed_at')} end as completed_at, "
    "case when status = 'FAILED' then coalesce(error, 'Unknown error') end as error "
    "from (select * from jobs order by created_at desc, job_id limit 10) as t",
)
def job_list(spark, folder):
    return jobs.recent(_jobs(spark, folder), 10)


@query(
    "job_health",
    inp.cte(*RECORD_CTE)
    + "select count(*) as total_jobs, (count(*) filter (where status in "
    "('PENDING', 'PROCESSING')))::bigint as active_jobs from jobs",
)
def job_health(spark, folder):
    return jobs.health(_jobs(spark, folder))


@query(
    "job_timing",
    inp.cte(*RECORD_CTE)
    + f"select job_id, {stamp('created_at')} as created_at, "
    f"{stamp('first_started_at')} as first_started_at, "
    f"{stamp('completed_at')} as last_completed_at, "
    "(epoch_us(completed_at) - epoch_us(first_started_at)) // 1000 as duration_ms from jobs",
)
def job_timing(spark, folder):
    return jobs.timing(inp.job_events(spark, folder))


def _deleted(spark, folder):
    """Ids to delete: customers by number, of whom some have jobs."""
    return table(spark, folder, "customer").select((F.col("c_custkey") * 3).alias("job_id"))


DELETED_SQL = "(select distinct 3 * c_custkey as job_id from customer)"


@query(
    "jobs_after_delete",
    inp.cte(*RECORD_CTE)
    + f"select job_id, status from jobs where job_id not in (select job_id from {DELETED_SQL} d)",
)
def jobs_after_delete(spark, folder):
    kept = jobs.without_deleted(_jobs(spark, folder), _deleted(spark, folder))
    return kept.select("job_id", "status")


@query(
    "jobs_deleted",
    inp.cte(*RECORD_CTE)
    + "select d.job_id, j.filename, j.status, j.job_id is not null as found "
    f"from {DELETED_SQL} d left join jobs j on j.job_id = d.job_id",
)
def jobs_deleted(spark, folder):
    return jobs.deleted_jobs(_jobs(spark, folder), _deleted(spark, folder))


@query(
    "job_results",
    inp.cte(*RECORD_CTE, *inp.INVOICE_CTE)
    + "select v.id as job_id, 'COMPLETED' as status, 11::bigint as field_count, "
    "cast(200 + v.id % 1300 + case when v.id % 9 = 4 then 1000 else 0 end as bigint) "
    "as tokens_used, v.razon_social_cliente, v.moneda, "
    "v.total, len(v.items) as n_items, j.filename, "
    "round_even(j.size_bytes / 1048576.0::double, 2)::double as file_size_mb, "
    f"{stamp('j.created_at')} as created_at, {stamp('j.completed_at')} as completed_at "
    "from invoices v join jobs j on j.job_id = v.id where j.status = 'COMPLETED'",
)
def job_results(spark, folder):
    recorded = _jobs(spark, folder)
    # Only replies of completed jobs are gated and parsed.
    done = recorded.where(F.col("status") == fv.COMPLETED).select(F.col("job_id").alias("doc_id"))
    wanted = inp.replies(spark, folder).join(done, "doc_id", "left_semi")
    extracted = replies.one_per_document(wanted).select(
        F.col("doc_id").alias("job_id"),
        "status",
        "field_count",
        F.col("tokens").alias("tokens_used"),
        present(F.col("extracted_data")).alias("data"),
    )
    return jobs.results(recorded, extracted).select(
        "job_id",
        "status",
        "field_count",
        "tokens_used",
        "data.razon_social_cliente",
        "data.moneda",
        "data.total",
        F.size("data.items").alias("n_items"),
        "filename",
        "file_size_mb",
        "created_at",
        "completed_at",
    )
