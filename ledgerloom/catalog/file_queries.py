"""Queries over files in a landing folder.

The files are written by Spark from ``documents``, once per session and table
folder, below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.catalog import inputs as inp
from ledgerloom.catalog.document_queries import PROMPTED_CTE, REQUEST_SQL
from ledgerloom.catalog.registry import literal, query
from ledgerloom import fixed_values as fv
from ledgerloom.operators import intake
from ledgerloom.plans import flow
from ledgerloom.plans.intake import pdf_verdicts
from ledgerloom.schemas import Settings
from ledgerloom.sources import files
from ledgerloom.sources import landing as landing_source

# The documents are small; with this limit some of them are too large.
LIMIT = Settings(max_size_mb=0.01)

LANDED_SQL = """
select doc_id,
  case when doc_id % 7 = 0 then concat('doc', cast(doc_id as string), '.txt')
       when doc_id % 5 = 0 then concat('doc', cast(doc_id as string), '.PDF')
       else concat('doc', cast(doc_id as string), '.pdf') end as filename,
  case when doc_id % 50 = 1 then '' when doc_id % 3 = 0 then text
       else concat('%PDF-1.4', chr(10), text) end as body
from {documents}
"""
LANDED_CTE = [
    ("landed", LANDED_SQL.format(documents="documents")),
    (
        "fx_files",
        "select filename, octet_length(encode(body)) as size_bytes, "
        "starts_with(body, '%PDF') as has_pdf_magic from landed",
    ),
]

_WRITTEN: dict[tuple[str, str], str] = {}


def landing(spark: SparkSession, folder: str) -> str:
    """The landing folder of a table folder, written on first use."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN:
        target = session.fresh_path(spark, "landing")
        landed = inp.sql(spark, LANDED_SQL, documents=inp.documents(spark, folder))
        content = F.encode("body", "utf-8").alias("content")
        files.write_files(landed.select("filename", content), target)
        _WRITTEN[key] = target
    return _WRITTEN[key]


REASON_SQL = (
    f"case when lower(filename) not like '%.pdf' then {literal(fv.NOT_PDF_NAME[1])} "
    f"when size_bytes > {LIMIT.max_size_bytes} then {literal(fv.TOO_LARGE_TEXT[0])} || "
    "printf('%.1f', size_bytes / 1048576.0::double) || "
    f"{literal(fv.TOO_LARGE_TEXT[1] + '0.01' + fv.TOO_LARGE_TEXT[2])} "
    f"when not has_pdf_magic then {literal(fv.NOT_PDF_CONTENT[1])} end"
)
VERDICT_SQL = (
    inp.cte(*LANDED_CTE)
    + "select filename, size_bytes, reason is null as accepted, case when reason is null then "
    f"null when reason like {literal(fv.TOO_LARGE_TEXT[0] + '%')} then 413 else 400 end::bigint "
    f"as code, reason from (select *, {REASON_SQL} as reason from fx_files) as t"
)


@query("pdf_scan", VERDICT_SQL + " where lower(filename) like '%.pdf'")
def pdf_scan(spark, folder):
    return pdf_verdicts(spark, landing(spark, folder), LIMIT)


def _pages(share: int):
    """A reader of the landed files that fails on some of them."""

    def read(content: bytes) -> list[str]:
        if len(content) % share == 1:
            raise ValueError(f"{len(content)} bytes")
        return content.decode("utf-8").split("\n")[1:]

    return read


READERS = {name: _pages(share) for name, share in zip(fv.EXTRACTION_METHODS, (2, 3, 5))}
METHOD_SQL = "case " + " ".join(
    f"when size_bytes % {share} <> 1 then '{name}'"
    for name, share in zip(fv.EXTRACTION_METHODS, (2, 3, 5))
) + " end"
RESULT_CTE = (
    PROMPTED_CTE
    + inp.REPLY_CTE
    + LANDED_CTE
    + [
        (
            "named",
            "select l.doc_id, l.filename, octet_length(encode(l.body)) as size_bytes, "
            "starts_with(l.body, '%PDF') as has_pdf_magic, d.text from landed l "
            "join documents d on d.doc_id = l.doc_id",
        ),
        (
            "tried",
            f"select *, {REASON_SQL} as reason, {METHOD_SQL} as method, "
            r"length(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{N}]', '', 'g')) > 10 "
            "as has_text from named",
        ),
        (
            "stepped",
            "select t.doc_id, case when reason is not null then reason when method is null then "
            f"{literal(fv.OTHER_OPEN_ERROR)} || 'ValueError: ' || size_bytes || ' bytes' "
            f"when not has_text then {literal(fv.NO_TEXT_FOUND)} end as e1, "
            f"case when p.raw_text = '' then {literal(fv.NO_ASSEMBLED_TEXT)} end as e2, "
            f"case when not coalesce(k.doc_id % 8 in (0, 1, 2, 7), false) then "
            f"{literal(fv.REPLY_STEP_ERROR + fv.BAD_REPLY)} end as e3, method, k.total_tokens, "
            f"case when q.user_prompt is not null then sha256({REQUEST_SQL}) end as digest "
            "from tried t join per_document p on p.doc_id = t.doc_id "
            "join prompted q on q.doc_id = t.doc_id "
            "left join fx_picked k on 2 * k.doc_id = t.doc_id",
        ),
    ]
)


@query(
    "pipeline_result",
    inp.cte(*RESULT_CTE)
    + "select doc_id, case when e1 is not null then 'Ingesta' when e2 is not null then "
    "'Extracción' else 'llm_processing' end as processing_stage, "
    "case when coalesce(e1, e2, e3) is null then 'COMPLETED' else 'FAILED' end as status, "
    "coalesce(e1, e2, e3) as error, case when e1 is null then method end as extraction_method, "
    "case when e1 is null then digest end as request_digest, "
    "case when coalesce(e1, e2, e3) is null then 11 else 0 end::bigint as field_count, "
    "case when coalesce(e1, e2, e3) is null then total_tokens else 0 end as tokens_used "
    "from stepped",
)
def pipeline_result(spark, folder):
    """Files of the landing folder to results; names are keys of documents."""
    place = landing(spark, folder)
    names = inp.sql(spark, LANDED_SQL, documents=inp.documents(spark, folder)).select(
        "doc_id", "filename"
    )
    scanned = files.scan_files(spark, place, only_pdf=False)
    fits = F.col("size_bytes") <= LIMIT.max_size_bytes
    read = scanned.select(
        F.col("filename").alias("name"),
        F.col("path").alias("file_path"),
        "size_bytes",
        F.when(fits, F.col("content")).alias("content"),
        F.when(fits, files.starts_with_magic()).alias("has_pdf_magic"),
    )
    found = names.join(read, F.col("filename") == F.col("name"), "left").drop("name")
    # The scan leaves out files of no bytes.
    known = found.withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0).cast("bigint")))
    answers = inp.replies(spark, folder).withColumn("doc_id", F.col("doc_id") * 2)
    # Most replies belong to no file of the folder; they are not judged.
    answers = answers.join(names.select("doc_id"), "doc_id", "left_semi")
    return flow.results(known, READERS, answers, LIMIT).select(
        "doc_id",
        "processing_stage",
        "status",
        "error",
        "extraction_method",
        "request_digest",
        "field_count",
        "tokens_used",
    )


@query(
    "file_inventory",
    inp.cte(*LANDED_CTE)
    + "select filename, size_bytes, round_even(size_bytes / 1048576.0::double, 2)::double "
    "as file_size_mb from fx_files",
)
def file_inventory(spark, folder):
    listed = landing_source.scan(spark, landing(spark, folder))
    return intake.sizes(listed).select("filename", "size_bytes", "file_size_mb")
