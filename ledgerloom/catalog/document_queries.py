"""Queries over document text and files' open results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog import inputs as inp
from ledgerloom.catalog.registry import literal, query
from ledgerloom.operators import intake, pages, replies, state, texts
from ledgerloom.plans import documents as plan
from ledgerloom.sources import extractors
from ledgerloom.schemas import DEFAULTS

CLEAN_SQL = r"trim(regexp_replace(upper(replace({0}, 'ß', 'SS')), '\s+', ' ', 'g'))"
STRIP_SQL = "trim({0}, ' ' || chr(10))"
PROMPT_HEAD, PROMPT_TAIL = fv.USER_PROMPT.split(fv.PROMPT_PLACEHOLDER)


@query("page_source", inp.cte(*inp.PAGE_CTE) + "select doc_id, page_no, text from fx_pages")
def page_source(spark, folder):
    return pages.page_rows(inp.documents(spark, folder))


ASSEMBLY_SQL = inp.cte(*inp.ASSEMBLED_CTE) + (
    "select doc_id, raw_text, pages_with_text, "
    f"length({STRIP_SQL.format('raw_text')}) as total_characters from "
)


@query("page_assembly", ASSEMBLY_SQL + "per_document")
def page_assembly(spark, folder):
    paged = inp.paged_documents(spark, folder, DEFAULTS.max_pages)
    return pages.assemble(paged).drop("pages")


@query("page_assembly_rows", ASSEMBLY_SQL + "assembled")
def page_assembly_rows(spark, folder):
    return pages.assemble_rows(pages.page_rows(inp.documents(spark, folder)))


@query(
    "extraction_verdict",
    inp.cte(*inp.ASSEMBLED_CTE)
    + "select doc_id, case when raw_text = '' then 'FAILED' else 'PROCESSING' end as status, "
    f"case when raw_text = '' then {literal(fv.NO_ASSEMBLED_TEXT)} end as error "
    "from per_document",
)
def extraction_verdict(spark, folder):
    paged = inp.paged_documents(spark, folder, DEFAULTS.max_pages)
    return pages.extraction_verdict(pages.assemble(paged)).select("doc_id", "status", "error")


@query(
    "text_gate",
    r"select doc_id, length(regexp_replace(split_part(text, chr(10), 1), "
    r"'[^\p{L}\p{N}]', '', 'g')) as meaningful_chars, "
    r"length(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{N}]', '', 'g')) > 10 "
    "as has_extractable_text from documents",
)
def text_gate(spark, folder):
    return pages.text_gate(inp.documents(spark, folder)).select(
        "doc_id", "meaningful_chars", "has_extractable_text"
    )


CHOICE_CTE = inp.METHOD_CTE + [
    (
        "ranked",
        "select doc_id, min(priority) as best from fx_methods "
        r"where length(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{N}]', '', 'g')) > 10 "
        "group by doc_id",
    ),
    (
        "choices",
        "select d.doc_id, case r.best when 1 then 'PyMuPDF' when 2 then 'pdfplumber' "
        "when 3 then 'PyPDF2' else 'none' end as extraction_method, "
        "r.best is not null as has_extractable_text "
        "from documents d left join ranked r on r.doc_id = d.doc_id",
    ),
]


@query("method_choice", inp.cte(*CHOICE_CTE) + "select * from choices")
def method_choice(spark, folder):
    return pages.choose_method(inp.methods(spark, folder))


@query(
    "chosen_text",
    inp.cte(*CHOICE_CTE)
    + "select c.doc_id, m.method, m.text from choices c "
    "join fx_methods m on m.doc_id = c.doc_id and m.method = c.extraction_method",
)
def chosen_text(spark, folder):
    attempts = inp.methods(spark, folder)
    return pages.chosen_text(pages.choose_method(attempts), attempts)


@query(
    "chosen_text_in_row",
    inp.cte(*CHOICE_CTE)
    + "select c.doc_id, m.method, m.text from choices c "
    "left join fx_methods m on m.doc_id = c.doc_id and m.method = c.extraction_method",
)
def chosen_text_in_row(spark, folder):
    found = pages.first_text(*inp.attempt_texts())
    return inp.documents(spark, folder).select("doc_id", found.alias("x")).select("doc_id", "x.*")


@query(
    "text_clean",
    "select doc_id, cleaned_text, length(text) - length(cleaned_text) as characters_removed, "
    "cast(round_even(cast((length(text) - length(cleaned_text)) / length(text) * 100.0 "
    "as double), 2) as double) as removal_percentage, "
    "length(cleaned_text) as final_text_length from "
    f"(select doc_id, text, case when text <> '' then {CLEAN_SQL.format('text')} end "
    "as cleaned_text from documents) as t",
)
def text_clean(spark, folder):
    return texts.clean(inp.documents(spark, folder), "text").select(
        "doc_id",
        "cleaned_text",
        "characters_removed",
        "removal_percentage",
        "final_text_length",
    )


@query(
    "cleaning_warnings",
    inp.cte(*inp.ASSEMBLED_CTE)
    + "select doc_id, 'PROCESSING' as status, raw_text <> '' as cleaning_applied, "
    f"case when raw_text = '' then '[09:30:05] ' || {literal(fv.NOTHING_TO_CLEAN)} else '' end "
    "as warnings from per_document",
)
def cleaning_warnings(spark, folder):
    assembled = pages.assemble(inp.paged_documents(spark, folder, DEFAULTS.max_pages))
    cleaned = texts.clean(assembled).withColumns(
        {
            "warnings": F.array().cast("array<string>"),
            "status": F.lit(fv.PROCESSING),
        }
    )
    at = F.lit("2024-01-01 09:30:05").cast("timestamp_ntz")
    logged = state.log(cleaned, at, warning=F.col("warning"))
    return logged.select("doc_id", "status", "cleaning_applied", "warnings")


PROMPTED_CTE = inp.ASSEMBLED_CTE + [
    (
        "prompted",
        f"select doc_id, case when raw_text <> '' then {literal(fv.SYSTEM_PROMPT)} end "
        "as system_prompt, case when raw_text <> '' then "
        f"{literal(PROMPT_HEAD)} || {CLEAN_SQL.format('raw_text')} || {literal(PROMPT_TAIL)} "
        "end as user_prompt, "
        f"case when raw_text = '' then {literal(fv.NO_ASSEMBLED_TEXT)} end as error "
        "from per_document",
    )
]


REQUEST_SQL = (
    "to_json({'model': 'gpt-4o-mini', 'messages': ["
    "{'role': 'system', 'content': system_prompt}, {'role': 'user', 'content': user_prompt}], "
    "'max_tokens': 1500, 'temperature': cast(0.1 as double), 'top_p': cast(0.9 as double)})"
    "::varchar"
)


def _prepared(spark, folder):
    return plan.prepare(inp.paged_documents(spark, folder, DEFAULTS.max_pages))


@query(
    "prompt_build",
    inp.cte(*PROMPTED_CTE) + "select doc_id, system_prompt, user_prompt, error from prompted",
)
def prompt_build(spark, folder):
    return _prepared(spark, folder).select("doc_id", "system_prompt", "user_prompt", "error")


@query(
    "request_rows",
    inp.cte(*PROMPTED_CTE)
    + f"select doc_id, {REQUEST_SQL} as request from prompted where user_prompt is not null",
)
def request_rows(spark, folder):
    return texts.requests(_prepared(spark, folder))


@query(
    "text_chunks",
    "select doc_id, i as chunk_no, array_to_string(words[(i - 1) * 90 + 1:(i - 1) * 90 + 100], ' ') "
    "as chunk from (select doc_id, words, unnest(range(1, greatest(ceil((len(words) - 10) / 90.0), 1)"
    "::bigint + 1)) as i from (select doc_id, list_filter(regexp_split_to_array(text, "
    r"'[ \n]+'), lambda w: w <> '') as words from documents) as t where len(words) > 0) as u",
)
def text_chunks(spark, folder):
    return texts.chunks(inp.documents(spark, folder), "text", size=100, overlap=10)


@query(
    "previews",
    inp.cte(*inp.REPLY_CTE)
    + "select doc_id, substring(user_prompt, 1, 500) || '...' as prompt_preview, "
    f"substring({STRIP_SQL.format('content')}, 1, 300) as reply_preview from "
    "(select r.doc_id, r.content, "
    f"{literal(PROMPT_HEAD)} || d.text || {literal(PROMPT_TAIL)} as user_prompt "
    "from documents d join fx_replies r on r.doc_id = d.doc_id) as t",
)
def previews(spark, folder):
    documents = inp.documents(spark, folder).select(
        "doc_id", F.col("text").alias("cleaned_text")
    )
    # Both sides are cut to their preview before they are joined.
    prompted = texts.prompts(documents).select(
        "doc_id", texts.prompt_preview(F.col("user_prompt")).alias("prompt_preview")
    )
    answered = inp.replies(spark, folder).select(
        "doc_id", texts.reply_preview(F.col("content")).alias("reply_preview")
    )
    return prompted.join(answered, "doc_id")


@query(
    "initial_state",
    "select doc_id, 'landing/' || source || '/doc' || doc_id || '.pdf' as file_path, "
    "'doc' || doc_id || '.pdf' as filename, n_chars as file_size, "
    "cast(null as varchar) as raw_text, cast(null as varchar) as cleaned_text, "
    "'ingestion' as processing_stage, 'PROCESSING' as status, cast(0 as bigint) as tokens_used, "
    "cast(0 as double) as processing_time, cast(0 as double) as cost_estimate, "
    "'gpt-4o-mini' as llm_model, cast(0 as double) as confidence_score, "
    "cast(0 as double) as completeness_score, '' as messages, '' as errors, '' as warnings "
    "from documents",
)
def initial_state(spark, folder):
    return state.initial(_arrived(spark, folder))


def _arrived(spark, folder):
    path = F.concat(
        F.lit("landing/"),
        F.col("source"),
        F.lit("/doc"),
        F.col("doc_id").cast("string"),
        F.lit(".pdf"),
    )
    return inp.documents(spark, folder).select(
        "doc_id", path.alias("file_path"), F.col("n_chars").alias("file_size"), "lang"
    )


@query(
    "state_log",
    "select doc_id, case when lang = 'de' then 'FAILED' else 'PROCESSING' end as status, "
    "'Extracción' as processing_stage, "
    "'[08:05:09] Iniciando etapa: Ingesta|[08:05:09] Iniciando etapa: Extracción' as messages, "
    "case when file_size > 1000 then '[08:05:09] long text' else '' end as warnings, "
    "case when lang = 'de' then '[08:05:09] language de' else '' end as errors "
    "from (select doc_id, n_chars as file_size, lang from documents) as t",
)
def state_log(spark, folder):
    at = F.lit("2024-01-01 08:05:09").cast("timestamp_ntz")
    no_lines = F.array().cast("array<string>")
    started = _arrived(spark, folder).withColumns(
        {
            "status": F.lit(fv.PROCESSING),
            "processing_stage": F.lit(fv.FIRST_STAGE),
            "messages": no_lines,
            "warnings": no_lines,
            "errors": no_lines,
        }
    )
    for stage in fv.STAGES[:2]:
        started = state.enter_stage(started, at, stage)
    logged = state.log(
        started,
        at,
        warning=F.when(F.col("file_size") > 1000, F.lit("long text")),
        error=F.when(F.col("lang") == "de", F.lit("language de")),
    )
    return logged.select(
        "doc_id", "status", "processing_stage", "messages", "warnings", "errors"
    )


REPLIED_CTE = (
    inp.ASSEMBLED_CTE
    + inp.REPLY_CTE
    + [
        (
            "verdicts",
            "select 2 * doc_id as doc_id, doc_id % 8 in (0, 1, 2, 7) as accepted, "
            "total_tokens from fx_picked",
        ),
        (
            "answered",
            "select p.doc_id, case when p.raw_text = '' then "
            f"{literal(fv.NO_ASSEMBLED_TEXT)} when not coalesce(v.accepted, false) then "
            f"{literal(fv.REPLY_STEP_ERROR + fv.BAD_REPLY)} end as error, v.total_tokens, "
            "p.raw_text = '' as blank "
            "from per_document p left join verdicts v on v.doc_id = p.doc_id",
        ),
    ]
)


def _replies_of_documents(spark, folder):
    """Every second document has a reply."""
    return inp.replies(spark, folder).withColumn("doc_id", F.col("doc_id") * 2)


@query(
    "doc_reply",
    inp.cte(*REPLIED_CTE)
    + "select doc_id, case when error is null then 'COMPLETED' else 'FAILED' end as status, "
    "error, case when error is null then 11 else 0 end::bigint as field_count, "
    "case when error is null then total_tokens else 0 end as tokens_used from answered",
)
def doc_reply(spark, folder):
    prepared = _prepared(spark, folder).select("doc_id", "error")
    answers = _replies_of_documents(spark, folder)
    joined = replies.with_reply(prepared, answers, with_data=False)
    return joined.select("doc_id", "status", "error", "field_count", "tokens_used")


@query(
    "document_result",
    inp.cte(*REPLIED_CTE)
    + "select doc_id, case when blank then 'Extracción' else 'llm_processing' end "
    "as processing_stage, case when error is null then 'COMPLETED' else 'FAILED' end as status, "
    "error, case when error is null then 11 else 0 end::bigint as field_count, "
    "case when error is null then total_tokens else 0 end as tokens_used, "
    "round(case when error is null then total_tokens else 0 end / 1000.0::double * 0.00015::double"
    ", 9) as cost_estimate, 'gpt-4o-mini' as llm_model, w.razon_social_cliente, w.moneda, "
    "cast(w.total as decimal(18,2)) as total, len(w.items) as n_items "
    "from answered a left join written w on 2 * w.id = a.doc_id and a.error is null",
)
def document_result(spark, folder):
    finished = plan.finish(_prepared(spark, folder), _replies_of_documents(spark, folder))
    return finished.select(
        "doc_id",
        "processing_stage",
        "status",
        "error",
        "field_count",
        "tokens_used",
        F.round("cost_estimate", 9).alias("cost_estimate"),
        "llm_model",
        "extracted_data.razon_social_cliente",
        "extracted_data.moneda",
        "extracted_data.total",
        F.size("extracted_data.items").alias("n_items"),
    )


UPLOAD_REASON = (
    f"case when filename = '' then {literal(fv.NO_NAME[1])} "
    f"when lower(filename) not like '%.pdf' then {literal(fv.NOT_PDF_NAME[1])} "
    f"when coalesce(content_type, '') <> 'application/pdf' then {literal(fv.NOT_PDF_TYPE[1])} "
    f"when size_bytes > 10485760 then {literal(fv.TOO_LARGE_TEXT[0])} || "
    "printf('%.1f', size_bytes / 1048576.0::double) || "
    f"{literal(fv.TOO_LARGE_TEXT[1] + '10' + fv.TOO_LARGE_TEXT[2])} "
    f"when not has_pdf_magic then {literal(fv.NOT_PDF_CONTENT[1])} end"
)


@query(
    "upload_verdict",
    inp.cte(*inp.UPLOAD_CTE)
    + "select doc_id, filename, size_bytes, reason is null as accepted, "
    f"case when reason is null then null when reason like {literal(fv.TOO_LARGE_TEXT[0] + '%')} "
    "then 413 else 400 end::bigint as code, reason from "
    f"(select *, {UPLOAD_REASON} as reason from fx_uploads) as t",
)
def upload_verdict(spark, folder):
    return intake.upload_verdict(inp.uploads(spark, folder)).select(
        "doc_id", "filename", "size_bytes", "accepted", "code", "reason"
    )


@query(
    "size_mb",
    inp.cte(*inp.UPLOAD_CTE)
    + "select doc_id, round_even(size_bytes / 1048576.0::double, 2)::double as file_size_mb, "
    "printf('%.1f', size_bytes / 1048576.0::double) as shown_mb from fx_uploads",
)
def size_mb(spark, folder):
    return intake.sizes(inp.uploads(spark, folder)).select("doc_id", "file_size_mb", "shown_mb")


@query(
    "integrity_verdict",
    inp.cte(*inp.OPENED_CTE)
    + "select doc_id, message = '' as is_valid, message, "
    "case when message = '' then page_count else 0 end::bigint as pages from "
    f"(select *, case when open_error = 'corrupt' then {literal(fv.CORRUPT_FILE)} "
    f"when open_error = 'empty' then {literal(fv.EMPTY_FILE)} "
    f"when needs_pass then {literal(fv.PASSWORD_FILE)} "
    f"when page_count = 0 then {literal(fv.ZERO_PAGES)} "
    f"when not first_page_ok then {literal(fv.UNREADABLE_PAGE)} "
    f"when open_error is not null then {literal(fv.OTHER_OPEN_ERROR)} || open_error "
    "else '' end as message from fx_opened) as t",
)
def integrity_verdict(spark, folder):
    return intake.integrity_verdict(inp.opened(spark, folder)).select(
        "doc_id", "is_valid", "message", "pages"
    )


def _ingested(spark, folder):
    """Opened files with the method of the first attempt that found text."""
    method = pages.first_method(*inp.attempt_texts())
    return intake.ingestion_verdict(
        inp.opened(spark, folder).withColumn("extraction_method", method)
    )


INGESTED_CTE = (
    CHOICE_CTE
    + inp.OPENED_CTE
    + [
        (
            "judged",
            "select o.*, c.extraction_method, case when size_bytes is null then "
            f"{literal(fv.FILE_MISSING)} || file_path when size_bytes > 10485760 then "
            f"{literal(fv.OVERSIZE_TEXT[0])} || printf('%.1f', size_bytes / 1048576.0::double) || "
            f"{literal(fv.OVERSIZE_TEXT[1] + '10' + fv.OVERSIZE_TEXT[2])} "
            f"when open_error = 'corrupt' then {literal(fv.CORRUPT_FILE)} "
            f"when open_error = 'empty' then {literal(fv.EMPTY_FILE)} "
            f"when needs_pass then {literal(fv.PASSWORD_FILE)} "
            f"when page_count = 0 then {literal(fv.ZERO_PAGES)} "
            f"when not first_page_ok then {literal(fv.UNREADABLE_PAGE)} "
            f"when open_error is not null then {literal(fv.OTHER_OPEN_ERROR)} || open_error "
            f"when c.extraction_method = 'none' then {literal(fv.NO_TEXT_FOUND)} end as error "
            "from fx_opened o join choices c on c.doc_id = o.doc_id",
        ),
        (
            "ingested",
            "select *, case when error is null then "
            f"{literal(fv.VALIDATED_TEXT[0])} || page_count || {literal(fv.VALIDATED_TEXT[1])} || "
            f"printf('%.1f', size_bytes / 1048576.0::double) || {literal(fv.VALIDATED_TEXT[2])} || "
            "extraction_method end as message from judged",
        ),
    ]
)


@query(
    "ingestion_verdict",
    inp.cte(*INGESTED_CTE)
    + "select doc_id, case when error is null then 'PROCESSING' else 'FAILED' end as status, "
    "error, message, case when error is null then page_count end::bigint as page_count, "
    "case when error is null then size_bytes / 1048576.0::double end as file_size_mb, "
    "case when error is null then false end as password_protected, "
    "case when error is null then true end as has_extractable_text, "
    "case when error is null then extraction_method end as extraction_method, "
    "case when error is null then 'PASSED' end as validation_status, "
    "case when error is null then 'native_text' end as extraction_strategy from ingested",
)
def ingestion_verdict(spark, folder):
    return _ingested(spark, folder).select(
        "doc_id",
        "status",
        "error",
        "message",
        "page_count",
        "file_size_mb",
        "password_protected",
        "has_extractable_text",
        "extraction_method",
        "validation_status",
        "extraction_strategy",
    )


def _line(text: str) -> str:
    return literal("[08:05:09] ") + " || " + text


@query(
    "processing_log",
    inp.cte(
        *INGESTED_CTE,
        *inp.ASSEMBLED_CTE,
        *inp.REPLY_CTE,
        (
            "steps",
            "select i.doc_id, i.error as e1, i.message as m1, "
            "case when i.error is null and p.raw_text = '' then "
            f"{literal(fv.NO_ASSEMBLED_TEXT)} end as e2, p.raw_text, p.pages_with_text, "
            f"length({STRIP_SQL.format('p.raw_text')}) as chars, "
            f"length(p.raw_text) - length({CLEAN_SQL.format('p.raw_text')}) as removed, "
            "coalesce(r.doc_id % 8 in (0, 1, 2, 7), false) as accepted "
            "from ingested i join per_document p on p.doc_id = i.doc_id "
            "left join fx_picked r on 2 * r.doc_id = i.doc_id",
        ),
    )
    + "select doc_id, case when e1 is null and e2 is null and accepted then 'COMPLETED' "
    "else 'FAILED' end as status, case when e1 is not null then 'Ingesta' "
    "when e2 is not null then 'Extracción' else 'llm_processing' end as processing_stage, "
    f"concat_ws('|', {_line(literal('Iniciando etapa: Ingesta'))}, {_line('m1')}, "
    f"case when e1 is null then {_line(literal('Iniciando etapa: Extracción'))} end, "
    "case when e1 is null and e2 is null then "
    + _line(f"{literal(fv.EXTRACTED_TEXT[0])} || chars || {literal(fv.EXTRACTED_TEXT[1])} || "
            f"pages_with_text || {literal(fv.EXTRACTED_TEXT[2])}")
    + " end, case when e1 is null and e2 is null then "
    + _line(literal("Iniciando etapa: Limpieza"))
    + " end, case when e1 is null and e2 is null then "
    + _line(f"{literal(fv.CLEANED_TEXT[0])} || removed || {literal(fv.CLEANED_TEXT[1])} || "
            "printf('%.1f', round_even(removed / length(raw_text)::double * 100.0::double, 1)"
            f"::double) || {literal(fv.CLEANED_TEXT[2])}")
    + " end, case when e1 is null and e2 is null then "
    + _line(literal("Iniciando etapa: llm_processing"))
    + " end, case when e1 is null and e2 is null and accepted then "
    + _line(literal("Extracción completada: 11 campos extraídos"))
    + " end) as messages, '' as warnings, "
    f"case when e1 is not null then {_line('e1')} when e2 is not null then {_line('e2')} "
    f"when not accepted then {_line(literal(fv.REPLY_STEP_ERROR + fv.BAD_REPLY))} else '' end "
    "as errors from steps",
)
def processing_log(spark, folder):
    paged = _ingested(spark, folder).withColumn(
        "pages", pages.page_array(F.col("text"), "\n", DEFAULTS.max_pages)
    )
    at = F.lit("2024-01-01 08:05:09").cast("timestamp_ntz")
    return plan.trace(paged, _replies_of_documents(spark, folder), at)


@query(
    "pdf_metadata",
    "select doc_id, case when doc_id % 3 = 0 then '' else source end as pdf_title, "
    "lang as pdf_author, '' as pdf_creator, "
    "case when doc_id % 2 = 0 then 'maker ' || lang else '' end as pdf_producer from documents",
)
def pdf_metadata(spark, folder):
    meta = F.expr(
        "map_filter(map('title', case when doc_id % 3 <> 0 then source end, 'author', lang, "
        "'producer', case when doc_id % 2 = 0 then concat('maker ', lang) end), "
        "(k, v) -> v is not null)"
    )
    described = inp.documents(spark, folder).withColumn("meta", meta)
    return intake.metadata_columns(described).select(
        "doc_id", "pdf_title", "pdf_author", "pdf_creator", "pdf_producer"
    )


@query(
    "debug_merge",
    "select doc_id, 'applied=true|chars=' || length(text) || '|lang=' || lang || "
    "'|stage=cleaning' as merged from documents",
)
def debug_merge(spark, folder):
    first = F.expr("map('stage', 'extraction', 'lang', lang, 'chars', '0')")
    second = F.expr(
        "map('stage', 'cleaning', 'chars', cast(length(text) as string), 'applied', 'true')"
    )
    merged = state.merge_maps(first, second)
    entries = F.array_sort(F.map_entries(merged))
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return inp.documents(spark, folder).select("doc_id", F.array_join(lines, "|").alias("merged"))


@query(
    "extractor_plug",
    "select doc_id, unnest(case when doc_id % 7 = 6 then [null] "
    "else range(1, len(a) + 1) end) as page_no, "
    "unnest(case when doc_id % 7 = 6 then [null] else a end) as text, "
    f"case when doc_id % 7 = 6 then {literal(fv.UNKNOWN_METHOD + 'other')} end as error "
    "from (select doc_id, string_split(text, chr(10)) as a from documents) as t",
)
def extractor_plug(spark, folder):
    def form_feed_pages(content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")

    readers = {name: form_feed_pages for name in fv.EXTRACTION_METHODS}
    files = inp.documents(spark, folder).select(
        "doc_id",
        F.expr("case when doc_id % 7 = 6 then 'other' when doc_id % 7 = 5 then null "
               "else 'pdfplumber' end").alias("method"),
        F.encode(F.translate("text", "\n", "\f"), "utf-8").alias("content"),
    )
    found = extractors.extract_pages(files, readers)
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "error", F.inline_outer("pages")
    ).select("doc_id", "page_no", "text", "error")


@query(
    "extract_plug",
    inp.cte(*PROMPTED_CTE)
    + "select doc_id, case when length(user_prompt) % 5 <> 0 then "
    "'{\"chars\": ' || length(user_prompt) || '}' end as content, "
    "case when length(user_prompt) % 5 <> 0 then length(user_prompt) // 4 else 0 end::bigint "
    "as total_tokens, case when length(user_prompt) % 5 = 0 then "
    f"{literal(fv.REPLY_STEP_ERROR + 'no answer')} end as error "
    "from prompted where user_prompt is not null",
)
def extract_plug(spark, folder):
    def count_characters(system: str, user: str) -> tuple[str, int]:
        if len(user) % 5 == 0:
            raise ValueError("no answer")
        return '{"chars": %d}' % len(user), len(user) // 4

    prompted = texts.prompted(_prepared(spark, folder))
    return extractors.extract_fields(prompted, count_characters).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "content", "total_tokens", "error"
    )
