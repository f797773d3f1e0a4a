"""Queries over model replies and the invoices in them."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom import session
from ledgerloom.catalog import inputs as inp
from ledgerloom.catalog.registry import literal, query, stamp
from ledgerloom.functions import numbers as nm
from ledgerloom.functions import text as tx
from ledgerloom.operators import checks, forms, ledger, money, replies, report
from ledgerloom.plans import invoices as plan
from ledgerloom.sources import tables as tables_in

STRIP_SQL = "trim({0}, ' ' || chr(10))"
UNFENCE_SQL = STRIP_SQL.format(
    "regexp_replace(" + STRIP_SQL.format(
        "regexp_replace(" + STRIP_SQL.format("content") + r", '\A```json', '')"
    ) + r", '```\z', '')"
)
ACCEPTED = "doc_id % 8 in (0, 1, 2, 7)"
AS_OF = datetime.date(2024, 6, 30)
GENERATED_AT = datetime.datetime(2024, 6, 30, 14, 5, 9)


@query(
    "response_scan",
    inp.cte(*inp.REPLY_CTE) + "select doc_id, content, total_tokens from fx_replies",
)
def response_scan(spark, folder):
    return inp.replies(spark, folder).select("doc_id", "content", "total_tokens")


@query(
    "reply_unfence",
    inp.cte(*inp.REPLY_CTE) + f"select doc_id, {UNFENCE_SQL} as body from fx_replies",
)
def reply_unfence(spark, folder):
    return replies.unfence(inp.replies(spark, folder)).select("doc_id", "body")


@query(
    "reply_gate",
    inp.cte(*inp.REPLY_CTE)
    + f"select doc_id, {ACCEPTED} as accepted, "
    f"case when {ACCEPTED} then 'COMPLETED' else 'FAILED' end as status, "
    f"case when not {ACCEPTED} then {literal(fv.REPLY_STEP_ERROR + fv.BAD_REPLY)} end as error "
    "from fx_replies",
)
def reply_gate(spark, folder):
    return replies.gate(inp.replies(spark, folder)).select(
        "doc_id", "accepted", "status", "error"
    )


INVOICE_COLUMNS = (
    "codigo_cliente, razon_social_cliente, direccion_cliente, distrito, forma_pago, moneda, "
)


@query(
    "parse_invoice",
    inp.cte(*inp.INVOICE_CTE)
    + f"select w.id as doc_id, v.id is not null as accepted, {INVOICE_COLUMNS}"
    "subtotal, igv, total, detraccion_porcentaje, detraccion_monto, n_items from "
    "(select id from written union all select id from written where id % 9 = 4) w left join "
    "(select id, codigo_cliente, razon_social_cliente, direccion_cliente, distrito, "
    "forma_pago, moneda, subtotal, igv, total, porcentaje as detraccion_porcentaje, "
    "monto as detraccion_monto, len(items) as n_items from invoices) v on v.id = w.id",
)
def parse_invoice(spark, folder):
    return replies.parse(inp.replies(spark, folder)).select(
        "doc_id",
        "accepted",
        "codigo_cliente",
        "razon_social_cliente",
        "direccion_cliente",
        "distrito",
        "forma_pago",
        "moneda",
        "subtotal",
        "igv",
        "total",
        F.col("detraccion.porcentaje").alias("detraccion_porcentaje"),
        F.col("detraccion.monto").alias("detraccion_monto"),
        F.size("items").alias("n_items"),
    )


@query(
    "field_count",
    inp.cte(*inp.REPLY_CTE)
    + f"select doc_id, case when {ACCEPTED} then 11 end::bigint as field_count from fx_replies",
)
def field_count(spark, folder):
    return replies.field_count(inp.replies(spark, folder)).select("doc_id", "field_count")


@query(
    "token_cost",
    inp.cte(*inp.REPLY_CTE)
    + "select doc_id, total_tokens as tokens_used, "
    "round(total_tokens / 1000.0::double * 0.00015::double, 9) as cost_estimate "
    f"from fx_picked where {ACCEPTED}",
)
def token_cost(spark, folder):
    return replies.token_cost(inp.replies(spark, folder)).withColumn(
        "cost_estimate", F.round("cost_estimate", 9)
    )


def _invoices(spark, folder):
    return replies.accepted_invoices(inp.replies(spark, folder))


# ----------------------------------------------------------------------- items
@query(
    "item_numbering",
    inp.cte(*inp.INVOICE_CTE)
    + "select id as factura_id, pos as item_no, descripcion, cantidad, precio_unitario, "
    "subtotal from invoice_items",
)
def item_numbering(spark, folder):
    return ledger.numbered_items(_invoices(spark, folder))


@query(
    "items_present",
    inp.cte(*inp.INVOICE_CTE) + "select id, len(items) > 0 as items_present from invoices",
)
def items_present(spark, folder):
    return forms.items_present(_invoices(spark, folder)).select("id", "items_present")


@query(
    "ledger_items",
    inp.cte(*inp.INVOICE_CTE)
    + "select id as factura_id, descripcion, cantidad, precio_unitario, subtotal "
    "from invoice_items where descripcion <> ''",
)
def ledger_items(spark, folder):
    return ledger.item_rows(_invoices(spark, folder))


@query(
    "ledger_items_count",
    inp.cte(*inp.INVOICE_CTE)
    + "select v.id, count(l.descripcion) as items_stored, "
    "len(any_value(v.items)) = 0 as saved_without_items from invoices v "
    "left join lines l on l.id = v.id and l.descripcion <> '' group by v.id",
)
def ledger_items_count(spark, folder):
    return ledger.stored_item_counts(_invoices(spark, folder))


# ---------------------------------------------------------------------- header
@query(
    "ledger_header",
    inp.cte(*inp.INVOICE_CTE)
    + "select id, 'FACT-' || upper(substring(sha256(id::varchar), 1, 8)) as codigo_factura, "
    f"'2024-06-30' as fecha_emision, {INVOICE_COLUMNS} subtotal, igv, total, "
    "porcentaje as detraccion_porcentaje, monto as detraccion_monto, "
    "'factura' || id || '.pdf' as archivo_pdf_path, 'procesada' as estado from invoices",
)
def ledger_header(spark, folder):
    return ledger.header(_with_filename(spark, folder), AS_OF)


def _with_filename(spark, folder):
    name = F.concat(F.lit("factura"), F.col("id").cast("string"), F.lit(".pdf"))
    return _invoices(spark, folder).withColumn("filename", name)


@query(
    "raw_payload",
    inp.cte(*inp.REPLY_CTE) + "select id, js as datos_raw from texts where id % 8 in (0, 1, 2, 7)",
)
def raw_payload(spark, folder):
    return ledger.raw_payload(_invoices(spark, folder)).select("id", "datos_raw")


# ---------------------------------------------------------------------- report
@query(
    "report_rows",
    inp.cte(
        *inp.INVOICE_CTE,
        (
            "shown",
            "select *, coalesce(moneda, 'PEN') as cur, 'factura' || id || '.pdf' as filename, "
            "coalesce(porcentaje, 0) > 0 or coalesce(monto, 0) > 0 as withheld from invoices",
        ),
        (
            "report",
            "select id, cur, 'FACTURA - DATOS EXTRAÍDOS' as section, 1 as row_no, "
            "'Archivo origen:' as label, filename as value from shown "
            "union all select id, cur, 'FACTURA - DATOS EXTRAÍDOS', 2, 'Fecha de generación:', "
            "strftime(timestamp '2024-06-30 14:05:09', '%d/%m/%Y %H:%M:%S') from shown "
            "union all select id, cur, 'DATOS DEL CLIENTE', 1, 'Código Cliente:', "
            "coalesce(codigo_cliente, 'N/A') from shown "
            "union all select id, cur, 'DATOS DEL CLIENTE', 2, 'Razón Social:', "
            "coalesce(razon_social_cliente, 'N/A') from shown "
            "union all select id, cur, 'DATOS DEL CLIENTE', 3, 'Dirección:', "
            "coalesce(direccion_cliente, 'N/A') from shown "
            "union all select id, cur, 'DATOS DEL CLIENTE', 4, 'Distrito:', "
            "coalesce(distrito, 'N/A') from shown "
            "union all select s.id, cur, 'DETALLE DE ITEMS', pos, 'Descripción', "
            "coalesce(l.descripcion, 'N/A') from shown s join lines l on l.id = s.id "
            "union all select s.id, cur, 'DETALLE DE ITEMS', pos, 'Cantidad', "
            r"regexp_replace(l.cantidad::varchar, '\.?0+$', '') "
            "from shown s join lines l on l.id = s.id "
            "union all select s.id, cur, 'DETALLE DE ITEMS', pos, 'Precio Unitario', "
            "format('{:,.2f}', l.precio_unitario::double) from shown s join lines l on l.id = s.id "
            "union all select s.id, cur, 'DETALLE DE ITEMS', pos, 'Subtotal', "
            "format('{:,.2f}', l.subtotal::double) from shown s join lines l on l.id = s.id "
            "union all select id, cur, 'DETALLE DE ITEMS', 0, 'Sin items registrados', null "
            "from shown where len(items) = 0 "
            "union all select id, cur, 'TOTALES', 1, 'Subtotal:', "
            "cur || ' ' || format('{:,.2f}', coalesce(subtotal, 0)::double) from shown "
            "union all select id, cur, 'TOTALES', 2, 'IGV (18%):', "
            "cur || ' ' || format('{:,.2f}', coalesce(igv, 0)::double) from shown "
            "union all select id, cur, 'TOTALES', 3, 'TOTAL:', "
            "cur || ' ' || format('{:,.2f}', coalesce(total, 0)::double) from shown "
            "union all select id, cur, 'DETRACCIÓN', 1, 'Porcentaje:', "
            r"regexp_replace(porcentaje::varchar, '\.?0+$', '') || '%' from shown where withheld "
            "union all select id, cur, 'DETRACCIÓN', 2, 'Monto Detracción:', "
            "cur || ' ' || format('{:,.2f}', monto::double) from shown where withheld "
            "union all select id, cur, 'INFORMACIÓN ADICIONAL', 1, 'Forma de Pago:', "
            "coalesce(forma_pago, 'N/A') from shown "
            "union all select id, cur, 'INFORMACIÓN ADICIONAL', 2, 'Moneda:', cur from shown",
        ),
    )
    + "select id as factura_id, cur as moneda, section, row_no::bigint as row_no, label, value "
    "from report",
)
def report_rows(spark, folder):
    at = F.lit(GENERATED_AT).cast("timestamp_ntz")
    return report.rows(_with_filename(spark, folder), at)


# ---------------------------------------------------------------------- checks
def _checked(spark, folder, *rules, strict=True):
    checked = checks.check(_invoices(spark, folder), strict)
    return checked.select("id", *[f"ok_{rule}" for rule in rules])


CODE_OK = r"coalesce(regexp_full_match(codigo_cliente, '[0-9]{11}|[0-9]{8}'), true)"
PAYMENT_OK = (
    "coalesce(forma_pago in ('CONTADO', 'CREDITO', 'TARJETA', 'EFECTIVO', 'TRANSFERENCIA', "
    "'YAPE', 'PLIN'), true)"
)
CURRENCY_OK = "coalesce(moneda in ('PEN', 'USD'), true)"
ADDRESS_OK = "coalesce(direccion_cliente = upper(direccion_cliente), true)"
MARKS_OK = "coalesce(not regexp_matches(direccion_cliente, '[,()]'), true)"
DISTRICT_OK = "coalesce(distrito = upper(distrito), true)"
DECIMALS_OK = (
    "coalesce(round(subtotal_raw, 2) = subtotal_raw, true) and "
    "coalesce(round(igv_raw, 2) = igv_raw, true) and "
    "coalesce(round(total_raw, 2) = total_raw, true)"
)
LINE_CTE = (
    "line_checks",
    "select id, bool_and(abs(subtotal - cast(cantidad * precio_unitario as decimal(18,2))) "
    "<= 0.01) as lines_ok, sum(subtotal) as lines_sum from invoice_items group by id",
)
RULES_CTE = inp.INVOICE_CTE + [
    LINE_CTE,
    (
        "facts",
        "select v.*, coalesce(l.lines_ok, true) as lines_ok, "
        "coalesce(l.lines_sum, 0) as lines_sum from invoices v "
        "left join line_checks l on l.id = v.id",
    ),
]
SUM_OK = "coalesce(abs(subtotal - lines_sum) <= 0.01, true)"
VAT_OK = "coalesce(abs(igv - cast(subtotal * 0.18 as decimal(18,2))) <= 0.01, true)"
TOTAL_OK = "coalesce(abs(total - cast(subtotal * 1.18 as decimal(18,2))) <= 0.01, true)"
DEDUCTION_OK = (
    "porcentaje is null or abs(monto - case when total > 0 and porcentaje > 0 "
    "then cast(total * porcentaje / 100 as decimal(18,2)) else 0 end) <= 0.01"
)
ITEMS_OK = "len(items) >= 1"


@query(
    "check_client_code",
    inp.cte(*inp.INVOICE_CTE)
    + f"select id, {CODE_OK} as ok_client_code, case when not {CODE_OK} then null "
    "when length(codigo_cliente) = 11 then 'RUC' when length(codigo_cliente) = 8 then 'DNI' "
    "end as kind from invoices",
)
def check_client_code(spark, folder):
    checked = checks.check(_invoices(spark, folder))
    return checked.select(
        "id", "ok_client_code", checks.client_code_kind(F.col("codigo_cliente")).alias("kind")
    )


@query(
    "check_payment",
    inp.cte(*inp.INVOICE_CTE) + f"select id, {PAYMENT_OK} as ok_payment from invoices",
)
def check_payment(spark, folder):
    return _checked(spark, folder, "payment")


@query(
    "check_currency",
    inp.cte(*inp.INVOICE_CTE)
    + f"select id, {CURRENCY_OK} as ok_currency, "
    "coalesce(moneda in ('PEN', 'USD', 'EUR', 'GBP', 'JPY'), true) as ok_currency_form "
    "from invoices",
)
def check_currency(spark, folder):
    checked = checks.check(_invoices(spark, folder))
    lenient = checks.currency_ok(F.col("moneda"), strict=False).alias("ok_currency_form")
    return checked.select("id", "ok_currency", lenient)


@query(
    "check_address",
    inp.cte(*inp.INVOICE_CTE)
    + f"select id, {ADDRESS_OK} as ok_address_upper, {MARKS_OK} as ok_address_punctuation, "
    f"{DISTRICT_OK} as ok_district_upper from invoices",
)
def check_address(spark, folder):
    return _checked(spark, folder, "address_upper", "address_punctuation", "district_upper")


@query(
    "check_decimals",
    inp.cte(*inp.INVOICE_CTE) + f"select id, {DECIMALS_OK} as ok_decimals from invoices",
)
def check_decimals(spark, folder):
    return _checked(spark, folder, "decimals")


@query(
    "check_arithmetic",
    inp.cte(*RULES_CTE)
    + f"select id, lines_ok as ok_item_arithmetic, {SUM_OK} as ok_items_sum, {VAT_OK} as ok_vat, "
    f"{TOTAL_OK} as ok_total from facts",
)
def check_arithmetic(spark, folder):
    return _checked(spark, folder, "item_arithmetic", "items_sum", "vat", "total")


@query(
    "check_deduction",
    inp.cte(*inp.INVOICE_CTE) + f"select id, {DEDUCTION_OK} as ok_deduction from invoices",
)
def check_deduction(spark, folder):
    return _checked(spark, folder, "deduction")


@query(
    "check_has_items",
    inp.cte(*inp.INVOICE_CTE) + f"select id, {ITEMS_OK} as ok_has_items from invoices",
)
def check_has_items(spark, folder):
    return _checked(spark, folder, "has_items")


RULE_SQL = {
    "client_code": CODE_OK,
    "payment": PAYMENT_OK,
    "currency": CURRENCY_OK,
    "address_upper": ADDRESS_OK,
    "address_punctuation": MARKS_OK,
    "district_upper": DISTRICT_OK,
    "decimals": DECIMALS_OK,
    "item_arithmetic": "lines_ok",
    "items_sum": SUM_OK,
    "vat": VAT_OK,
    "total": TOTAL_OK,
    "deduction": DEDUCTION_OK,
    "has_items": ITEMS_OK,
}


@query(
    "violation_summary",
    inp.cte(*RULES_CTE)
    + "select rule, invoices, failing, round(failing::double / invoices::double, 6) as share "
    "from ("
    + " union all ".join(
        f"select '{rule}' as rule, count(*) as invoices, "
        f"(count(*) filter (where not ({ok})))::bigint as failing from facts"
        for rule, ok in RULE_SQL.items()
    )
    + ") as t",
)
def violation_summary(spark, folder):
    return checks.summary(_invoices(spark, folder))


@query(
    "violation_list",
    inp.cte(*RULES_CTE)
    + "select id, concat_ws('|', "
    + ", ".join(f"case when not ({ok}) then '{rule}' end" for rule, ok in RULE_SQL.items())
    + ") as violations from facts",
)
def violation_list(spark, folder):
    return checks.violations(_invoices(spark, folder)).select("id", "violations")


# ------------------------------------------------------------------ arithmetic
RECOMPUTED_CTE = inp.INVOICE_CTE + [
    (
        "again",
        "select id, sum(cast(trunc(cantidad) * precio_unitario as decimal(18,2))) as s "
        "from invoice_items group by id",
    ),
    (
        "recomputed",
        "select v.*, cast(coalesce(a.s, 0) as decimal(18,2)) as new_subtotal "
        "from invoices v left join again a on a.id = v.id",
    ),
    (
        "totals",
        "select *, cast(new_subtotal * 0.18 as decimal(18,2)) as new_igv, "
        "cast(new_subtotal * 1.18 as decimal(18,2)) as new_total from recomputed",
    ),
]


@query(
    "recomputed_invoices",
    inp.cte(*RECOMPUTED_CTE)
    + "select id, new_subtotal as subtotal, new_igv as igv, new_total as total, "
    "case when new_total > 0 and porcentaje > 0 then cast(new_total * porcentaje / 100 "
    "as decimal(18,2)) when porcentaje is null or porcentaje = 0 then null else monto end "
    "as detraccion_monto from totals",
)
def recomputed_invoices(spark, folder):
    return money.recompute(_invoices(spark, folder)).select(
        "id", "subtotal", "igv", "total", F.col("detraccion.monto").alias("detraccion_monto")
    )


@query(
    "form_fill",
    inp.cte(*inp.INVOICE_CTE)
    + "select v.id, coalesce(codigo_cliente, '') as codigo_cliente, "
    "coalesce(direccion_cliente, '') as direccion_cliente, coalesce(moneda, '') as moneda, "
    r"coalesce(regexp_replace(v.igv::varchar, '\.?0+$', ''), '') as igv, "
    r"coalesce(regexp_replace(v.total::varchar, '\.?0+$', ''), '') as total, "
    r"case when porcentaje is null then '0' else regexp_replace(porcentaje::varchar, '\.?0+$', '')"
    " end as porcentaje_detraccion, "
    r"case when porcentaje is null then '0' else regexp_replace(monto::varchar, '\.?0+$', '') end "
    "as monto_detraccion, l.pos as item_no, "
    "case when l.id is null then null else coalesce(l.descripcion, '') end as descripcion, "
    r"case when l.cantidad = 0 then '' else regexp_replace(l.cantidad::varchar, '\.?0+$', '') end "
    "as cantidad, case when l.precio_unitario = 0 then '' else l.precio_unitario::varchar end "
    "as precio_unitario, case when l.subtotal = 0 then '' else l.subtotal::varchar end "
    "as item_subtotal from invoices v left join lines l on l.id = v.id",
)
def form_fill(spark, folder):
    filled = forms.fill(_invoices(spark, folder))
    return filled.select(
        "id",
        "codigo_cliente",
        "direccion_cliente",
        "moneda",
        "igv",
        "total",
        "porcentaje_detraccion",
        "monto_detraccion",
        F.posexplode_outer("items").alias("position", "item"),
    ).select(
        "id",
        "codigo_cliente",
        "direccion_cliente",
        "moneda",
        "igv",
        "total",
        "porcentaje_detraccion",
        "monto_detraccion",
        (F.col("position") + 1).alias("item_no"),
        "item.descripcion",
        "item.cantidad",
        "item.precio_unitario",
        F.col("item.subtotal").alias("item_subtotal"),
    )


@query(
    "export_name",
    inp.cte(*inp.WRITTEN_CTE)
    + "select id, 'factura_' || strftime(fecha_registro + to_seconds(id % 86400), "
    "'%Y%m%d_%H%M%S') || '.xlsx' as export_name from "
    "(select id, fecha_registro from written union all "
    "select id, fecha_registro from written where id % 9 = 4) as t",
)
def export_name(spark, folder):
    at = F.expr("fecha_registro + make_dt_interval(0, 0, 0, doc_id % 86400)")
    return inp.replies(spark, folder).select(
        F.col("doc_id").alias("id"), tx.export_name(at).alias("export_name")
    )


# --------------------------------------------------------------------- flagship
@query(
    "invoice_overview",
    inp.cte(*RULES_CTE, *RECOMPUTED_CTE[len(inp.INVOICE_CTE):])
    + "select count(*) as total_facturas, cast(sum(f.total) as decimal(28,2)) as monto_total, "
    "round(cast(sum(f.total) as double) / count(f.total), 2) as promedio_factura, "
    "count(distinct f.codigo_cliente) as total_clientes, "
    "(select count(*) from invoice_items where descripcion <> '') as items_stored, "
    "(count(*) filter (where not ("
    + " and ".join(f"({ok})" for ok in RULE_SQL.values())
    + ")))::bigint as with_violations, "
    "(count(*) filter (where abs(f.total - t.new_total) > 0.01))::bigint as total_differs, "
    "cast(sum(t.new_total) as decimal(28,2)) as recomputed_sum, "
    "cast(sum(coalesce(f.total, 0)) as decimal(28,2)) as stored_sum "
    "from facts f join (select id as tid, new_total from totals) t on t.tid = f.id",
)
def invoice_overview(spark, folder):
    overview = plan.overview(inp.replies(spark, folder))
    return overview.withColumn(
        "promedio_factura", F.round(F.col("promedio_factura").cast("double"), 2)
    )


# --------------------------------------------------------------- edited payloads
_LINES: dict[tuple[str, str], str] = {}


@query(
    "payload_scan",
    inp.cte(*inp.INVOICE_CTE)
    + "select v.id is not null as accepted, "
    f"case when v.id is null then {literal(fv.BAD_REPLY)} end as error, v.razon_social_cliente, "
    "v.moneda, v.total, len(v.items) as n_items from "
    "(select id from written union all select id from written where id % 9 = 4) w "
    "left join invoices v on v.id = w.id and v.id % 8 in (0, 7)",
)
def payload_scan(spark, folder):
    """Lines of which some are one JSON object; written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LINES:
        target = session.fresh_path(spark, "payloads")
        inp.replies(spark, folder).select(F.translate("content", "\n", " ")).write.text(target)
        _LINES[key] = target
    return tables_in.payloads(spark, _LINES[key]).select(
        "accepted",
        "error",
        "razon_social_cliente",
        "moneda",
        "total",
        F.size("items").alias("n_items"),
    )


# -------------------------------------------------------------- quality and cost
@query(
    "completeness",
    inp.cte(*inp.INVOICE_CTE)
    + "select id, round(filled / 11.0::double, 4) as completeness_score, filled / 11.0 >= 0.8 "
    "as complete from (select id, ("
    + " + ".join(
        f"(coalesce({name}::varchar, '') <> '')::int"
        for name in (
            "codigo_cliente", "razon_social_cliente", "direccion_cliente", "distrito",
            "forma_pago", "moneda", "subtotal", "igv", "total", "porcentaje",
        )
    )
    + " + (len(items) > 0)::int) as filled from invoices) as t",
)
def completeness(spark, folder):
    """Share of filled contract fields and whether it reaches the threshold."""
    return checks.completeness(_invoices(spark, folder)).select(
        "id", F.round("completeness_score", 4).alias("completeness_score"), "complete"
    )


@query(
    "model_cost",
    inp.cte(*inp.REPLY_CTE)
    + "select doc_id, model, input_tokens, output_tokens, case model "
    + " ".join(
        f"when '{model}' then round((input_tokens * {read}::double + output_tokens * "
        f"{written}::double) / 1000.0::double, 9)"
        for model, (read, written) in fv.MODEL_PRICES.items()
    )
    + " end as cost from (select doc_id, content, "
    "case doc_id % 4 when 0 then 'gpt-4o' when 1 then 'gpt-3.5-turbo' when 2 then 'other' "
    "else 'gpt-4o-mini' end as model, total_tokens - total_tokens // 4 as input_tokens, "
    "total_tokens // 4 as output_tokens from fx_replies) as t",
)
def model_cost(spark, folder):
    """Cost of each reply by the prices of its model; null for a model without a price."""
    split = inp.replies(spark, folder).select(
        "doc_id",
        F.expr(
            "case doc_id % 4 when 0 then 'gpt-4o' when 1 then 'gpt-3.5-turbo' "
            "when 2 then 'other' else 'gpt-4o-mini' end"
        ).alias("model"),
        F.expr("total_tokens - total_tokens div 4").alias("input_tokens"),
        F.expr("total_tokens div 4").alias("output_tokens"),
    )
    cost = nm.model_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return split.withColumn("cost", F.round(cost, 9))
