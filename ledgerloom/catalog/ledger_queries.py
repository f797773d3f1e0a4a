"""Queries over the flat ledger of headers and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog import inputs as inp
from ledgerloom.catalog.registry import query, stamp
from ledgerloom.functions import numbers as nm
from ledgerloom.functions import text as tx
from ledgerloom.operators import forms, ledger, money
from ledgerloom.sources.tables import table

HEADER_COLUMNS = (
    "id, codigo_cliente, razon_social_cliente, distrito, forma_pago, moneda, total, "
    f"detraccion_porcentaje, {stamp('fecha_registro')} as fecha_registro"
)


@query("ledger_scan", inp.cte(*inp.FLAT_CTE) + f"select {HEADER_COLUMNS} from fx_facturas")
def ledger_scan(spark, folder):
    return inp.facturas(spark, folder)


@query(
    "ledger_items_scan",
    inp.cte(*inp.FLAT_CTE)
    + "select factura_id, pos::bigint as pos, l_partkey, l_suppkey, descripcion, "
    "cantidad::bigint as cantidad, precio_unitario, subtotal from fx_items",
)
def ledger_items_scan(spark, folder):
    return inp.items(spark, folder)


@query(
    "ledger_stats",
    inp.cte(*inp.FLAT_CTE)
    + "select count(*) as total_facturas, cast(sum(total) as decimal(28,2)) as monto_total, "
    "round(cast(sum(total) as double) / count(total), 2) as promedio_factura, "
    "count(distinct codigo_cliente) as total_clientes from fx_facturas",
)
def ledger_stats(spark, folder):
    return ledger.statistics(inp.plain_facturas(spark, folder)).withColumn(
        "promedio_factura", F.round(F.col("promedio_factura").cast("double"), 2)
    )


@query(
    "ledger_page",
    inp.cte(*inp.FLAT_CTE)
    + f"select {HEADER_COLUMNS} from (select * from fx_facturas "
    "order by fecha_registro desc, id limit 50 offset 100) as t",
)
def ledger_page(spark, folder):
    return ledger.page(inp.facturas(spark, folder), limit=50, offset=100)


@query(
    "invoice_detail",
    inp.cte(*inp.FLAT_CTE)
    + "select f.id, f.total, f.moneda, i.pos::bigint as pos, i.descripcion, "
    "i.cantidad::bigint as cantidad, i.precio_unitario, i.subtotal from fx_facturas f "
    "left join fx_items i on i.factura_id = f.id",
)
def invoice_detail(spark, folder):
    headers = inp.plain_facturas(spark, folder).select("id", "total", "moneda")
    lines = inp.items(spark, folder).drop("l_partkey", "l_suppkey")
    return ledger.detail(headers, lines)


@query(
    "invoice_nested",
    inp.cte(*inp.FLAT_CTE)
    + "select f.id, f.total, f.moneda, coalesce(string_agg(i.pos || ':' || i.cantidad || ':' || "
    "i.subtotal || ':' || coalesce(i.descripcion, '-'), '|' order by i.pos, "
    "i.descripcion nulls first, i.cantidad, i.precio_unitario, i.subtotal), '') as items "
    "from fx_facturas f left join fx_items i on i.factura_id = f.id and i.pos % 5 <> f.id % 5 "
    "group by f.id, f.total, f.moneda",
)
def invoice_nested(spark, folder):
    """Headers with their items as an ordered list, shown as text."""
    headers = inp.plain_facturas(spark, folder).select("id", "total", "moneda")
    lines = inp.items(spark, folder).where("pos % 5 <> factura_id % 5")
    found = ledger.nested(headers, lines.drop("l_partkey", "l_suppkey"), "pos")

    def shown(x):
        return F.concat_ws(
            ":", x["pos"], x["cantidad"], x["subtotal"], F.coalesce(x["descripcion"], F.lit("-"))
        )

    return found.withColumn("items", F.array_join(F.transform("items", shown), "|"))


@query(
    "ledger_stats_by_currency",
    inp.cte(*inp.FLAT_CTE)
    + "select moneda, count(*) as total_facturas, cast(sum(total) as decimal(28,2)) as monto_total,"
    " round(cast(sum(total) as double) / count(total), 2) as promedio_factura, "
    "count(distinct codigo_cliente) as total_clientes from fx_facturas group by moneda",
)
def ledger_stats_by_currency(spark, folder):
    return ledger.by_currency(inp.plain_facturas(spark, folder)).withColumn(
        "promedio_factura", F.round(F.col("promedio_factura").cast("double"), 2)
    )


REPEATED_SQL = """
select codigo_cliente, moneda, cast(floor(total / 50000) * 50000 as decimal(18,2)) as total, id
from {headers}
"""


@query(
    "repeated_invoices",
    inp.cte(*inp.FLAT_CTE, ("rough", REPEATED_SQL.format(headers="fx_facturas")))
    + "select codigo_cliente, moneda, total, count(*) as times, min(id) as first_id, "
    "max(id) as last_id from rough where codigo_cliente is not null and total is not null "
    "group by codigo_cliente, moneda, total having count(*) > 1",
)
def repeated_invoices(spark, folder):
    """Totals are rounded down, as the test ledger repeats none to the cent."""
    rough = inp.sql(spark, REPEATED_SQL, headers=inp.plain_facturas(spark, folder))
    return ledger.repeated(rough)


@query(
    "lookup_found",
    inp.cte(*inp.FLAT_CTE)
    + "select r.id, f.codigo_cliente, f.total, f.id is not null as found from "
    "(select distinct 3 * l_partkey as id from lineitem) r left join fx_facturas f on f.id = r.id",
)
def lookup_found(spark, folder):
    headers = inp.plain_facturas(spark, folder).select("id", "codigo_cliente", "total")
    return ledger.lookup(_requested(spark, folder), headers)


def _requested(spark, folder):
    """Ids asked for: some are in the ledger, some are not, many repeat."""
    return table(spark, folder, "lineitem").select((F.col("l_partkey") * 3).alias("id"))


@query(
    "lookup_missing",
    inp.cte(*inp.FLAT_CTE)
    + "select distinct 20 * l_partkey as id from lineitem "
    "where 20 * l_partkey not in (select id from fx_facturas)",
)
def lookup_missing(spark, folder):
    requested = table(spark, folder, "lineitem").select((F.col("l_partkey") * 20).alias("id"))
    return ledger.missing(requested, inp.plain_facturas(spark, folder))


@query(
    "invoice_code",
    inp.cte(*inp.FLAT_CTE)
    + "select id, 'FACT-' || upper(substring(sha256(id::varchar), 1, 8)) as codigo_factura, "
    "'FACT-' || upper(substring(sha256(id::varchar), 1, 16)) as wide_code from fx_facturas",
)
def invoice_code(spark, folder):
    return inp.plain_facturas(spark, folder).select(
        "id",
        tx.invoice_code(F.col("id")).alias("codigo_factura"),
        tx.invoice_code(F.col("id"), 16).alias("wide_code"),
    )


@query(
    "item_subtotals",
    inp.cte(*inp.FLAT_CTE)
    + "select factura_id, pos::bigint as pos, l_partkey, l_suppkey, cantidad::bigint as cantidad, "
    "precio_unitario, cast(cantidad * precio_unitario as decimal(18,2)) as subtotal from fx_items",
)
def item_subtotals(spark, folder):
    return money.item_subtotals(inp.amount_items(spark, folder))


@query(
    "totals",
    inp.cte(*inp.FLAT_CTE)
    + "select id, cast(s as decimal(18,2)) as subtotal, "
    "cast(s * 0.18 as decimal(18,2)) as igv, cast(s * 1.18 as decimal(18,2)) as total from "
    "(select f.id, coalesce(sum(i.subtotal), 0) as s from fx_facturas f "
    "left join fx_items i on i.factura_id = f.id group by f.id) as t",
)
def totals(spark, folder):
    return money.totals(inp.plain_facturas(spark, folder), inp.amount_items(spark, folder))


@query(
    "deduction",
    inp.cte(*inp.FLAT_CTE)
    + "select id, total, detraccion_porcentaje, case when total > 0 and "
    "detraccion_porcentaje > 0 then cast(total * detraccion_porcentaje / 100 as decimal(18,2)) "
    "when coalesce(detraccion_porcentaje, 0) = 0 then null else cast(7.5 as decimal(18,2)) end "
    "as monto from (select id, detraccion_porcentaje, case when id % 3 = 0 then -total "
    "when id % 7 = 0 then null else total end as total from fx_facturas) as t",
)
def deduction(spark, folder):
    shifted = inp.plain_facturas(spark, folder).select(
        "id",
        "detraccion_porcentaje",
        F.expr("case when id % 3 = 0 then -total when id % 7 = 0 then null else total end").alias(
            "total"
        ),
        F.lit("7.50").cast("decimal(18,2)").alias("old_monto"),
    )
    return money.deductions(shifted).drop("old_monto")


@query(
    "money_display",
    inp.cte(*inp.FLAT_CTE)
    + "select id, format('{:,.2f}', total::double) as amount, coalesce(moneda, 'PEN') || ' ' || "
    "format('{:,.2f}', total::double) as with_currency from fx_facturas",
)
def money_display(spark, folder):
    currency = F.coalesce("moneda", F.lit(fv.DEFAULT_CURRENCY))
    return inp.plain_facturas(spark, folder).select(
        "id",
        nm.money_text(F.col("total")).alias("amount"),
        nm.currency_text(currency, F.col("total")).alias("with_currency"),
    )


@query(
    "date_formats",
    "select event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') as report_time, "
    "strftime(ts, '%Y%m%d_%H%M%S') as export_time, strftime(ts, '%H:%M:%S') as log_time, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso_time from events",
)
def date_formats(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", fv.REPORT_TIME_FORMAT).alias("report_time"),
        F.date_format("ts", fv.EXPORT_TIME_FORMAT).alias("export_time"),
        F.date_format("ts", fv.LOG_TIME_FORMAT).alias("log_time"),
        F.date_format("ts", fv.ISO_TIME_FORMAT).alias("iso_time"),
    )


NUMBER_SQL = r"regexp_extract({0}, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
INTEGER_SQL = r"regexp_extract({0}, '^\s*([+-]?[0-9]+)', 1)"


def _number(column: str, kind: str = "decimal(18,2)") -> str:
    return f"coalesce(try_cast({NUMBER_SQL.format(column)} as {kind}), 0)::{kind}"


def _integer(column: str) -> str:
    return f"coalesce(try_cast({INTEGER_SQL.format(column)} as bigint), 0)"


@query(
    "lenient_numbers",
    inp.cte(*inp.TYPED_CTE)
    + f"select event_id, typed, {_integer('typed')} as as_integer, "
    f"{_number('typed', 'double')} as as_number, "
    f"nullif({_number('typed', 'double')}, 0) as number_or_null from fx_typed",
)
def lenient_numbers(spark, folder):
    number = nm.read_number(F.col("typed"), "double")
    return inp.typed_numbers(spark, folder).select(
        "event_id",
        "typed",
        nm.read_integer(F.col("typed")).alias("as_integer"),
        number.alias("as_number"),
        nm.null_if_zero(number).alias("number_or_null"),
    )


FORM_LINES_SQL = (
    "read_lines",
    "select id, pos, coalesce(descripcion, '') as descripcion, "
    f"{_integer('cantidad')}::decimal(18,4) as cantidad, "
    f"{_number('precio_unitario')} as precio_unitario, {_number('subtotal')} as subtotal "
    "from fx_form_items",
)
KEPT_SQL = (
    "kept_lines",
    "select *, row_number() over (partition by id order by pos) as item_no from read_lines "
    "where descripcion <> '' or cantidad > 0",
)


@query(
    "form_items",
    inp.cte(*inp.FORM_CTE, FORM_LINES_SQL, KEPT_SQL)
    + "select id as factura_id, item_no, descripcion, cantidad, precio_unitario, subtotal "
    "from kept_lines",
)
def form_items(spark, folder):
    return ledger.numbered_items(forms.form_items(inp.forms(spark, folder)))


@query(
    "form_payload",
    inp.cte(*inp.FORM_CTE, FORM_LINES_SQL, KEPT_SQL)
    + "select f.id, nullif(codigo_cliente, '') as codigo_cliente, razon_social_cliente, "
    "nullif(direccion_cliente, '') as direccion_cliente, nullif(distrito, '') as distrito, "
    "nullif(forma_pago, '') as forma_pago, nullif(moneda, '') as moneda, "
    f"nullif({_number('f.subtotal')}, 0) as subtotal, nullif({_number('igv')}, 0) as igv, "
    f"nullif({_number('total')}, 0) as total, "
    f"case when {_number('porcentaje_detraccion')} > 0 or {_number('monto_detraccion')} > 0 "
    f"then {_number('porcentaje_detraccion', 'decimal(9,2)')} end as detraccion_porcentaje, "
    f"case when {_number('porcentaje_detraccion')} > 0 or {_number('monto_detraccion')} > 0 "
    f"then {_number('monto_detraccion')} end as detraccion_monto, "
    "coalesce(k.n, 0) as n_items from fx_forms f left join "
    "(select id, count(*) as n from kept_lines group by id) k on k.id = f.id",
)
def form_payload(spark, folder):
    sent = forms.payload(inp.forms(spark, folder))
    return sent.select(
        "id",
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
