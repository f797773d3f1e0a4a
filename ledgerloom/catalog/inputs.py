"""Inputs of the registered queries, derived from the given tables.

Each input is stated once as SQL that both engines run, with ``{name}`` where
a table goes.  Two inputs hold invoices:

* ``facturas`` and ``items``: a flat ledger of headers (orders, customer,
  nation) and items (lineitem, part);
* ``replies``: model replies, one per order.  The items of a reply are computed
  from the order's own columns, so a reply is built in its row and no group of
  rows is ever gathered for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom import session
from ledgerloom.operators import pages
from ledgerloom.sources.tables import table

# --------------------------------------------------------------------- flat ledger
ITEMS_SQL = """
select l_orderkey as factura_id, l_linenumber as pos, l_partkey, l_suppkey,
  case when l_partkey % 17 = 0 then '' when l_partkey % 19 = 0 then null
       else upper(p_name) end as descripcion,
  cast(l_quantity as int) as cantidad,
  cast(l_extendedprice as decimal(18,2)) as precio_unitario,
  cast(cast(l_quantity as int) * cast(l_extendedprice as decimal(18,2)) as decimal(18,2))
    as subtotal
from {lineitem} left join {part} on p_partkey = l_partkey
"""

# The same items without the description, which would take a join with part.
AMOUNT_ITEMS_SQL = """
select l_orderkey as factura_id, l_linenumber as pos, l_partkey, l_suppkey,
  cast(l_quantity as int) as cantidad,
  cast(l_extendedprice as decimal(18,2)) as precio_unitario,
  cast(cast(l_quantity as int) * cast(l_extendedprice as decimal(18,2)) as decimal(18,2))
    as subtotal
from {lineitem}
"""

CODE_SQL = """case when o_custkey % 10 = 0 then null
       when o_custkey % 10 = 1 then cast(o_custkey as string)
       when o_custkey % 10 < 5 then lpad(cast(o_custkey as string), 8, '0')
       else concat('20', lpad(cast(o_custkey as string), 9, '0')) end"""

PAYMENT_SQL = """case o_orderpriority when '1-URGENT' then 'CONTADO' when '2-HIGH' then 'CREDITO'
       when '3-MEDIUM' then 'YAPE' when '5-LOW' then 'CHEQUE' else null end"""

CURRENCY_SQL = """case when o_orderkey % 10 = 0 then 'USD' when o_orderkey % 10 = 1 then null
       when o_orderkey % 10 = 2 then 'EUR' when o_orderkey % 10 = 3 then 'soles'
       else 'PEN' end"""

PERCENT_SQL = """case when o_orderkey % 4 = 0 then cast(12 as decimal(9,2))
       when o_orderkey % 4 = 1 then cast(0 as decimal(9,2)) else null end"""

FACTURAS_SQL = f"""
select o_orderkey as id, {CODE_SQL} as codigo_cliente,
  c_name as razon_social_cliente, upper(n_name) as distrito,
  {PAYMENT_SQL} as forma_pago, {CURRENCY_SQL} as moneda,
  cast(o_totalprice as decimal(18,2)) as total,
  {PERCENT_SQL} as detraccion_porcentaje,
  o_orderdate as fecha_registro
from {{orders}} left join {{customer}} on c_custkey = o_custkey
  left join {{nation}} on n_nationkey = c_nationkey
"""

# The same headers without name and district, which would take two joins.
PLAIN_FACTURAS_SQL = f"""
select o_orderkey as id, {CODE_SQL} as codigo_cliente,
  {PAYMENT_SQL} as forma_pago, {CURRENCY_SQL} as moneda,
  cast(o_totalprice as decimal(18,2)) as total,
  {PERCENT_SQL} as detraccion_porcentaje,
  o_orderdate as fecha_registro
from {{orders}}
"""

# ------------------------------------------------------------------ nested invoices
HEADS_SQL = f"""
select o_orderkey as id, {CODE_SQL} as codigo_cliente,
  concat('EMPRESA ', cast(o_custkey as string), ' SAC') as razon_social_cliente,
  case o_orderkey % 6 when 0 then null
    when 1 then concat('AV LOS OLIVOS ', cast(o_custkey as string))
    when 2 then concat('Jr. Unión ', cast(o_custkey as string))
    when 3 then concat('AV GRAU, ', cast(o_custkey as string))
    when 4 then concat('CALLE (ALTOS) ', cast(o_custkey as string))
    else concat('AV PERÚ ', cast(o_custkey as string)) end as direccion_cliente,
  case o_orderkey % 5 when 0 then 'SAN ISIDRO' when 1 then 'MIRAFLORES' when 2 then 'Surco'
    when 3 then null else 'BREÑA' end as distrito,
  {PAYMENT_SQL} as forma_pago, {CURRENCY_SQL} as moneda, {PERCENT_SQL} as porcentaje,
  cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as cents,
  cast(o_orderkey % 5 as int) as n_items,
  cast(o_orderkey % 7 as int) as fault,
  o_orderdate as fecha_registro
from {{orders}}
"""

# One item of an invoice, from the invoice's id and cents and the item number i.
ITEM_SQL = {
    "descripcion": "case when (id + i) % 7 = 0 then '' when (id + i) % 11 = 0 then null "
    "else concat('SERVICIO ', cast(i as string)) end",
    "cantidad": "cast(cast((id + 3 * i) % 12 as decimal(12,4)) + "
    "case when (id + i) % 9 = 0 then 0.5 else 0.0 end as decimal(18,4))",
    "precio_unitario": "cast(cast(cents % (1000 * i + 997) as decimal(12,0)) * 0.01 "
    "as decimal(18,2))",
}
ITEM_SUBTOTAL_SQL = (
    f"cast(cast({ITEM_SQL['cantidad']} * {ITEM_SQL['precio_unitario']} as decimal(18,2)) + "
    "case when fault = 1 and i = 1 then 1 else 0 end as decimal(18,2))"
)

# Header amounts as written in the reply, from the sum of the item subtotals.
AMOUNTS_SQL = """
select *,
  cast(igv_true + case when fault = 3 then 0.50 else 0.00 end as decimal(18,3)) as igv_any,
  cast(subtotal + igv_true + case when fault = 3 then 0.50 else 0.00 end
    + case when fault = 4 then 2.00 else 0.00 end
    + case when fault = 6 then 0.005 else 0.000 end as decimal(18,3)) as total
from (
  select *, cast(cast(subtotal * 0.18 as decimal(18,2)) as decimal(18,3)) as igv_true
  from (
    select *, cast(items_sum + case when fault = 2 then 5 else 0 end as decimal(18,3))
      as subtotal
    from {summed}
  ) as a
) as b
"""

INVOICES_SQL = """
select id, codigo_cliente, razon_social_cliente, direccion_cliente, distrito, items,
  forma_pago, moneda, subtotal,
  case when id % 23 = 0 then null else igv_any end as igv,
  total, porcentaje,
  cast(case when porcentaje is null then null
    else cast(cast(total as decimal(18,2)) * porcentaje / 100 as decimal(18,2))
      + case when fault = 5 then 3 else 0 end end as decimal(18,2)) as monto,
  fecha_registro
from {amounts}
"""

REPLIES_SQL = """
select id as doc_id,
  case id % 8
    when 1 then concat('```json', chr(10), js, chr(10), '```')
    when 2 then concat('  ', js, chr(10), '```')
    when 3 then concat('```', chr(10), js, chr(10), '```')
    when 4 then substring(js, 1, length(js) - 5)
    when 5 then concat('[', js, ']')
    when 6 then concat(js, ' Listo.')
    else js end as content,
  cast(200 + id % 1300 as bigint) as total_tokens,
  fecha_registro
from {texts}
"""

# Some documents were answered twice; the second reply is the same but for a blank.
REPEATED_SQL = """
select * from {once}
union all
select doc_id, concat(' ', content), total_tokens + 1000, fecha_registro from {once}
where doc_id % 9 = 4
"""

# The accepted reply that counts has the least text: the one with the blank.
PICKED_SQL = """
select doc_id, max(total_tokens) as total_tokens from {replies} group by doc_id
"""

# ------------------------------------------------------------------------ documents
UPLOADS_SQL = """
select doc_id,
  case when doc_id % 11 = 0 then ''
       when doc_id % 7 = 0 then concat('doc', cast(doc_id as string), '.txt')
       when doc_id % 5 = 0 then concat('doc', cast(doc_id as string), '.PDF')
       else concat('doc', cast(doc_id as string), '.pdf') end as filename,
  case when doc_id % 13 = 0 then cast(10485760 as bigint)
       when doc_id % 13 = 1 then cast(10485761 as bigint)
       when doc_id % 13 = 2 then cast(10747904 as bigint)
       else n_chars end as size_bytes,
  doc_id % 3 <> 0 as has_pdf_magic,
  case when doc_id % 17 = 0 then 'text/plain' when doc_id % 29 = 0 then null
       else 'application/pdf' end as content_type
from {documents}
"""

OPENED_SQL = """
select doc_id, lang, source, text, concat('landing/doc', cast(doc_id as string), '.pdf') as file_path,
  case when doc_id % 31 = 0 then null when doc_id % 13 = 1 then cast(10747904 as bigint)
    else n_chars end as size_bytes,
  case doc_id % 9 when 0 then 'corrupt' when 1 then 'empty' when 5 then 'xref table missing'
    else null end as open_error,
  (doc_id % 9 = 2 or doc_id % 18 = 0) as needs_pass,
  case when doc_id % 9 in (0, 1) then null when doc_id % 9 = 3 then 0
    else 1 + doc_id % 40 end as page_count,
  doc_id % 9 not in (3, 4) as first_page_ok
from {documents}
"""

EVENTS_SQL = """
select event_id, user_id as job_id, ts,
  case event_type when 'signup' then 'PENDING' when 'view' then 'PROCESSING'
    when 'click' then 'PROCESSING' when 'purchase' then 'COMPLETED' else 'FAILED' end as status,
  case when event_type in ('signup', 'purchase')
    then concat('job', cast(user_id as string), '.pdf') else null end as filename,
  case when event_type = 'signup'
    then cast(user_id * 791911 % 12000000 as bigint) else null end as size_bytes,
  case when event_type = 'error' and event_id % 2 = 0
    then concat('error ', cast(event_id as string)) else null end as error
from {events}
"""

# Texts as a user may type them into a number field.
TYPED_SQL = """
select event_id,
  case event_id % 9 when 0 then null when 1 then '' when 2 then 'abc' when 3 then '0'
    when 4 then concat(cast(user_id as string), '.75')
    when 5 then concat('-', cast(user_id as string), '.5')
    when 6 then concat('  ', cast(user_id as string), 'abc')
    when 7 then concat('.', cast(user_id as string))
    else concat(cast(user_id as string), 'e2') end as typed
from {events}
"""

# One item of an edit form, from the order's id and cents and the item number i.
FORM_ITEM_SQL = {
    "descripcion": "case when (id + i) % 3 = 0 then '' when (id + i) % 7 = 0 then null "
    "else concat('PRODUCTO ', cast(i as string)) end",
    "cantidad": "case (id + i) % 8 when 0 then '' when 1 then 'abc' when 2 then '0' "
    "when 3 then '2.7' when 4 then '12abc' when 5 then '-1' "
    "else cast((id + i) % 50 as string) end",
    "precio_unitario": "case when (id + i) % 6 = 0 then 'x' when (id + i) % 6 = 1 then '' "
    "else concat(cast(cents % (1000 * i + 997) as string), '.25') end",
    "subtotal": "case when (id + i) % 10 = 0 then '' "
    "else concat(cast(cents % (500 * i + 331) as string), '.50') end",
}

FORM_HEADS_SQL = """
select id, cents, n_items,
  coalesce(codigo_cliente, '') as codigo_cliente, razon_social_cliente,
  coalesce(direccion_cliente, '') as direccion_cliente, coalesce(distrito, '') as distrito,
  coalesce(forma_pago, '') as forma_pago, coalesce(moneda, '') as moneda,
  case when id % 12 = 0 then '' when id % 12 = 1 then '0'
    else concat(cast(cents % 100000 as string), '.10') end as subtotal,
  case when id % 12 = 2 then 'abc' else concat(cast(cents % 9999 as string), '.5') end as igv,
  case when id % 12 = 3 then '0.00' else concat(cast(cents % 123457 as string), '.99') end
    as total,
  case when porcentaje is null then '' else cast(porcentaje as string) end
    as porcentaje_detraccion,
  case when id % 6 = 0 then '15.5' when id % 6 = 1 then '0' else '' end as monto_detraccion
from {heads}
"""


# ------------------------------------------------------------------- Spark side
def sql(spark: SparkSession, text: str, **relations: DataFrame) -> DataFrame:
    return spark.sql(text, **relations)


def _tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in names}


def items(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, ITEMS_SQL, **_tables(spark, folder, "lineitem", "part"))


def facturas(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, FACTURAS_SQL, **_tables(spark, folder, "orders", "customer", "nation"))


def amount_items(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, AMOUNT_ITEMS_SQL, **_tables(spark, folder, "lineitem"))


def plain_facturas(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, PLAIN_FACTURAS_SQL, **_tables(spark, folder, "orders"))


def _array_of(parts: dict[str, str]) -> str:
    members = ", ".join(f"'{name}', {text}" for name, text in parts.items())
    return f"transform(filter(sequence(0, n_items), n -> n > 0), i -> named_struct({members}))"


def heads(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return sql(spark, HEADS_SQL, orders=orders)


def written_invoices(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Invoices with amounts as the replies write them."""
    parts = {**ITEM_SQL, "subtotal": ITEM_SUBTOTAL_SQL}
    summed = (
        heads(spark, orders)
        .withColumn("items", F.expr(_array_of(parts)))
        .withColumn(
            "items_sum",
            F.expr(
                "aggregate(items, cast(0 as decimal(18,2)), "
                "(done, x) -> cast(done + x.subtotal as decimal(18,2)))"
            ),
        )
    )
    return sql(spark, INVOICES_SQL, amounts=sql(spark, AMOUNTS_SQL, summed=summed))


def replies_from(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """One reply per order; a projection, so it also runs on a stream."""
    withheld = F.when(
        F.col("porcentaje").isNotNull(),
        F.struct(F.col("porcentaje"), F.col("monto")),
    ).alias("detraccion")
    contract = F.struct(
        "codigo_cliente",
        "razon_social_cliente",
        "direccion_cliente",
        "distrito",
        "items",
        "forma_pago",
        "moneda",
        "subtotal",
        "igv",
        "total",
        withheld,
    )
    texts = written_invoices(spark, orders).select(
        "id",
        F.to_json(contract, {"ignoreNullFields": "false"}).alias("js"),
        "fecha_registro",
    )
    once = sql(spark, REPLIES_SQL, texts=texts).withColumn(
        "again", F.explode(F.when(F.col("doc_id") % 9 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    return once.select(
        "doc_id",
        F.concat(F.when(F.col("again") == 1, " ").otherwise(""), "content").alias("content"),
        (F.col("total_tokens") + 1000 * F.col("again")).cast("bigint").alias("total_tokens"),
        "fecha_registro",
    )


_WRITTEN: dict[tuple[str, str], str] = {}


def replies_path(spark: SparkSession, folder: str) -> str:
    """Where the replies of a table folder lie; written on first use."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN:
        target = session.fresh_path(spark, "replies")
        replies_from(spark, table(spark, folder, "orders")).write.parquet(target)
        _WRITTEN[key] = target
    return _WRITTEN[key]


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """The table of replies, as a batch job of the model would have left it."""
    return spark.read.parquet(replies_path(spark, folder))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def paged_documents(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """Documents with ``pages``; one line is one page."""
    pages_column = pages.page_array(F.col("text"), "\n", first)
    return documents(spark, folder).select("doc_id", pages_column.alias("pages"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, UPLOADS_SQL, documents=documents(spark, folder))


def opened(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, OPENED_SQL, documents=documents(spark, folder))


def attempt_texts() -> list[Column]:
    """What each method found; some texts have nothing on their first page."""
    text, key = F.col("text"), F.col("doc_id")
    late = F.concat(F.lit("--\n"), text)
    return [
        F.when(key % 2 == 0, text).otherwise("-- "),
        F.when(key % 3 == 0, F.when(key % 4 == 1, late).otherwise(text)),
        F.when(key % 5 == 0, text).otherwise("0123456789"),
    ]


def methods(spark: SparkSession, folder: str) -> DataFrame:
    """Three extraction attempts per document, from one scan."""
    attempts = enumerate(attempt_texts(), 1)
    rows = [
        F.struct(
            F.lit(fv.EXTRACTION_METHODS[rank - 1]).alias("method"),
            F.lit(rank).alias("priority"),
            body.alias("text"),
        )
        for rank, body in attempts
    ]
    return documents(spark, folder).select("doc_id", F.inline(F.array(*rows)))


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    return job_events_from(spark, table(spark, folder, "events"))


def job_events_from(spark: SparkSession, events: DataFrame) -> DataFrame:
    return sql(spark, EVENTS_SQL, events=events)


def typed_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return sql(spark, TYPED_SQL, events=table(spark, folder, "events"))


def forms(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    filled = sql(spark, FORM_HEADS_SQL, heads=heads(spark, orders))
    return filled.withColumn("items", F.expr(_array_of(FORM_ITEM_SQL))).drop("cents", "n_items")


# --------------------------------------------------------------------- SQL side
def _named(text: str, **names: str) -> str:
    return text.format(**names)


def cte(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in parts) + "\n"


FLAT_CTE = [
    ("fx_items", _named(ITEMS_SQL, lineitem="lineitem", part="part")),
    (
        "fx_facturas",
        _named(FACTURAS_SQL, orders="orders", customer="customer", nation="nation"),
    ),
]

_item_columns = ", ".join(
    f"{text} as {name}" for name, text in {**ITEM_SQL, "subtotal": ITEM_SUBTOTAL_SQL}.items()
)

WRITTEN_CTE = [
    ("heads", _named(HEADS_SQL, orders="orders")),
    (
        "lines",
        f"select id, i as pos, {_item_columns} from "
        "(select *, unnest(range(1, n_items + 1)) as i from heads) as t",
    ),
    (
        "gathered",
        "select id, sum(subtotal) as items_sum, list({'descripcion': descripcion, "
        "'cantidad': cantidad, 'precio_unitario': precio_unitario, 'subtotal': subtotal} "
        "order by pos) as items from lines group by id",
    ),
    (
        "summed",
        "select h.*, cast(coalesce(g.items_sum, 0) as decimal(18,2)) as items_sum, "
        "coalesce(g.items, []) as items from heads h left join gathered g on g.id = h.id",
    ),
    ("amounts", _named(AMOUNTS_SQL, summed="summed")),
    ("written", _named(INVOICES_SQL, amounts="amounts")),
]

# Accepted replies as typed invoices; SQL tells them by the kind of reply.
INVOICE_CTE = WRITTEN_CTE + [
    (
        "invoices",
        "select * replace (cast(subtotal as decimal(18,2)) as subtotal, "
        "cast(igv as decimal(18,2)) as igv, cast(total as decimal(18,2)) as total), "
        "subtotal as subtotal_raw, igv as igv_raw, total as total_raw "
        "from written where id % 8 in (0, 1, 2, 7)",
    ),
    ("invoice_items", "select l.* from lines l join invoices v on v.id = l.id"),
]

REPLY_CTE = WRITTEN_CTE + [
    (
        "texts",
        "select id, fecha_registro, to_json({'codigo_cliente': codigo_cliente, "
        "'razon_social_cliente': razon_social_cliente, "
        "'direccion_cliente': direccion_cliente, 'distrito': distrito, 'items': items, "
        "'forma_pago': forma_pago, 'moneda': moneda, 'subtotal': subtotal, 'igv': igv, "
        "'total': total, 'detraccion': case when porcentaje is null then null else "
        "{'porcentaje': porcentaje::decimal(18,2), 'monto': monto} end})::varchar as js from written",
    ),
    ("fx_once", _named(REPLIES_SQL, texts="texts")),
    ("fx_replies", _named(REPEATED_SQL, once="fx_once")),
    ("fx_picked", _named(PICKED_SQL, replies="fx_replies")),
]

UPLOAD_CTE = [("fx_uploads", _named(UPLOADS_SQL, documents="documents"))]
OPENED_CTE = [("fx_opened", _named(OPENED_SQL, documents="documents"))]
EVENT_CTE = [("fx_events", _named(EVENTS_SQL, events="events"))]
TYPED_CTE = [("fx_typed", _named(TYPED_SQL, events="events"))]
METHOD_CTE = [
    (
        "fx_methods",
        "select doc_id, 'PyMuPDF' as method, 1 as priority, "
        "case when doc_id % 2 = 0 then text else '-- ' end as text from documents "
        "union all select doc_id, 'pdfplumber', 2, "
        "case when doc_id % 3 = 0 then case when doc_id % 4 = 1 then '--' || chr(10) || text "
        "else text end else null end from documents "
        "union all select doc_id, 'PyPDF2', 3, "
        "case when doc_id % 5 = 0 then text else '0123456789' end from documents",
    )
]
_form_columns = ", ".join(f"{text} as {name}" for name, text in FORM_ITEM_SQL.items())
FORM_CTE = [
    ("heads", _named(HEADS_SQL, orders="orders")),
    ("fx_forms", _named(FORM_HEADS_SQL, heads="heads")),
    (
        "fx_form_items",
        f"select id, i as pos, {_form_columns} from "
        "(select *, unnest(range(1, n_items + 1)) as i from heads) as t",
    ),
]
# White space around a page is space or newline in the test tables.
PAGE_CTE = [
    (
        "fx_pages",
        "select doc_id, unnest(range(1, len(a) + 1)) as page_no, trim(unnest(a)) as text "
        "from (select doc_id, string_split(text, chr(10)) as a from documents) as t",
    )
]
ASSEMBLED_CTE = PAGE_CTE + [
    (
        "assembled",
        "select doc_id, string_agg(concat(chr(10), '--- PÁGINA ', page_no, ' ---', chr(10), "
        "text, chr(10)), '' order by page_no) as raw_text, count(*) as pages_with_text "
        "from fx_pages where page_no <= 3 and length(text) > 20 group by doc_id",
    ),
    (
        "per_document",
        "select d.doc_id, coalesce(a.raw_text, '') as raw_text, "
        "coalesce(a.pages_with_text, 0) as pages_with_text "
        "from documents d left join assembled a on a.doc_id = d.doc_id",
    ),
]
