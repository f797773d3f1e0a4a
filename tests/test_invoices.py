"""Verdicts, money, checks, forms, ledger, report, state."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import numbers as nm
from ledgerloom.operators import checks, forms, intake, jobs, ledger, money, report, state
from ledgerloom.schemas import Settings

MB = 1024 * 1024


def test_upload_verdict_order(spark):
    rows = [
        ("", 99 * MB, False, "text/plain", 400, fv.NO_NAME[1]),
        (None, 1, True, "application/pdf", 400, fv.NO_NAME[1]),
        ("a.txt", 99 * MB, False, "text/plain", 400, fv.NOT_PDF_NAME[1]),
        ("a.pdf", 99 * MB, False, "text/plain", 400, fv.NOT_PDF_TYPE[1]),
        ("a.pdf", 10 * MB, True, "application/pdf", None, None),
        ("a.PdF", 10 * MB + 1, False, "application/pdf", 413,
         "Archivo demasiado grande: 10.0MB. Máximo permitido: 10MB"),
        ("a.pdf", 10 * MB + MB // 4, True, "application/pdf", 413,
         "Archivo demasiado grande: 10.2MB. Máximo permitido: 10MB"),
        ("a.pdf", 5, False, "application/pdf", 400, fv.NOT_PDF_CONTENT[1]),
        ("a.pdf", 0, None, "application/pdf", 400, fv.NOT_PDF_CONTENT[1]),
    ]
    table = spark.createDataFrame(
        [(i, *r[:4]) for i, r in enumerate(rows)],
        "i INT, filename STRING, size_bytes BIGINT, has_pdf_magic BOOLEAN, content_type STRING",
    )
    for got in intake.upload_verdict(table).collect():
        code, reason = rows[got.i][4:]
        assert (got.code, got.reason, got.accepted) == (code, reason, code is None)
    untyped = intake.upload_verdict(table.drop("content_type")).where("i = 3").first()
    assert untyped.code == 413


def test_integrity_order(spark):
    rows = [
        ("corrupt", True, 0, False, fv.CORRUPT_FILE),
        ("empty", None, None, None, fv.EMPTY_FILE),
        (None, True, 0, False, fv.PASSWORD_FILE),
        (None, False, 0, False, fv.ZERO_PAGES),
        (None, False, 3, False, fv.UNREADABLE_PAGE),
        ("boom", None, None, None, fv.OTHER_OPEN_ERROR + "boom"),
        (None, False, 3, True, ""),
    ]
    table = spark.createDataFrame(
        [(i, *r[:4]) for i, r in enumerate(rows)],
        "i INT, open_error STRING, needs_pass BOOLEAN, page_count INT, first_page_ok BOOLEAN",
    )
    for got in intake.integrity_verdict(table).collect():
        assert got.message == rows[got.i][4] and got.is_valid == (got.message == "")
        assert got.pages == (3 if got.is_valid else 0)


def test_lenient_numbers(spark):
    cases = {
        "1": (1, 1.0), "1.9": (1, 1.9), "": (0, 0.0), None: (0, 0.0), "abc": (0, 0.0),
        "0": (0, 0.0), "-2.5": (-2, -2.5), " 12px": (12, 12.0), "1e3": (1, 1000.0),
        ".5": (0, 0.5), "5.": (5, 5.0), "+7": (7, 7.0), "1,500.00": (1, 1.0), "--1": (0, 0.0),
        "99999999999999999999": (0, 1e20), "1e": (1, 1.0),
    }
    table = spark.createDataFrame([(k,) for k in cases], "s STRING")
    rows = table.select(
        "s",
        nm.read_integer(F.col("s")).alias("i"),
        nm.read_number(F.col("s"), "double").alias("n"),
    ).collect()
    for row in rows:
        assert (row.i, row.n) == cases[row.s], row.s


def test_deduction(spark):
    D = Decimal
    rows = [
        (D("1770"), D("12"), D("1"), D("212.40")),
        (D("0"), D("12"), D("1"), D("1")),
        (D("-5"), D("12"), None, None),
        (None, D("12"), D("1"), D("1")),
        (D("100"), D("0"), D("1"), None),
        (D("100"), None, D("1"), None),
        (D("0.10"), D("5"), None, D("0.01")),
    ]
    table = spark.createDataFrame(
        [(i, *r[:3]) for i, r in enumerate(rows)],
        "i INT, total DECIMAL(18,2), detraccion_porcentaje DECIMAL(9,2), old_monto DECIMAL(18,2)",
    )
    for got in money.deductions(table).collect():
        assert got.monto == rows[got.i][3], got


def test_rounding_and_display(spark):
    row = spark.range(1).select(
        nm.item_subtotal(F.lit("2.9"), F.lit("10.10").cast("decimal(18,2)")).alias("s"),
        nm.item_subtotal(F.lit("x"), F.lit("10.10").cast("decimal(18,2)")).alias("bad"),
        nm.total_with_vat(F.lit("0.25").cast("decimal(18,2)")).alias("t"),
        nm.currency_text(F.lit("PEN"), F.lit("1234567.5").cast("decimal(18,2)")).alias("c"),
        nm.shortest_text(F.lit("12.00").cast("decimal(9,2)")).alias("whole"),
        nm.shortest_text(F.lit("100.50").cast("decimal(9,2)")).alias("half"),
        nm.shortest_text(F.lit("100").cast("decimal(9,0)")).alias("hundred"),
        nm.rounded_megabytes(F.lit(10 * MB + MB // 8)).alias("mb"),
    ).first()
    assert row.s == Decimal("20.20") and row.bad == 0 and row.t == Decimal("0.30")
    assert row.c == "PEN 1,234,567.50" and row.mb == 10.12
    assert (row.whole, row.half, row.hundred) == ("12", "100.5", "100")


ITEM = "STRUCT<descripcion: STRING, cantidad: {0}, precio_unitario: {1}, subtotal: {1}>"


def test_form_payload_and_fill(spark):
    form = spark.createDataFrame(
        [(1, "", "ACME", "", "LIMA", "", "USD", "0", "abc", "10.5", "0", "2.5",
          [("", "0", "1", "1"), ("", "2.9", "x", ""), ("P", "", "", "")])],
        "id INT, codigo_cliente STRING, razon_social_cliente STRING, direccion_cliente STRING, "
        "distrito STRING, forma_pago STRING, moneda STRING, subtotal STRING, igv STRING, "
        "total STRING, porcentaje_detraccion STRING, monto_detraccion STRING, "
        f"items ARRAY<{ITEM.format('STRING', 'STRING')}>",
    )
    sent = forms.payload(form)
    row = sent.first()
    assert row.codigo_cliente is None and row.moneda == "USD"
    assert (row.subtotal, row.igv, row.total) == (None, None, Decimal("10.50"))
    assert (row.detraccion.porcentaje, row.detraccion.monto) == (0, Decimal("2.50"))
    assert [(i.descripcion, i.cantidad) for i in row["items"]] == [("", 2), ("P", 0)]
    shown = forms.fill(sent).first()
    assert shown.codigo_cliente == "" and shown.total == "10.5" and shown.subtotal == ""
    assert (shown.porcentaje_detraccion, shown.monto_detraccion) == ("0", "2.5")
    assert shown["items"][0].cantidad == "2" and shown["items"][0].precio_unitario == ""
    bare = forms.fill(sent.withColumn("detraccion", F.lit(None).cast(sent.schema["detraccion"].dataType)))
    assert bare.first().porcentaje_detraccion == "0"


def invoices(spark):
    return spark.createDataFrame(
        [
            (1, "12345678", "A", "AV X", "LIMA", None, "PEN", Decimal("10"), Decimal("1.80"),
             Decimal("11.80"), (Decimal("12"), Decimal("1.42")), "a.pdf",
             [("x", Decimal("2"), Decimal("5"), Decimal("10")), ("", None, None, None),
              (None, None, None, None)]),
            (2, "123", None, "av, y", "", "CHEQUE", None, None, None, None, None, None, []),
            (3, "12345678901\n", None, None, None, None, "EUR", None, None, None, None, "", None),
        ],
        "id INT, codigo_cliente STRING, razon_social_cliente STRING, direccion_cliente STRING, "
        "distrito STRING, forma_pago STRING, moneda STRING, subtotal DECIMAL(18,2), "
        "igv DECIMAL(18,2), total DECIMAL(18,2), "
        "detraccion STRUCT<porcentaje: DECIMAL(9,2), monto: DECIMAL(18,2)>, filename STRING, "
        f"items ARRAY<{ITEM.format('DECIMAL(18,4)', 'DECIMAL(18,2)')}>",
    )


def test_violations(spark):
    raw = F.struct("subtotal", "igv", "total", "items", "detraccion")
    rows = {r.id: r.violations for r in checks.violations(invoices(spark).withColumn("raw", raw)).collect()}
    assert rows[1] == []
    assert rows[2] == ["client_code", "payment", "address_upper", "address_punctuation", "has_items"]
    assert rows[3] == ["client_code", "currency", "has_items"]


def test_ledger_rows(spark, tmp_path):
    from ledgerloom.sinks import tables

    day = datetime.date(2024, 2, 29)
    stored = ledger.stored(invoices(spark), day, Settings(code_width=16))
    path = str(tmp_path / "ledger")
    tables.append_ledger(stored, path)
    kept = tables.read_ledger(spark, path).orderBy("id").collect()
    assert [len(r["items"]) for r in kept] == [1, 0, 0]
    assert kept[0].fecha_emision == day and kept[0].estado == "procesada"
    assert len(kept[0].codigo_factura) == len("FACT-") + 16
    assert kept[1].detraccion_monto is None and kept[0].detraccion_monto == Decimal("1.42")
    assert '"direccion_cliente":"AV X"' in kept[0].datos_raw
    assert '"total":null' in kept[1].datos_raw
    assert tables.ledger_item_view(tables.read_ledger(spark, path)).count() == 1
    counts = {r.id: (r.items_stored, r.saved_without_items)
              for r in ledger.stored_item_counts(invoices(spark)).collect()}
    assert counts == {1: (1, False), 2: (0, True), 3: (0, True)}


def test_report(spark, tmp_path):
    from ledgerloom.sinks import tables

    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    table = report.rows(invoices(spark), at)
    lines = {(r.factura_id, r.section, r.row_no, r.label): r.value for r in table.collect()}
    assert lines[(1, fv.SECTION_DOCUMENT, 2, fv.LABEL_GENERATED)] == "02/01/2024 03:04:05"
    assert (2, fv.SECTION_DOCUMENT, 1, fv.LABEL_FILE) not in lines
    assert lines[(2, fv.SECTION_CLIENT, 4, fv.LABEL_DISTRICT)] == "N/A"
    assert lines[(1, fv.SECTION_ITEMS, 3, fv.LABEL_DESCRIPTION)] == "N/A"
    assert lines[(1, fv.SECTION_ITEMS, 2, fv.LABEL_PRICE)] == "0.00"
    assert (2, fv.SECTION_ITEMS, 0, fv.LABEL_NO_ITEMS) in lines
    assert lines[(1, fv.SECTION_DEDUCTION, 1, fv.LABEL_PERCENT)] == "12%"
    assert (2, fv.SECTION_DEDUCTION, 1, fv.LABEL_PERCENT) not in lines
    assert lines[(2, fv.SECTION_TOTALS, 3, fv.LABEL_TOTAL)] == "PEN 0.00"
    path = str(tmp_path / "report")
    tables.export_report(table, path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == table.count()
    assert {r.moneda for r in back.select("moneda").distinct().collect()} == {"PEN", "EUR"}
    folders = {r.currency_folder for r in back.select("currency_folder").distinct().collect()}
    assert folders == {"PEN", "EUR"}
    tables.export_report(table.withColumn("moneda", F.lit("soles")), path + "2")
    back = spark.read.option("header", True).csv(path + "2")
    assert {(r.moneda, r.currency_folder) for r in back.collect()} == {("soles", "other")}


def test_request_files(spark, tmp_path):
    import json

    from ledgerloom.operators import texts
    from ledgerloom.sinks import tables

    table = spark.createDataFrame([(7, "UN TEXTO")], "doc_id INT, cleaned_text STRING")
    path = str(tmp_path / "requests")
    tables.write_requests(texts.requests(texts.prompts(table)), path)
    line = json.loads(spark.read.text(path).first().value)
    assert line["custom_id"] == "7" and line["body"]["max_tokens"] == 1500
    assert [m["role"] for m in line["body"]["messages"]] == ["system", "user"]


def test_payload_source(spark, tmp_path):
    from ledgerloom.sources import tables as sources

    path = tmp_path / "in.jsonl"
    path.write_text('{"codigo_cliente":"1","total":2.5,"_filename":"f.pdf"}\n{"items":[{"cantidad":3}]}\n')
    rows = sources.payloads(spark, str(path)).orderBy(F.desc("total")).collect()
    assert rows[0].filename == "f.pdf" and rows[0].total == Decimal("2.50")
    assert rows[1]["items"][0].cantidad == 3 and rows[1].filename is None
    path.write_text('not json\n{\'total\': 7}\n{"total": 9} tail\n[{"a":1},{"a":2}]\n\n{"total": 1, "more": 2}\n')
    rows = sources.payloads(spark, str(path)).collect()
    assert [r.total for r in rows if r.accepted] == [Decimal("1.00")]
    assert len(rows) == 6 and sum(r.error is not None for r in rows) == 5
    assert [r.body for r in rows if r.accepted] == ['{"total": 1, "more": 2}']


def test_recompute(spark):
    row = money.recompute(invoices(spark)).where("id = 1").first()
    assert (row.subtotal, row.igv, row.total) == (Decimal("10"), Decimal("1.80"), Decimal("11.80"))
    assert row.detraccion.monto == Decimal("1.42")


def test_paging(spark):
    table = spark.range(20).select("id", (F.col("id") % 3).cast("timestamp").alias("fecha_registro"))
    everything = [r.id for r in ledger.page(table, 20, 0).collect()]
    assert [r.id for r in ledger.page(table, 4, 5).collect()] == everything[5:9]
    last = ledger.page(table, 1, 4).first()
    after = ledger.page_after(table, F.lit(last.fecha_registro), F.lit(last.id), 4)
    assert [r.id for r in after.collect()] == everything[5:9]


def test_hot_invoice_detail_and_totals(spark):
    """One invoice holds a third of the items, many of them copies."""
    headers = spark.range(50).select("id", F.lit("PEN").alias("moneda"))
    hot = spark.range(3000).selectExpr("7L as factura_id", "id % 2 as pos", "cast(1.10 as decimal(18,2)) as subtotal")
    rest = spark.range(6000).selectExpr("id % 40 as factura_id", "id as pos", "cast(2 as decimal(18,2)) as subtotal")
    items = hot.union(rest)
    detail = ledger.detail(headers, items)
    assert detail.count() == 9000 + 10
    assert detail.where("pos is null").count() == 10
    sums = {r.id: r.subtotal for r in money.totals(headers, items).collect()}
    assert sums[7] == Decimal("3600.00") and sums[45] == 0 and len(sums) == 50


def test_job_states(spark):
    T = datetime.datetime
    events = spark.createDataFrame(
        [
            (1, 1, T(2024, 1, 1), "PENDING", None), (2, 1, T(2024, 1, 3), "FAILED", None),
            (3, 1, T(2024, 1, 2), "PROCESSING", None),
            (4, 2, T(2024, 1, 1), "PROCESSING", None), (5, 2, T(2024, 1, 1), "COMPLETED", None),
            (6, 3, T(2024, 1, 9), "PENDING", None),
        ],
        "event_id BIGINT, job_id BIGINT, ts TIMESTAMP_NTZ, status STRING, error STRING",
    ).withColumns(
        {"filename": F.when(F.col("event_id") == 1, "a.pdf"), "size_bytes": F.lit(3 * MB)}
    )
    assert {r.job_id: r.status for r in jobs.latest(events).collect()} == {
        1: "FAILED", 2: "COMPLETED", 3: "PENDING"
    }
    records = jobs.records(events)
    listed = jobs.recent(records, 2).collect()
    assert [r.job_id for r in listed] == [3, 1] and listed[1].error == "Unknown error"
    health = jobs.health(records).first()
    assert (health.total_jobs, health.active_jobs) == (3, 1)
    timing = {r.job_id: r.duration_ms for r in jobs.timing(events).collect()}
    assert timing == {1: 86_400_000, 2: 0, 3: None}
    view = {r.job_id: r for r in jobs.status_view(records).collect()}
    assert view[2].result_available and view[1].result_available is None
    assert view[3].completed_at is None and view[1].filename == "a.pdf"


def test_state_log(spark):
    table = spark.createDataFrame([(1, "a/b/c.pdf", 5)], "doc_id INT, file_path STRING, file_size BIGINT")
    at = F.lit("2024-01-01 10:11:12").cast("timestamp_ntz")
    started = state.enter_stage(state.initial(table), at, "Ingesta")
    failed = state.log(started, at, error=F.lit("bad"))
    after = state.enter_stage(failed, at, "Limpieza").first()
    assert after.filename == "c.pdf" and after.status == "FAILED"
    assert after.messages == ["[10:11:12] Iniciando etapa: Ingesta"]
    assert after.errors == ["[10:11:12] bad"] and after.processing_stage == "Ingesta"
    merged = spark.range(1).select(
        state.merge_maps(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3, 'c', 4)")).alias("m")
    ).first().m
    assert merged == {"a": 1, "b": 3, "c": 4}


def test_settings_bounds():
    for wrong in ({"max_size_mb": 0}, {"max_size_mb": 101}, {"max_pages": 0}, {"temperature": 3.0}):
        with pytest.raises(ValueError):
            Settings(**wrong)
