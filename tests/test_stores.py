"""Ordered ledger with its directory, stored sketches, and one export per invoice."""

import datetime
import io
import random
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from ledgerloom import folders
from ledgerloom.catalog import QUERIES
from ledgerloom.catalog import inputs as inp
from ledgerloom.operators import ledger, sketches
from ledgerloom.plans import invoices
from ledgerloom.sinks import exports, ordered


def at():
    return F.lit(datetime.datetime(2024, 6, 30, 14, 5, 9)).cast("timestamp_ntz")


# ------------------------------------------------------------------- ordered ledger
def headers(spark, first, last, day=0, undated=0):
    at = F.timestamp_add("minute", (F.col("id") * 7919 % 1009).cast("int"), F.lit(datetime.datetime(2024, 1, 1 + day)))
    rows = spark.range(first, last)
    return rows.select("id", F.when(F.col("id") % 50 >= undated, at).alias("fecha_registro"))


def keys(frame):
    return [(r.id, r.fecha_registro) for r in frame.collect()]


def expected(frame, limit, offset):
    rows = sorted(
        keys(frame), key=lambda r: (r[1] is None, -(r[1] or datetime.datetime(1970, 1, 1)).timestamp(), r[0])
    )
    return rows[offset : offset + limit]


def files_of(frame):
    return {name.rsplit("/", 1)[1] for name in frame.inputFiles()}


def test_any_page_opens_two_files_at_most(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), headers(spark, 0, 4000, undated=3)
    ordered.write(rows, path, rows_per_file=400)
    for offset in (0, 399, 1234, 3590, 3990, 4000):
        page = ordered.page(spark, path, 50, offset)
        assert keys(page) == expected(rows, 50, offset)
        assert len(files_of(page)) <= 2
    known = ordered.directory(spark, path)
    assert known.agg(F.sum("rows"), F.max(F.col("before") + F.col("rows"))).first()[:] == (4000, 4000)
    assert known.count() == 10


def test_files_take_no_task_each(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "ledger"), headers(spark, 0, 4000, undated=3)
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 1500)
    ordered.write(rows, path, rows_per_file=40)
    known = [r.file for r in ordered.directory(spark, path).collect()]
    assert len(known) >= 100
    assert len({name.rsplit("/", 1)[1].split("-")[1] for name in known}) <= 3
    assert ordered.directory(spark, path).agg(F.max("rows")).first()[0] == 40
    for offset in (0, 39, 1330, 1499, 2700, 3990):
        page = ordered.page(spark, path, 40, offset)
        assert keys(page) == expected(rows, 40, offset)
        assert len(files_of(page)) <= 3


def test_newer_rows_go_in_front_and_others_are_sorted_in(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), headers(spark, 0, 900)
    ordered.append(rows, path, rows_per_file=300)
    newer = headers(spark, 900, 1400, day=5)
    ordered.append(newer, path, rows_per_file=300)
    both = rows.union(newer)
    assert len([n for n in folders.names(spark, path) if n.startswith("rows-")]) == 2
    for offset in (0, 480, 1300):
        assert keys(ordered.page(spark, path, 50, offset)) == expected(both, 50, offset)
    between = headers(spark, 2000, 2100, day=3)
    ordered.append(between, path, rows_per_file=300)
    every = both.union(between)
    ordered.clean(spark, path)
    assert len([n for n in folders.names(spark, path) if n.startswith("rows-")]) == 1
    for offset in (450, 560, 1470):
        assert keys(ordered.page(spark, path, 50, offset)) == expected(every, 50, offset)
    ordered.append(rows.limit(0), path)
    assert keys(ordered.page(spark, path, 10, 0)) == expected(every, 10, 0)


def test_an_unfinished_directory_does_not_count(spark, tmp_path):
    path, rows = str(tmp_path / "ledger"), headers(spark, 0, 100)
    ordered.write(rows, path)
    ordered.write(headers(spark, 0, 50), path)
    folders.remove(spark, f"{path}/directory-000002/_SUCCESS")
    assert keys(ordered.page(spark, path, 200, 0)) == expected(rows, 200, 0)
    with pytest.raises(ValueError):
        ordered.page(spark, str(tmp_path / "none"))


# ------------------------------------------------------------------------- sketches
def ledger_rows(spark, count):
    rng = random.Random(4)
    rows = [
        (
            i,
            None if i % 40 == 0 else f"c{rng.randrange(count // 2)}",
            rng.choice(["PEN", "USD", None]),
            None if i % 30 == 0 else rng.randrange(10**7) / 100,
            datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(24 * 60)),
        )
        for i in range(count)
    ]
    kind = "id BIGINT, codigo_cliente STRING, moneda STRING, total DOUBLE, fecha_registro TIMESTAMP_NTZ"
    return spark.createDataFrame(rows, kind).withColumn("total", F.col("total").cast("decimal(18,2)"))


def test_merged_sketches_are_within_their_bounds(spark, tmp_path):
    rows, path = ledger_rows(spark, 20_000), str(tmp_path / "stats")
    for until in (datetime.date(2024, 1, 20), datetime.date(2024, 2, 10), datetime.date(2024, 12, 31)):
        sketches.update(rows, path, until)
    found = sketches.merged(sketches.read(spark, path)).first()
    exact = ledger.statistics(rows).first()
    assert found["total_facturas"] == exact["total_facturas"] and found["monto_total"] == exact["monto_total"]
    assert float(found["promedio_factura"]) == pytest.approx(float(exact["promedio_factura"]), abs=0.01)
    assert abs(found["total_clientes"] - exact["total_clientes"]) <= 0.03 * exact["total_clientes"]
    totals = sorted(float(r.total) for r in rows.select("total").collect() if r.total is not None)
    for name, share in (("median", 0.5), ("p95", 0.95)):
        rank = sum(t <= found[name] for t in totals) / len(totals)
        assert abs(rank - share) <= 0.02
    by_day = sketches.merged(sketches.read(spark, path).where("day < date'2024-01-08'"), "moneda").collect()
    week = rows.where("fecha_registro < timestamp_ntz'2024-01-08 00:00:00'")
    assert {r.moneda: r.total_facturas for r in by_day} == {
        r.moneda: r["count"] for r in week.groupBy("moneda").count().collect()
    }


def test_an_update_scans_new_days_only(spark, tmp_path):
    source, path = str(tmp_path / "rows"), str(tmp_path / "stats")
    ledger_rows(spark, 2000).repartitionByRange(6, "fecha_registro").write.parquet(source)
    rows = spark.read.parquet(source)
    sketches.update(rows, path, datetime.date(2024, 2, 1))
    assert sketches.stored_until(spark, path) == datetime.date(2024, 2, 1)
    new = sketches.fresh(rows, datetime.date(2024, 2, 1), datetime.date(2024, 3, 31))
    plan = sketches.daily(new)._jdf.queryExecution().executedPlan().toString()
    assert ">= 2024-02-02 00:00:00)" in plan and "GreaterThanOrEqual(fecha_r" in plan, plan
    sketches.update(rows, path, datetime.date(2024, 3, 31))
    sketches.update(rows, path, datetime.date(2024, 3, 31))
    assert sketches.merged(sketches.read(spark, path)).first()["total_facturas"] == 2000
    days = sketches.read(spark, path).groupBy("day", "moneda").count().where("count > 1")
    assert days.count() == 0
    (tmp_path / "stats" / "until-2024-03-31" / "_SUCCESS").unlink()
    assert sketches.stored_until(spark, path) == datetime.date(2024, 2, 1)
    sketches.update(rows, path, datetime.date(2024, 3, 31))
    assert sketches.merged(sketches.read(spark, path)).first()["total_facturas"] == 2000


# -------------------------------------------------------------------------- exports
def test_workbooks_hold_their_lines_and_are_the_same_again():
    lines = [
        {"section": "A & B", "row_no": 1, "label": "x <y>", "value": " two\nlines \"q\" "},
        {"section": "A & B", "row_no": 2, "label": "none", "value": None},
        {"section": "Ñ", "row_no": 0, "label": "e", "value": ""},
        {"section": "A & B", "row_no": 3, "label": "bad", "value": "a\x01b\r\U0001f600"},
    ]
    content = exports.workbook(lines)
    want = [(x["section"], x["row_no"], x["label"], x["value"]) for x in lines]
    want[3] = ("A & B", 3, "bad", "a�b\r\U0001f600")
    assert exports.sheet_lines(content) == want and exports.workbook(lines) == content
    assert exports.sheet_lines(exports.workbook([])) == []


def test_ids_that_are_no_file_names(spark, tmp_path):
    path = str(tmp_path / "out")
    replies = inp.replies(spark, "/root/testdata/sf0.001").select("doc_id", "content", "total_tokens")
    some = invoices.checked(replies).limit(6).withColumn("filename", F.lit("f.pdf"))
    ids = ["a/b", "..", "ñ +%", "q?x=1#2", "plain", ""]
    named = some.withColumn("n", F.row_number().over(exports_order())).withColumn(
        "id", F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("n"))
    )
    exports.export(named, path, at())
    found = {(r.factura_id, r.name) for r in exports.files(spark, path).collect()}
    assert found == {(i, "factura_20240630_140509.xlsx") for i in ids}


def exports_order():
    from pyspark.sql import Window

    return Window.orderBy("id")


def everything(folder):
    return [p for p in folder.rglob("*") if p.is_file()] if folder.exists() else []


def test_an_export_that_fails_leaves_no_file(spark, tmp_path):
    path = tmp_path / "out"
    replies = inp.replies(spark, "/root/testdata/sf0.001").select("doc_id", "content", "total_tokens")
    rows = invoices.checked(replies).withColumn("filename", F.lit("f.pdf")).repartition(4)

    @F.udf("string")
    def broken(key):
        if key % 3 == 0:
            raise ValueError("broken")
        return str(key)

    with pytest.raises(Exception, match="broken"):
        exports.export(rows.withColumn("id", broken("id")), str(path), at())
    assert everything(path) == []
    exports.export(rows, str(path), at())
    assert len(everything(path)) == rows.count()
    assert all(p.name == "factura_20240630_140509.xlsx" for p in everything(path))
    exports.export(rows.limit(0), str(path), at())
    assert len(everything(path)) == rows.count()


def test_a_packed_export_takes_few_files_and_little_disk(spark, tmp_path):
    path, single = tmp_path / "packed", tmp_path / "single"
    replies = inp.replies(spark, "/root/testdata/sf0.001").select("doc_id", "content", "total_tokens")
    rows = invoices.checked(replies).withColumn("filename", F.lit("f.pdf")).coalesce(2)
    exports.pack(rows, str(path), at())
    assert len([p for p in everything(path) if p.name.endswith(".parquet")]) <= 2
    assert sum(p.stat().st_size for p in everything(path)) < 600 * rows.count()
    packed = exports.packed(spark, str(path))
    exports.unpack(packed.where("factura_id like '%1'"), str(single))
    wanted = [r.factura_id for r in packed.collect() if r.factura_id.endswith("1")]
    assert len(everything(single)) == len(wanted) > 0
    exports.export(rows, str(tmp_path / "all"), at())
    written = exports.read_lines(spark, str(tmp_path / "all"))
    assert exports.lines(packed).exceptAll(written).count() == written.exceptAll(exports.lines(packed)).count() == 0
    assert written.where(F.col("factura_id").isin(wanted)).exceptAll(exports.read_lines(spark, str(single))).count() == 0


def test_a_packed_export_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.range(4).select(F.expr("if(id = 3, raise_error('broken'), id)").alias("id"))
    named = invoices.checked(inp.replies(spark, "/root/testdata/sf0.001")).drop("id").limit(1).crossJoin(rows)
    with pytest.raises(Exception, match="broken"):
        exports.pack(named.withColumn("filename", F.lit("f.pdf")), str(tmp_path / "out"), at())
    assert everything(tmp_path / "out") == []


@pytest.mark.parametrize("name", ["exported_rows", "exported_files"])
def test_registered_exports_are_packed(spark, small, name):
    read = QUERIES[name](spark, small).inputFiles()
    assert len(read) < 20 and all("/packed-" in file for file in read)


def test_workbooks_are_as_the_zip_module_writes_them():
    def whole(lines, method):
        rows, section = [], None
        for line in lines:
            if line["section"] != section:
                section = line["section"]
                rows.append([section])
            rows.append([line["label"], line["value"], line["row_no"]])
        sheet = exports._SHEET_HEAD
        for n, cells in enumerate(rows, 1):
            sheet += f'<row r="{n}">'
            for letter, value in zip("ABC", cells):
                if isinstance(value, int):
                    sheet += f'<c r="{letter}{n}"><v>{value}</v></c>'
                elif value is not None:
                    text = escape(exports._NOT_XML.sub("�", value)).replace("\r", "&#13;")
                    sheet += f'<c r="{letter}{n}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
            sheet += "</row>"
        return exports._archive({exports._SHEET: sheet + exports._SHEET_TAIL}, method, exports._fixed_parts(method))

    rng = random.Random(2)
    texts = ["", "PEN 1.00", "100%", "%s %d %%", "a & b", "<t>", "&lt;", "\r\n", "\x00￾", "]]>", "ñ\U0001f600", None]
    for count in (0, 1, 5, 40, 600):
        for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            lines = [
                {
                    "section": rng.choice(["A", "B & C", "%s"]),
                    "row_no": rng.randrange(-3, 10**6),
                    "label": rng.choice(texts[:-1]),
                    "value": rng.choice(texts),
                }
                for _ in range(count)
            ]
            content = exports.workbook(lines, method)
            assert content == whole(lines, method)
            found, parsed = exports._line_columns(content), exports._parsed_columns(content)
            assert [list(column) for column in found] == [*parsed]
            assert len(found[0]) == count


def test_own_workbooks_are_read_without_a_parser(monkeypatch):
    lines = [{"section": "S & T", "row_no": n, "label": "<l>", "value": "100 %s"} for n in range(9)]
    content = exports.workbook(lines, zipfile.ZIP_STORED)
    want = [("S & T", n, "<l>", "100 %s") for n in range(9)]
    monkeypatch.setattr(exports.ET, "fromstring", None)
    assert exports.sheet_lines(content) == want


def test_workbooks_of_others_are_parsed():
    lines = [{"section": "S", "row_no": 1, "label": "l", "value": "v"}]
    own = exports.workbook(lines, zipfile.ZIP_STORED)
    with zipfile.ZipFile(io.BytesIO(own)) as archive:
        sheet = archive.read(exports._SHEET).decode()
    start = exports._fixed_parts(zipfile.ZIP_STORED)
    for old, new, want in (
        (">v</t>", ">&quot;v&#x41;</t>", '"vA'),
        (">v</t>", ">a\r\nb</t>", "a\nb"),
        (">v</t>", "><![CDATA[<v>]]></t>", "<v>"),
        (">v</t>", ">a>b</t>", "a>b"),
        ("<row ", '<!-- <row r="9"/> --><row ', "v"),
        ('<row r="2">', '<row r="2" spans="1:3">', "v"),
        (">v</t></is></c>", ">v</t></is></c ><c r='D2'/>", "v"),
    ):
        other = exports._archive({exports._SHEET: sheet.replace(old, new)}, zipfile.ZIP_STORED, start)
        assert exports.sheet_lines(other) == [("S", 1, "l", want)], new
    with pytest.raises(zipfile.BadZipFile):
        exports.sheet_lines(own.replace(b">v</t>", b">w</t>"))
    bad = exports._archive({exports._SHEET: sheet.replace(">v</t>", ">&nope;</t>")}, zipfile.ZIP_STORED, start)
    with pytest.raises(exports.ET.ParseError):
        exports.sheet_lines(bad)
