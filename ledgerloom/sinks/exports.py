"""One spreadsheet file per invoice, single or packed, written in two phases.

Tasks write their files into a hidden folder of the job.  When all tasks have ended, the
folder gets its final name in one step; if any has failed, it is removed.  So a reader sees
all files of an export or none.

    path/export-<job>/task-<number>/id-<id>/<name>    single files
    path/packed-<job>/part-<number>.parquet           packed: id, name and content in rows

A single file takes a folder and a block of its own, 8 KB of disk for 2 KB of content, and
an entry in the listing of the reader.  An export of a whole ledger is therefore packed, and
``unpack`` writes those of its files that are wanted one by one.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache
from urllib.parse import quote
from xml.sax.saxutils import escape

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ledgerloom import folders
from ledgerloom.functions import text as tx
from ledgerloom.operators import report

NAME = "invoice_files"
#: What the folder of an invoice begins with, so that any id is a name of its own.
_ID = "id-"
SCHEMA = "factura_id STRING, name STRING, content BINARY"

_MEMBERS = "section: string, row_no: int, label: string, value: string"

# Fixed parts of a workbook with one sheet, as the file format has them.
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="{target}" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}"/></Relationships>'
)
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORKBOOK = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    f'<workbook xmlns="{_MAIN}" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Factura" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_SHEET = "xl/worksheets/sheet1.xml"
_SHEET_HEAD = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><sheetData>'
_SHEET_TAIL = "</sheetData></worksheet>"
_OPEN, _CLOSE = '<t xml:space="preserve">', "</t>"
_BETWEEN = f"{_OPEN}%s{_CLOSE}"
_TEXT, _TEXT_END = f' t="inlineStr"><is>{_OPEN}', f"{_CLOSE}</is></c>"
#: Characters that XML has no place for, and those that are not written as they are.
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_SPECIAL = re.compile("[^\t\n\x20-%'-;=?-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
#: A row as it is written: label, value and number, of which a title has the first only.
_ROW = re.compile(
    f'<row r="[0-9]+"><c r="A[0-9]+"{_TEXT}([^<>]*){_TEXT_END}'
    f'(?:(?:<c r="B[0-9]+"{_TEXT}([^<>]*){_TEXT_END})?<c r="C[0-9]+"><v>(-?[0-9]+)</v></c>)?</row>'
)
#: What ``workbook`` writes in no text.
_FOREIGN = re.compile("[<>\r]|&(?!(?:amp|lt|gt|#13);)|" + _NOT_XML.pattern)
#: How many forms of a sheet are kept, and of how many lines at most.
_SHAPES, _SHAPE_LINES = 256, 200
#: Lengths in an archive: header of a part, its entry in the directory, end of the directory.
_LOCAL_BYTES, _ENTRY_BYTES, _END_BYTES = 30, 46, 22


def _archive(parts: dict[str, str], method: int, start: bytes = b"") -> bytes:
    """The parts as an archive, behind those of ``start``."""
    out = io.BytesIO(start)
    with zipfile.ZipFile(out, "a" if start else "w", method) as archive:
        for name, body in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, method)
    return out.getvalue()


@cache
def _fixed_parts(method: int) -> bytes:
    """What all workbooks begin with."""
    parts = {
        "[Content_Types].xml": _TYPES,
        "_rels/.rels": _RELATIONS.format(target="xl/workbook.xml", kind="officeDocument"),
        "xl/workbook.xml": _WORKBOOK,
        "xl/_rels/workbook.xml.rels": _RELATIONS.format(target="worksheets/sheet1.xml", kind="worksheet"),
    }
    return _archive(parts, method)


@cache
def _frame(method: int) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """What stands before, between and behind the checks, sizes and sheet of a workbook."""
    whole = _archive({_SHEET: ""}, method, _fixed_parts(method))
    with zipfile.ZipFile(io.BytesIO(whole)) as archive:
        sheet, directory = archive.getinfo(_SHEET), archive.start_dir
    local = sheet.header_offset
    entry = len(whole) - _END_BYTES - _ENTRY_BYTES - len(_SHEET)  # the last one of the directory
    return (
        whole[: local + 14],
        whole[local + 26 : local + _LOCAL_BYTES + len(_SHEET)],
        whole[directory : entry + 16],
        whole[entry + 28 : -6],
        whole[-2:],
    )


def _framed(data: bytes, check: int, size: int, method: int) -> bytes:
    """The archive that ``_archive`` makes of the fixed parts and a sheet, without its steps."""
    head, name, directory, behind, end = _frame(method)
    sums = struct.pack("<3L", check, len(data), size)
    place = struct.pack("<L", len(head) + len(sums) + len(name) + len(data))
    return b"".join((head, sums, name, data, directory, sums, behind, place, end))


def workbook(lines: list, method: int = zipfile.ZIP_DEFLATED) -> bytes:
    """A spreadsheet of report lines: a row with the title of each section, then label, value
    and number of each line.  Equal lines give equal bytes."""
    columns = [[line[name] for line in lines] for name in ("section", "row_no", "label", "value")]
    return _workbook(*columns, method)


def _workbook(sections: list, numbers: list, labels: list, values: list, method: int) -> bytes:
    given = None if None not in values else tuple(value is not None for value in values)
    texts = values if given is None else [value for value in values if value is not None]
    layout = _layout if len(numbers) <= _SHAPE_LINES else _layout.__wrapped__
    if _SPECIAL.search("".join(texts)):
        texts = map(_escaped, texts)
    sheet = layout(tuple(sections), tuple(numbers), tuple(labels), given) % tuple(texts)
    body = sheet.encode()
    return _framed(_packed_sheet(body, method), zlib.crc32(body), len(body), method)


@lru_cache(_SHAPES)
def _layout(sections: tuple, numbers: tuple, labels: tuple, given: tuple[bool, ...] | None) -> str:
    """The sheet of report lines with ``%s`` for the values that are given; None for all."""
    sheet, row, last = [_SHEET_HEAD], 0, None
    for i, (section, number, label) in enumerate(zip(sections, numbers, labels)):
        if section != last:
            last = section
            row += 1
            sheet.append(f'<row r="{row}">{_cell("A", row, section)}</row>')
        row += 1
        value = f'<c r="B{row}"{_TEXT}%s{_TEXT_END}' if given is None or given[i] else ""
        count = "" if number is None else f'<c r="C{row}"><v>{number}</v></c>'
        sheet.append(f'<row r="{row}">{_cell("A", row, label)}{value}{count}</row>')
    return "".join(sheet) + _SHEET_TAIL


def _cell(letter: str, row: int, text: str | None) -> str:
    """A cell of a layout."""
    return "" if text is None else f'<c r="{letter}{row}"{_TEXT}{_escaped(text).replace("%", "%%")}{_TEXT_END}'


def _escaped(text: str) -> str:
    return escape(_NOT_XML.sub("\ufffd", text)).replace("\r", "&#13;")


def _packed_sheet(body: bytes, method: int) -> bytes:
    if method == zipfile.ZIP_STORED:
        return body
    press = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -zlib.MAX_WBITS)
    return press.compress(body) + press.flush()


def sheet_lines(content: bytes) -> list[tuple[str, int, str, str | None]]:
    """The report lines of a workbook: section, number, label, value."""
    return [*zip(*_line_columns(content))]


def _line_columns(content: bytes) -> tuple[Sequence, Sequence, Sequence, Sequence]:
    """Sections, numbers, labels and values of the report lines of any workbook.

    One that is byte by byte as ``workbook`` makes it is read without a parser."""
    sheet = _own_sheet(content)
    if sheet is None:
        return _parsed_columns(content)
    first, *pieces = sheet.split(_OPEN)
    parts = [piece.partition(_CLOSE) for piece in pieces]
    texts, layout = [part[0] for part in parts], _BETWEEN.join([first, *[part[2] for part in parts]])
    found = (_shape if len(texts) <= 2 * _SHAPE_LINES else _shape.__wrapped__)(layout)
    whole = "\n".join(texts)
    special = _SPECIAL.search(whole)
    if found is None or layout % tuple(texts) != sheet or special and _FOREIGN.search(whole):
        return _parsed_columns(content)
    if special:
        texts = [*map(_read_text, texts)]
    texts.append(None)
    sections, numbers, labels, values = found
    take = texts.__getitem__
    return [*map(take, sections)], numbers, [*map(take, labels)], [*map(take, values)]


@lru_cache(_SHAPES)
def _shape(layout: str) -> tuple[list, list, list, list] | None:
    """Of the lines of a sheet with ``%s`` for its texts: the place of the section, the
    number, the places of label and value.  None for a sheet of another form."""
    if not (layout.startswith(_SHEET_HEAD) and layout.endswith(_SHEET_TAIL)):
        return None
    parts = _ROW.split(layout[len(_SHEET_HEAD) : -len(_SHEET_TAIL)])
    if any(parts[::4]) or {*parts[1::4], *parts[2::4]} - {"%s", None}:  # what lies between the rows
        return None
    sections, numbers, labels, values = [], [], [], []
    section, place = -1, 0
    for value, number in zip(parts[2::4], parts[3::4]):
        if number is None:
            section = place
        else:
            sections.append(section)
            numbers.append(int(number))
            labels.append(place)
            values.append(-1 if value is None else place + 1)
        place += 1 + (value is not None)
    return sections, numbers, labels, values


def _read_text(text: str) -> str:
    return text.replace("&#13;", "\r").replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def _own_sheet(content: bytes) -> str | None:
    """The sheet of an archive that is as ``workbook`` makes it, or none."""
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        head, name, *_ = _frame(method)
        if content.startswith(head) and len(content) > len(head) + 12:
            check, length, size = struct.unpack_from("<3L", content, len(head))
            start = len(head) + 12 + len(name)
            data = content[start : start + length]
            if _framed(data, check, size, method) != content:
                return None
            try:
                body = data if method == zipfile.ZIP_STORED else zlib.decompress(data, -zlib.MAX_WBITS)
                return body.decode() if len(body) == size and zlib.crc32(body) == check else None
            except (zlib.error, UnicodeDecodeError):
                return None
    return None


def _parsed_columns(content: bytes) -> tuple[list, list, list, list]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        sheet = ET.fromstring(archive.read(_SHEET))
    found, section = ([], [], [], []), None
    for row in sheet.iter(f"{{{_MAIN}}}row"):
        cells = {cell.get("r")[0]: "".join(cell.itertext()) for cell in row}
        if "C" in cells:
            for column, value in zip(found, (section, int(cells["C"]), cells["A"], cells.get("B"))):
                column.append(value)
        else:
            section = cells["A"]
    return found


def _opened(folder: str):
    from pyarrow import fs

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """What a task that ended has written: its folder and the number of its files."""

    folder: str
    files: int


class InvoiceFilesWriter(DataSourceWriter):
    """Writes the files of a job; the driver sees one message a task."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    @property
    def _hidden(self) -> str:
        return f"_export-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        store, root = _opened(self.path)
        folder = f"task-{context.partitionId():06d}-{context.taskAttemptId()}"
        base, count = f"{root}/{self._hidden}/{folder}", 0
        for row in iterator:
            place = f"{base}/{_ID}{quote(row['factura_id'], safe='')}"
            store.create_dir(place, recursive=True)
            with store.open_output_stream(f"{place}/{quote(row['name'], safe=' ')}") as sink:
                sink.write(row["content"])
            count += 1
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _opened(self.path)
        hidden = f"{root}/{self._hidden}"
        ended = {message.folder for message in messages if message is not None and message.files}
        if not ended:
            self.abort(messages)
            return
        for info in store.get_file_info(fs.FileSelector(hidden)):
            if info.base_name not in ended:  # of an attempt that did not count
                store.delete_dir(info.path)
        store.move(hidden, f"{root}/export-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        if store.get_file_info(f"{root}/{self._hidden}").type.name != "NotFound":
            store.delete_dir(f"{root}/{self._hidden}")


class InvoiceFiles(DataSource):
    """Sink of one file per row of ``factura_id, name, content``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> InvoiceFilesWriter:
        if overwrite:
            raise ValueError("an export is added to a folder, it replaces nothing")
        return InvoiceFilesWriter(self.options["path"])


def workbooks(invoices: DataFrame, generated_at: Column, method: int = zipfile.ZIP_DEFLATED) -> DataFrame:
    """``factura_id, name, content``: the report of each invoice as a spreadsheet.

    The name is the one that ``export_name`` gives for the time of the report.
    """

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _slices(batches):
            lists, content, start = batch.column("lines"), [], 0
            columns = [_values(column) for column in lists.flatten().flatten()]
            for count in _values(lists.value_lengths()):
                end = start + (count or 0)
                content.append(_workbook(*(column[start:end] for column in columns), method))
                start = end
            found = [batch.column("factura_id"), batch.column("name"), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(found, ["factura_id", "name", "content"])

    rows = report.listed(invoices, generated_at).select(
        F.col("factura_id").cast("string").alias("factura_id"),
        tx.export_name(generated_at).alias("name"),
        F.col("lines").cast(f"array<struct<{_MEMBERS}>>"),
    )
    return rows.mapInArrow(made, SCHEMA)


def export(invoices: DataFrame, path: str, generated_at: Column) -> None:
    """Write the report of each invoice to a file of its own, all of them or none.

    A file's folder is the id of the invoice, as many invoices have the same time.  Ids are
    unique and set.  Stores without a rename of folders copy the files at the end.
    """
    unpack(workbooks(invoices, generated_at), path)


def unpack(packed_files: DataFrame, path: str) -> None:
    """Write rows ``factura_id, name, content`` as single files, all of them or none."""
    packed_files.sparkSession.dataSource.register(InvoiceFiles)
    packed_files.select("factura_id", "name", "content").write.format(NAME).mode("append").save(path)


def pack(invoices: DataFrame, path: str, generated_at: Column) -> None:
    """Write the spreadsheets of all invoices as rows of few files, all of them or none.

    The parts of a workbook are stored as they are: much is the same in all workbooks, and
    the table compresses them together.
    """
    spark = invoices.sparkSession
    job = uuid.uuid4().hex
    hidden = f"{path}/_packed-{job}"
    try:
        whole = workbooks(invoices, generated_at, zipfile.ZIP_STORED)
        whole.write.option("compression", "zstd").parquet(hidden)
        folders.rename(spark, hidden, f"{path}/packed-{job}")
    except BaseException:
        folders.remove(spark, hidden)
        raise


def packed(spark: SparkSession, path: str) -> DataFrame:
    """``factura_id, name, content`` of all packed files."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/packed-*")


def files(spark: SparkSession, path: str) -> DataFrame:
    """``factura_id, name, content`` of all single files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/export-*")
    part = lambda number: F.element_at(F.split("path", "/"), number)
    return found.select(
        F.url_decode(F.substring(part(-2), len(_ID) + 1, 2**31 - 1)).alias("factura_id"),
        F.url_decode(part(-1)).alias("name"),
        "content",
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``factura_id, section, row_no, label, value``: the single files as report rows."""
    return lines(files(spark, path))


def lines(exported: DataFrame) -> DataFrame:
    """``factura_id, section, row_no, label, value`` of rows with ``factura_id, content``."""
    found = F.arrow_udf(_opened_lines, f"array<struct<{_MEMBERS}>>")("content")
    return exported.select("factura_id", F.inline(found))


def _opened_lines(contents):
    """The lines of each workbook of an Arrow array, as an array of lists."""
    import pyarrow as pa

    kinds = {"section": pa.string(), "row_no": pa.int32(), "label": pa.string(), "value": pa.string()}
    fields, found = [pa.field(name, kind) for name, kind in kinds.items()], []
    for some in _slices([contents]):
        columns, ends = ([], [], [], []), [0]
        for content in _values(some):
            for column, more in zip(columns, _line_columns(content)):
                column += more
            ends.append(len(columns[0]))
        arrays = [pa.array(column, field.type) for column, field in zip(columns, fields)]
        rows = pa.StructArray.from_arrays(arrays, fields=fields)
        found.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows))
    return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.struct(fields)))


def _slices(batches: Iterable, rows: int = 500) -> Iterator:
    """The same rows, few at a time, as each becomes many objects."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def _values(column) -> list:
    """The values of an Arrow array; plain ones do not go through a scalar each."""
    from pyarrow import types

    plain = column.null_count == 0 or not types.is_integer(column.type)  # else numpy makes floats
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()
