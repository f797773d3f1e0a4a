"""Landing folders, scans, listing, pluggable extractors."""

import hashlib

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators import texts
from ledgerloom.plans import flow
from ledgerloom.plans.intake import folder_verdicts
from ledgerloom.schemas import Settings
from ledgerloom.sources import extractors, files

MB = 1024 * 1024


def landing(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    contents = {
        "ok.pdf": b"%PDF-1.7\nx",
        "sub/upper.PDF": b"%PDF",
        "sub/wrong.pdf": b"hello",
        "empty.pdf": b"",
        "note.txt": b"%PDF",
        "limit.pdf": b"%PDF" + b"0" * (MB - 4),
        "over.pdf": b"%PDF" + b"0" * (MB - 3),
    }
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    return str(folder), contents


def test_folder_verdicts(spark, tmp_path):
    folder, _ = landing(tmp_path)
    verdicts = folder_verdicts(spark, folder, Settings(max_size_mb=1))
    got = {r.filename: (r.code, r.reason) for r in verdicts.collect()}
    assert got == {
        "ok.pdf": (None, None),
        "upper.PDF": (None, None),
        "limit.pdf": (None, None),
        "wrong.pdf": fv.NOT_PDF_CONTENT,
        "empty.pdf": fv.NOT_PDF_CONTENT,
        "over.pdf": (413, "Archivo demasiado grande: 1.0MB. Máximo permitido: 1MB"),
    }


def test_listing_sees_every_file(spark, tmp_path):
    folder, contents = landing(tmp_path)
    listed = {r.filename: r.size_bytes for r in files.list_files(spark, folder).collect()}
    assert listed == {name.split("/")[-1]: len(c) for name, c in contents.items()}


def test_writing_twice_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"f{i}.pdf", bytes([i])) for i in range(40)], "filename STRING, content BINARY"
    )
    folder = str(tmp_path / "out")
    assert files.write_files(rows, folder) == 40
    assert files.write_files(rows, folder) == 40
    back = files.scan_files(spark, folder).select("filename", "content").collect()
    assert {r.filename: bytes(r.content) for r in back} == {
        f"f{i}.pdf": bytes([i]) for i in range(40)
    }


def test_size_filter_reaches_the_scan(spark, tmp_path):
    folder, _ = landing(tmp_path)
    small = files.scan_files(spark, folder).where(F.col("length") <= 100)
    text = small._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in text
    names = files.scan_files(spark, folder).select("filename")
    assert "content" not in names._jdf.queryExecution().executedPlan().toString()


def test_extractor_errors_stay_in_their_row(spark):
    def pages(content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")

    rows = spark.createDataFrame(
        [("1", "PyMuPDF", b"a\fb"), ("2", None, b"c"), ("3", "other", b"d"), ("4", "PyMuPDF", b"\xff")],
        "doc_id STRING, method STRING, content BINARY",
    )
    found = {r.doc_id: r for r in extractors.extract_pages(rows, {"PyMuPDF": pages}).collect()}
    assert [(p.page_no, p.text) for p in found["1"].pages] == [(1, "a"), (2, "b")]
    assert found["2"].pages[0].text == "c" and found["2"].error is None
    assert found["3"].pages is None and found["3"].error == fv.UNKNOWN_METHOD + "other"
    assert found["4"].pages is None and found["4"].error.startswith("UnicodeDecodeError")
    assert extractors.plain_text_pages("á\f".encode()) == ["á", ""]


def test_results_depend_on_cleaning_and_prompt(spark):
    first = "%PDF a first page with enough letters"
    texts_ = {1: first, 2: first.replace(" ", " \t "), 3: first + " more", 4: "no file of that kind", 5: "%PDF"}
    rows = [
        (i, f"d{i}.pdf", f"in/d{i}.pdf", len(t), t.startswith("%PDF"), t.encode()) for i, t in texts_.items()
    ]
    landed = spark.createDataFrame(
        rows,
        "doc_id LONG, filename STRING, file_path STRING, size_bytes LONG, has_pdf_magic BOOLEAN, content BINARY",
    )
    replies = spark.createDataFrame(
        [(i, '{"total": 1}', 5) for i in texts_], "doc_id LONG, content STRING, total_tokens LONG"
    )
    found = flow.results(landed, {"PyMuPDF": extractors.plain_text_pages}, replies)
    assert fv.USER_PROMPT[:40] in found._jdf.queryExecution().executedPlan().toString()
    done = {r.doc_id: r for r in found.collect()}
    assert [done[i].status for i in (1, 2, 3, 4, 5)] == ["COMPLETED"] * 3 + ["FAILED"] * 2
    # Cleaning makes the first two the same; the third has a prompt of its own.
    assert done[1].request_digest == done[2].request_digest != done[3].request_digest
    prompt = f"--- PÁGINA 1 --- {first.upper()}".join(fv.USER_PROMPT.split(fv.PROMPT_PLACEHOLDER))
    rows = spark.createDataFrame([(1, fv.SYSTEM_PROMPT, prompt)], "doc_id LONG, system_prompt STRING, user_prompt STRING")
    sent = texts.requests(rows).first().request
    assert done[1].request_digest == hashlib.sha256(sent.encode()).hexdigest()
    assert done[4].request_digest is None and done[5].request_digest is None
