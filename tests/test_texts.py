"""Trimming, cleaning, page assembly, prompts."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text as tx
from ledgerloom.operators import pages, texts
from ledgerloom.plans import documents as plan

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　"
pieces = st.sampled_from(list(SPACES) + ["a", "ß", "É", "ﬁ", "0", "​", "٣", "_", "漢", "﻿"])
sentences = st.lists(pieces, max_size=25).map("".join)


def python_clean(text):
    cleaned = re.sub(r"\s+", " ", text.upper())
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", cleaned).strip()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(sentences, min_size=150, max_size=250))
def test_text_rules(spark, samples):
    table = spark.createDataFrame(list(enumerate(samples)), "i INT, text STRING")
    column = F.col("text")
    rows = table.select(
        "i",
        tx.strip(column).alias("stripped"),
        tx.normalize(column).alias("cleaned"),
        tx.normalize(tx.normalize(column)).alias("twice"),
        tx.collapse_blank_lines(tx.normalize(column)).alias("collapsed"),
        tx.alphanumerics(column).alias("alnum"),
    ).collect()
    for row in rows:
        text = samples[row.i]
        assert row.stripped == text.strip(), repr(text)
        assert row.cleaned == python_clean(text), repr(text)
        assert row.twice == row.cleaned == row.collapsed
        assert row.alnum == sum(c.isalnum() for c in text), repr(text)


def test_clean_columns(spark):
    table = spark.createDataFrame(
        [(0, None), (1, ""), (2, "  a  b "), (3, "ßß"), (4, "   "), (5, "x" * 31 + " ")],
        "i INT, raw_text STRING",
    )
    rows = texts.clean(table).orderBy("i").collect()
    assert [r.cleaned_text for r in rows] == [None, None, "A B", "SSSS", "", "X" * 31]
    assert [r.warning for r in rows] == [fv.NOTHING_TO_CLEAN] * 2 + [None] * 4
    assert [r.characters_removed for r in rows[2:]] == [4, -2, 3, 1]
    assert [r.removal_percentage for r in rows[2:]] == [57.14, -100.0, 100.0, 3.12]
    message = texts.cleaning_message(texts.clean(table)).where("i = 2").first().message
    assert message == "Texto limpiado: -4 caracteres (57.1%)"


def python_assembly(page_texts):
    raw, kept = "", 0
    for number, text in enumerate(page_texts[:3], 1):
        text = text.strip()
        if len(text) > 20:
            kept += 1
            raw += f"\n--- PÁGINA {number} ---\n{text}\n"
    return raw, kept, len(raw.strip())


def test_assembly(spark):
    rng = random.Random(5)
    lengths = [0, 1, 19, 20, 21, 22, 60]
    documents = [
        ["a" * 20, "b" * 21, "c" * 30, "d" * 40],
        ["x"],
        ["long page number one is here", "short", "long page number three is here"],
        ["\xa0" + "e" * 20 + "\x1c", "　" + "f" * 21],
    ] + [["p" * rng.choice(lengths) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    table = spark.createDataFrame(
        [(i, "\n".join(d)) for i, d in enumerate(documents)], "doc_id INT, text STRING"
    )
    for limit in (None, 3):
        paged = table.select("doc_id", pages.page_array(F.col("text"), "\n", limit).alias("pages"))
        for row in pages.assemble(paged).collect():
            wanted = python_assembly(documents[row.doc_id])
            assert (row.raw_text, row.pages_with_text, row.total_characters) == wanted
    shuffled = pages.page_rows(table).orderBy(F.rand(1)).repartition(7)
    grouped = {r.doc_id: (r.raw_text, r.pages_with_text, r.total_characters)
               for r in pages.assemble_rows(shuffled).collect()}
    wanted = {i: python_assembly(d) for i, d in enumerate(documents)}
    assert grouped == {i: w for i, w in wanted.items() if w[1]}


def test_gate_needs_more_than_ten(spark):
    table = spark.createDataFrame(
        [(0, "0123456789"), (1, "0123456789a"), (2, "- é漢٣aaaaaaaa\nzzz"), (3, "")],
        "doc_id INT, text STRING",
    )
    rows = pages.text_gate(table).orderBy("doc_id").collect()
    assert [r.has_extractable_text for r in rows] == [False, True, True, False]
    assert [r.meaningful_chars for r in rows] == [10, 11, 11, 0]


def test_method_choice(spark):
    good, bad = "enough letters here", "--"
    table = spark.createDataFrame(
        [
            (0, "PyMuPDF", 1, good), (0, "pdfplumber", 2, good), (0, "PyPDF2", 3, good),
            (1, "PyMuPDF", 1, bad), (1, "pdfplumber", 2, None), (1, "PyPDF2", 3, good),
            (2, "PyMuPDF", 1, bad), (2, "pdfplumber", 2, None), (2, "PyPDF2", 3, bad),
        ],
        "doc_id INT, method STRING, priority INT, text STRING",
    )
    chosen = pages.choose_method(table)
    assert {r.doc_id: r.extraction_method for r in chosen.collect()} == {
        0: "PyMuPDF", 1: "PyPDF2", 2: "none"
    }
    taken = pages.chosen_text(chosen.withColumn(
        "extraction_method", F.nullif("extraction_method", F.lit("none"))), table)
    assert {r.doc_id: (r.method, r.text) for r in taken.collect()} == {
        0: ("PyMuPDF", good), 1: ("PyPDF2", good), 2: ("PyMuPDF", bad)
    }


def test_prompts_take_text_literally(spark):
    tricky = r"$1 \1 {cleaned_text} ${x} 100%"
    table = spark.createDataFrame([(0, tricky), (1, ""), (2, None)], "doc_id INT, cleaned_text STRING")
    rows = texts.prompts(table).orderBy("doc_id").collect()
    head, tail = fv.USER_PROMPT.split(fv.PROMPT_PLACEHOLDER)
    assert rows[0].user_prompt == head + tricky + tail
    assert [r.error for r in rows] == [None, fv.NO_PROMPT_TEXT, fv.NO_PROMPT_TEXT]
    assert rows[1].user_prompt is None
    assert texts.requests(texts.prompts(table)).count() == 1


def test_first_error_stays(spark):
    table = spark.createDataFrame([(0, "tiny"), (1, "a page with enough letters")], "doc_id INT, text STRING")
    paged = table.select("doc_id", pages.page_array(F.col("text")).alias("pages"))
    rows = plan.prepare(paged).orderBy("doc_id").collect()
    assert [r.error for r in rows] == [fv.NO_ASSEMBLED_TEXT, None]
    assert [r.status for r in rows] == ["FAILED", "PROCESSING"]


def test_failed_documents_stay_failed(spark):
    rows = [
        (1, "FAILED", fv.EMPTY_FILE, fv.STAGES[0], "long enough to be a page of text"),
        (2, "PROCESSING", None, fv.STAGES[0], ""),
        (3, "PROCESSING", None, fv.STAGES[0], "long enough to be a page of text"),
    ]
    table = spark.createDataFrame(
        rows, "doc_id LONG, status STRING, error STRING, processing_stage STRING, text STRING"
    )
    paged = table.withColumn("pages", pages.page_array(F.col("text")))
    prepared = {r.doc_id: r for r in plan.prepare(paged).collect()}
    assert (prepared[1].status, prepared[1].error) == ("FAILED", fv.EMPTY_FILE)
    assert prepared[1].user_prompt is None and prepared[3].user_prompt
    assert (prepared[2].status, prepared[2].error) == ("FAILED", fv.NO_ASSEMBLED_TEXT)
    replies = spark.createDataFrame(
        [(i, '{"total": 1}', 5) for i in (1, 2, 3)], "doc_id LONG, content STRING, total_tokens LONG"
    )
    done = {r.doc_id: r for r in plan.finish(plan.prepare(paged), replies).collect()}
    assert [done[i].status for i in (1, 2, 3)] == ["FAILED", "FAILED", "COMPLETED"]
    assert [done[i].processing_stage for i in (1, 2, 3)] == [
        fv.STAGES[0], fv.STAGES[1], fv.STAGES[3],
    ]


def test_gate_looks_at_the_first_page(spark):
    texts_ = ["--\nsome text on the second page", "some text on the first page\n--", None, ""]
    table = spark.createDataFrame(list(enumerate(texts_)), "i INT, text STRING")
    got = table.select(pages.has_text(F.col("text"))).collect()
    assert [r[0] for r in got] == [False, True, False, False]


def test_chunks_overlap_and_cover_all_words(spark):
    table = spark.createDataFrame(
        [(1, " ".join(map(str, range(25)))), (2, " "), (3, None), (4, "a")], "doc_id INT, text STRING"
    )
    rows = texts.chunks(table, "text", size=10, overlap=3).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk.split()[0], r.chunk.split()[-1]) for r in rows] == [
        (1, "0", "9"), (1, "7", "16"), (1, "14", "23"), (1, "21", "24"), (4, "a", "a"),
    ]


def test_no_prompt_no_result(spark):
    prepared = spark.createDataFrame(
        [(1, "PROCESSING", fv.NO_PROMPT_TEXT, fv.STAGES[1]), (2, "PROCESSING", None, fv.STAGES[1])],
        "doc_id LONG, status STRING, error STRING, processing_stage STRING",
    )
    replies = spark.createDataFrame(
        [(1, '{"total": 1}', 5), (2, '{"total": 1}', 5)], "doc_id LONG, content STRING, total_tokens LONG"
    )
    done = {r.doc_id: r for r in plan.finish(prepared, replies).collect()}
    assert (done[1].status, done[1].processing_stage) == ("FAILED", fv.STAGES[3])
    assert done[1].error == fv.REPLY_STEP_ERROR + fv.NO_PROMPT_TEXT
    assert (done[1].field_count, done[1].tokens_used, done[1].extracted_data) == (0, 0, None)
    assert (done[2].status, done[2].error, done[2].tokens_used) == ("COMPLETED", None, 5)
