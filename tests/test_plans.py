"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import QUERIES
from ledgerloom.catalog import inputs as inp
from ledgerloom.functions import replies as rp
from ledgerloom.functions import text as tx
from ledgerloom.operators import ledger, pages, replies
from ledgerloom.plans import documents as plan

# Queries whose work is user code or a folder listing.
PYTHON = {
    "extractor_plug", "extract_plug", "pdf_scan", "file_inventory", "pipeline_result", "exported_rows"
}
STREAMS = {
    "stream_intake", "stream_job_state", "stream_ledger", "stream_job_table", "stream_ledger_again"
}


def text_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_python_and_no_product(spark, small, name):
    text = text_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("Python" in text or "InPandas" in text) == (name in PYTHON)


def test_documents_to_requests_without_shuffle(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    paged = table.select("doc_id", pages.page_array(F.col("text"), "\n", 3).alias("pages"))
    assert "Exchange" not in text_of(plan.prepare(paged))


@pytest.mark.parametrize("name", ["page_assembly", "prompt_build", "request_rows", "parse_invoice"])
def test_registered_projections_do_not_shuffle(spark, small, name):
    assert "Exchange" not in text_of(QUERIES[name](spark, small))


def test_replies_to_ledger_with_one_shuffle(spark, small):
    table = spark.read.parquet(inp.replies_path(spark, small))
    plan_text = text_of(replies.accepted_invoices(table))
    assert plan_text.count("Exchange hashpartitioning(doc_id") == 1
    assert plan_text.count("Exchange") == 1 and "partial_min" in plan_text


def test_gate_and_parse_run_once(spark, small):
    table = spark.read.parquet(inp.replies_path(spark, small))
    text = text_of(ledger.item_rows(replies.accepted_invoices(table)))
    assert text.count("from_json(") == 3


def test_the_text_of_a_reply_is_sorted_and_shuffled_once(spark, small):
    table = spark.read.parquet(inp.replies_path(spark, small))
    for rows in (replies.accepted_invoices(table), replies.token_cost(table), replies.one_per_document(table)):
        text = text_of(rows)
        ranks = [line for line in text.split("\n") if "partial_min(struct(rejected" in line or "partial_min(rank" in line]
        assert len(ranks) == 1 and "body" not in ranks[0]


def test_page_filter_below_the_aggregate(spark, small):
    rows = spark.createDataFrame([(1, 1, "x")], "doc_id INT, page_no INT, text STRING")
    text = text_of(pages.assemble_rows(rows))
    assert text.index("Aggregate") < text.index("Filter")
    assert "partial_collect_set" in text


def test_page_of_the_ledger_is_a_top_k(spark, small):
    assert "TakeOrderedAndProject" in text_of(ledger.page(inp.plain_facturas(spark, small)))


def test_narrow_reads(spark, small):
    text = text_of(QUERIES["ledger_stats"](spark, small))
    schema = text[text.index("ReadSchema") :]
    assert "o_custkey" in schema and "o_totalprice" in schema and "o_orderdate" not in schema


def test_no_forced_broadcast(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in sorted(set(QUERIES) - STREAMS - PYTHON):
            assert "BroadcastExchange" not in text_of(QUERIES[name](spark, small)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_invoice_is_split_in_the_detail_join(spark):
    """One invoice holds a third of the items; the join reads it in several tasks."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        headers = spark.range(0, 4000, 1, 4).select("id", F.lit("PEN").alias("moneda"))
        items = spark.range(0, 90_000, 1, 8).selectExpr(
            "if(id % 3 = 0, 17L, id % 3900) as factura_id", "id as pos", "uuid() as descripcion"
        )
        detail = ledger.detail(headers, items)
        # 2,600 of the 4,000 headers have items.
        assert len(detail.collect()) == 90_000 + 1_400
        assert "skew=true" in detail._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in conf:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_gate_computes_its_text_once(spark, small):
    table = spark.read.parquet(inp.replies_path(spark, small))
    gated = table.select(rp.is_json_object(tx.unfence(F.col("content"))))
    assert text_of(gated).count("```json") <= 2 * text_of(table.select(tx.unfence(F.col("content")))).count("```json")


def test_replies_of_no_file_are_not_judged(spark, small):
    text = text_of(QUERIES["pipeline_result"](spark, small))
    assert "LeftSemi" in text and text.rindex("LeftSemi") > text.index("partial_min(")
