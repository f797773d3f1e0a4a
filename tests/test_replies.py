"""Fences, the strict gate, and parsing."""

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import replies as rp
from ledgerloom.functions import text as tx
from ledgerloom.operators import checks, replies

JSON_CASES = [
    '{"a":1}', '{"a":1} tail', '{"a":1}],[{"b":2}', '{"a":1}]x', '{"a":1}}x',
    '{"a":1},{"b":2}', '{"a":1},"b":2', '{"a":1},"b":2}', '{"a":1}],"b":[{}', "[1]", "5",
    '"s"', "{}", "[]", "null", "true", "", '{"a":NaN}', '{"a":Infinity}', '{"a":-Infinity}',
    '{"a":1,"a":2}', "{'a':1}", '{"a":1', '{"a":01}', '{"a":.5}', '{"a":"x\ny"}', '{"a":1,}',
    "{a:1}", '{"a":"\\ud800"}', '{"a":1}/*c*/', '{"a":1} {"b":2}', '{"a":[1,2}', '{"a":TRUE}',
    '{"a":1e5}', '{"a":"\\x"}', '{"a":"1,500.00"}', '{"a":{"b":[{"c":null}]}}', '{"a" : 1 }',
    '{"a":"}]"}', '{"":1}', '{"a":-}', '{"a":1.}', '{"a":+1}', '{"a":"\\u00e9"}', "{", "}",
    '{"a":+INF}', '{"a":-INF}', '{"a":+Infinity}', '{"a":INF}', '{"a":"x, +INF"}',
    '{"a":"\\"+INF"}', '{"a":"\\\\",b":+INF}', '{"a":"\\\\","b":-INF}', '{"+Infinity":NaN}',
    '{}{}', '{},', '{}}', '{}]', '{"malformed":"x"}', '{"none":1}', '{"v":1}', None,
]


def python_accepts(text):
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, TypeError):
        return False


def test_gate_equals_json_loads(spark):
    rng = random.Random(7)
    seeds = ['{"a":[1,{"b":"x"}],"c":{"d":null}}', '{"k":"v","n":-1.5e3,"t":true}']
    mutated = []
    for _ in range(1500):
        text = list(rng.choice(seeds))
        for _ in range(rng.randint(1, 3)):
            place = rng.randrange(len(text))
            text[place : place + rng.randint(0, 1)] = rng.choice('{}[],:"1ax \\')
        mutated.append("".join(text).strip())
    cases = JSON_CASES + mutated
    table = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, j STRING")
    verdicts = table.select(
        "i",
        rp.is_json_object(F.col("j")).alias("plain"),
        tx.bind(F.col("j"), rp.is_json_object).alias("bound"),
    )
    wrong = [
        (cases[r.i], r.plain)
        for r in verdicts.collect()
        if r.plain != python_accepts(cases[r.i]) or r.bound != r.plain
    ]
    assert wrong == []


def python_unfence(content):
    content = content.strip()
    if content.startswith("```json"):
        content = content[7:]
    if content.endswith("```"):
        content = content[:-3]
    return content.strip()


def test_unfence(spark):
    rng = random.Random(3)
    cases = [
        "", " ", "```json", "```", "```json```", "```json\n{}\n```", "```\n{}\n```", "``````",
        "```JSON\n{}```", "{}```", "{}``` ```", "```json```json{}", " ```json {} \x1c```\x85",
        "``` json {}", "a```b", "\n\n```json\r\n{\"a\": \"```\"}\r\n```\n",
    ]
    cases += ["".join(rng.choices(["```", "json", "{", "}", " ", "\n", "\x1f", "é"], k=6))
              for _ in range(400)]
    table = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, content STRING")
    for row in replies.unfence(table).collect():
        assert row.body == python_unfence(cases[row.i]), repr(cases[row.i])


def sample_invoice() -> str:
    """The example inside the prompt text."""
    start = fv.USER_PROMPT.index("FORMATO DE EJEMPLO:") + len("FORMATO DE EJEMPLO:")
    return fv.USER_PROMPT[start : fv.USER_PROMPT.index("TEXTO DE LA FACTURA:")].strip()


def parsed(spark, *contents):
    table = spark.createDataFrame(
        [(i, c, 100) for i, c in enumerate(contents)],
        "doc_id INT, content STRING, total_tokens BIGINT",
    )
    return replies.parse(table).orderBy("doc_id")


def test_sample_invoice(spark):
    row = parsed(spark, sample_invoice()).first()
    assert row.accepted and row.status == "COMPLETED" and row.error is None
    assert row.codigo_cliente == "20123456789"
    assert row.distrito == "SAN ISIDRO" and row.forma_pago == "CREDITO" and row.moneda == "PEN"
    assert (row.subtotal, row.igv, row.total) == tuple(map(Decimal, ("1500", "270", "1770")))
    assert row["items"][0].descripcion == "SERVICIO DE CONSULTORIA"
    assert row["items"][0].cantidad == 1 and row["items"][0].subtotal == 1500
    assert row.detraccion.porcentaje == 12 and row.detraccion.monto == 177
    broken = checks.violations(replies.accepted_invoices(_table(spark, sample_invoice())))
    # The example withholds 177.00, while 12 % of 1770.00 is 212.40.
    assert broken.first().violations == ["deduction"]


def _table(spark, *contents):
    return spark.createDataFrame(
        [(i, c, 100) for i, c in enumerate(contents)],
        "doc_id INT, content STRING, total_tokens BIGINT",
    )


def test_shapes(spark):
    rows = parsed(
        spark,
        None,
        "",
        "{}",
        "[]",
        '{"items": {"descripcion": "x"}, "moneda": "PEN"}',
        '{"total": 1.005, "items": []}',
        '{"total": 1e30, "moneda": "USD"}',
        '{"moneda": null, "items": null}',
        '{"moneda": "A", "moneda": "B"}',
    ).collect()
    assert [r.accepted for r in rows] == [False, False, True, False, True, True, True, True, True]
    assert rows[0].error == fv.REPLY_STEP_ERROR + fv.BAD_REPLY
    assert rows[2].moneda is None and rows[2]["items"] is None
    assert rows[4]["items"] is None and rows[4].moneda == "PEN"
    assert rows[5].total == Decimal("1.01") and rows[5]["items"] == []
    assert rows[6].total is None and rows[6].moneda == "USD"
    assert rows[8].moneda == "B"


def test_field_count_and_cost(spark):
    table = _table(spark, '{"a":1,"b":NaN,"a":2}', "x", "{}")
    counts = [r.field_count for r in replies.field_count(table).orderBy("doc_id").collect()]
    assert counts == [2, None, 0]
    costs = {r.doc_id: (r.tokens_used, round(r.cost_estimate, 9))
             for r in replies.token_cost(table.union(table)).collect()}
    assert costs == {0: (100, 0.000015), 2: (100, 0.000015)}


def test_one_reply_counts_everywhere(spark):
    rows = [
        (1, "no", 5),
        (1, '{"moneda":"USD","total":99,"extra":1}', 200),
        (1, '{"moneda":"PEN","total":10}', 100),
        (2, "bad", 7),
    ]
    table = spark.createDataFrame(rows, "doc_id LONG, content STRING, total_tokens LONG")
    (invoice,) = replies.accepted_invoices(table).collect()
    assert (invoice.id, invoice.moneda, invoice.total_tokens) == (1, "PEN", 100)
    assert invoice.body == '{"moneda":"PEN","total":10}'
    assert [tuple(r)[:2] for r in replies.token_cost(table).collect()] == [(1, 100)]
    chosen = {r.doc_id: r for r in replies.one_per_document(table).collect()}
    assert chosen[1].tokens == 100 and chosen[1].extracted_data.moneda == "PEN"
    assert not chosen[2].accepted and chosen[2].tokens is None


def test_parse_of_payload_is_identity(spark, small):
    from ledgerloom.catalog import inputs as inp
    from ledgerloom.operators import ledger

    first = replies.accepted_invoices(inp.replies(spark, small)).drop("raw")
    payload = ledger.raw_payload(first).select(
        F.col("id").alias("doc_id"), F.col("datos_raw").alias("content"), "total_tokens"
    )
    again = replies.accepted_invoices(payload).drop("raw")
    assert first.exceptAll(again).count() == 0 and again.exceptAll(first).count() == 0


def test_with_reply_keeps_first_error(spark):
    documents = spark.createDataFrame(
        [(0, "old"), (1, None), (2, None), (3, None)], "doc_id INT, error STRING"
    )
    rows = {r.doc_id: r for r in replies.with_reply(documents, _table(spark, "{}", "{}", "x")).collect()}
    assert rows[0].error == "old" and rows[0].tokens_used == 0 and rows[0].status == "FAILED"
    assert rows[1].status == "COMPLETED" and rows[1].tokens_used == 100
    assert rows[2].status == "FAILED" and rows[3].status == "FAILED"


def test_several_replies_of_one_document(spark):
    documents = spark.createDataFrame([(1, None), (2, None)], "doc_id INT, error STRING")
    many = spark.range(500).selectExpr(
        "1 as doc_id", "concat('bad ', id) as content", "id as total_tokens"
    )
    good = spark.createDataFrame(
        [(1, '{"moneda":"PEN"}', 7)], "doc_id INT, content STRING, total_tokens BIGINT"
    )
    rows = {r.doc_id: r for r in replies.with_reply(documents, many.unionByName(good)).collect()}
    assert len(rows) == 2 and rows[1].tokens_used == 7
    assert rows[1].extracted_data.moneda == "PEN" and rows[2].status == "FAILED"
