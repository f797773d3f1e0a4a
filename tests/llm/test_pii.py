"""Personal data against a direct restatement of the patterns in Python."""

import hashlib
import re

import pytest

from ledgerloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base(text):
    found = [
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if holds(kind, m.group())
    ]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def check(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    want = sorted(
        (repr(i), hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t in texts
    )
    assert sorted((repr(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    for row in rows:
        spans = row["spans"].split(",") if row["spans"] else []
        own = [s for s in spans if s.split(":")[0] in PATTERNS]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == row["base_sha256"]
        for kind in PATTERNS:
            assert row[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in own)


def test_equals_patterns_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_equals_patterns_on_hostile_texts(hostile):
    check(hostile)


def test_empty_table(empty):
    assert pii.report(empty).count() == 0


def test_added_kinds_need_checks_or_context(spark):
    texts = [
        "iban DE89 3704 0044 0532 0130 00",
        "iban DE89 3704 0044 0532 0130 01",
        "my ssn is 123-45-6789",
        "part 123-45-6789",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert "iban:5:32" in spans[0] and "iban" not in spans[1]
    assert "national_id:10:21" in spans[2] and "national_id" not in spans[3]


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame(
        [(1, "call +1 504 555 2652"), (2, "see +1 504 555 2652")], "doc_id long, text string"
    )
    scores = {r["doc_id"]: float(r["scores"]) for r in pii.report(docs).collect()}
    assert scores[1] > scores[2]


def test_extra_columns_stay(hostile):
    found = pii.with_spans(hostile)
    assert found.columns == [*hostile.columns, "pii_"]


@pytest.mark.parametrize("count", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, count):
    numbers = [(i * 7) % 5 for i in range(count)]
    rows = spark.createDataFrame([(numbers,)], "x array<int>")
    got = rows.select(pii.running_sums(rows["x"])).first()[0]
    want, total = [], 0
    for n in numbers:
        total += n
        want.append(total)
    assert got == want
