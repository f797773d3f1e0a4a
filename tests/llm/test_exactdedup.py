"""Groups of equal texts against grouping in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exactdedup
from ledgerloom.llm.common import read
from ledgerloom.llm.queries import op11_dedup


def expected(rows, largest):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    found = []
    for text, ids in groups.items():
        named = sorted((i for i in ids if i is not None), reverse=largest)
        order = named + [None] * (len(ids) - len(named))
        digest = hashlib.sha256(text.encode()).hexdigest()
        keep = named[0] if named else None
        found += [(i, keep, len(ids), n == 0, digest) for n, i in enumerate(order)]
    return sorted(found, key=repr)


def check(docs, largest):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = exactdedup.duplicates(docs, largest=largest).collect()
    assert sorted(map(tuple, got), key=repr) == expected(texts, largest)


@pytest.mark.parametrize("largest", [True, False])
def test_equals_grouping(documents, largest):
    check(documents, largest)


@pytest.mark.parametrize("largest", [True, False])
def test_hostile_texts(hostile, largest):
    check(hostile, largest)


def test_empty_table(empty):
    assert exactdedup.duplicates(empty).count() == 0


@pytest.mark.parametrize("largest", [True, False])
def test_group_over_many_partitions(spark, largest):
    rng = random.Random(3)
    same = "the same line " * 40
    rows = [(i, same) for i in range(4000)] + [(i, same + str(i % 5)) for i in range(4000, 5000)]
    rows += [(i, "x" * (i % 7)) for i in range(5000, 5100)]
    rows += [(7, same), (7, same), (None, same), (None, same)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = exactdedup._numbered(docs, "doc_id", "text", None, largest).filter("not edge")
        parts = [r["count"] for r in numbered.groupBy("part").count().collect()]
        assert len(parts) > 8 and max(parts) < 1000  # the large group is not in one task
        check(docs, largest)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "ab"), (4, None)], "doc_id long, text string")
    squeeze = lambda text: F.lower(F.regexp_replace(text, r"\s+", " "))
    got = {r["doc_id"]: r["keep_id"] for r in exactdedup.duplicates(docs, normalise=squeeze).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    kept = exactdedup.keep_one(docs, normalise=squeeze).collect()
    assert sorted((r["doc_id"], r["group_size"]) for r in kept) == [(1, 2), (3, 1), (4, 1)]


def test_query(spark, small):
    docs = read(spark, small, "documents")
    got = op11_dedup(spark, small).collect()
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], True)
    assert sorted(map(tuple, got), key=repr) == want
