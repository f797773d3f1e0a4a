"""Ranked search against scoring every document, and the blocks' bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import lexical
from ledgerloom.llm.common import read

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(docs, items, ranks=50):
    counts = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        own = sorted(set(terms(text)) & set(df))
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own}
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // words
            score = sum(weights[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:ranks], 1):
            found.append((item, rank, None if none else i, -score))
    return sorted(found, key=repr)


def run(docs, items, **options):
    return sorted(map(tuple, lexical.search(lexical.index(docs), items, **options).collect()), key=repr)


def pairs(rows, key):
    return [(r[key], r["text"]) for r in rows.select(key, "text").collect()]


def test_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    assert run(docs, items) == expected(pairs(docs, "doc_id"), pairs(items, "item_id"))


@pytest.mark.parametrize("at_once", [5, 256])
def test_hostile_texts_as_documents_and_items(hostile, at_once):
    items = hostile.withColumnRenamed("doc_id", "item_id")
    want = expected(pairs(hostile, "doc_id"), pairs(items, "item_id"), 5)
    assert run(hostile, items, ranks=5, items_at_once=at_once) == want


def test_small_segments_and_no_summaries(spark, small, monkeypatch):
    docs, items = read(spark, small, "documents"), read(spark, small, "benchmark")
    want = expected(pairs(docs, "doc_id"), pairs(items, "item_id"))
    for name, value in (("CELLS", 1), ("SUMMARY_BYTES", 0)):
        with monkeypatch.context() as patch:
            patch.setattr(lexical, name, value)
            vocabulary = sorted({t for _, text in pairs(items, "item_id") for t in terms(text)})
            batch = lexical.index(docs).toArrow().to_batches()
            facts = lexical.index(docs).selectExpr("count(*)", "sum(n)").first()
            best = lexical.Best.none(50)
            size = max(lexical._LEAST, lexical.CELLS // len(vocabulary))
            segments = list(lexical._segments(batch, lexical.pa.array(vocabulary), *facts, size))
            assert len(segments) > 3 or name == "SUMMARY_BYTES"
            df = lexical.document_counts(lexical.index(docs), vocabulary)
            item, text = pairs(items, "item_id")[0]
            own = np.array(sorted({vocabulary.index(t) for t in terms(text)}))
            weights = np.array([lexical.weight(facts[0], df.get(vocabulary[t], 0)) for t in own])
            for segment in segments:
                segment.search(own, weights, best)
        got = list(zip(best.document.tolist(), best.score.tolist()))
        assert got == [(d, s) for i, r, d, s in sorted(want, key=lambda x: (x[0], x[1])) if i == item]


def test_bounds_hold_and_skip(spark):
    rng = np.random.default_rng(5)
    topics = rng.random((20, 300)) < 0.1
    rows = [np.flatnonzero(topics[d % 20] & (rng.random(300) < 0.8)) for d in range(2000)]
    document = np.concatenate([np.full(len(r), d) for d, r in enumerate(rows)])
    term = np.concatenate(rows)
    impact = rng.integers(1, 1_000_000, len(term))
    segment = lexical.Segment(np.arange(2000), np.zeros(2000, bool), document, term, impact, 300)
    for number, blocks in segment.blocks.items():
        members = np.concatenate([segment.members[b] for b in blocks])
        assert sorted(members) == sorted(document[term == number])
    for b, place in enumerate(segment.place):
        assert (segment.impacts[segment.members[b]].max(axis=0) <= segment.summary[place].astype(np.int64) * lexical.STEP).all()
    weights = np.full(300, 1000)
    own = np.flatnonzero(topics[0])
    best = lexical.Best.none(10)
    opened, blocks = segment.search(own, weights[own], best)
    score = segment.impacts[:, own].astype(np.int64) @ weights[own]
    assert best.document.tolist() == np.lexsort((np.arange(2000), -score))[:10].tolist()
    assert opened < blocks / 2


def test_ties_go_by_id(spark):
    rows = [(i, "same words here") for i in range(200)] + [(None, "same words here"), (5, "same words here")]
    rows += [(1000 + i, f"other text {i}") for i in range(300)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "HERE same"), (1, "Here same"), (2, None), (3, "?!")], "item_id long, text string")
    got = run(docs, items, ranks=7)
    assert got == expected(pairs(docs, "doc_id"), pairs(items, "item_id"), 7)
    assert [r[2] for r in sorted(got)[::2]] == [0, 1, 2, 3, 4, 5, 5]


def test_empty_tables(spark, empty, hostile):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert run(empty, items) == []
    assert run(hostile, items.filter("false")) == []


def test_long_text_is_counted_alike(monkeypatch):
    text = "Some Words, some more " * 50
    want = lexical.counted(text)
    monkeypatch.setattr(lexical, "_LONG", 10)
    assert lexical.counted(text) == want == Counter(terms(text))
