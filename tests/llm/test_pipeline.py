"""The pipeline, stage by stage, on small tables."""

from collections import Counter, defaultdict

import corpus_pipeline
import test_decontamination
import test_secrets
import test_simhash
from ledgerloom.llm import secrets, toxicity
from ledgerloom.llm.common import read, vocabulary_path


def test_stages(spark, small):
    docs = read(spark, small, "documents")
    columns, clean = docs.columns, None
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).persist()
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
        if name == "secret scans":
            clean = docs
    assert counts[0] < 200 and counts[1] < counts[0] and counts[2] == counts[3]
    tokens = secrets.encoding(vocabulary_path("byte_bpe_50k.tiktoken"))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(not [k for k, _, _ in secrets.find(t, tokens) if k == "hex"] for t in texts.values())
    pieces = docs.collect()
    assert {p["doc_id"] for p in pieces} <= set(texts)
    size = sum(len(t.encode().split()) for t in texts.values())
    assert abs(sum(p["words"] for p in pieces) / size - 1.5) < 0.1


def test_run_gives_the_last_stage(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert {"shard", "slot", "doc_id", "text"} <= set(rows.columns) and rows.count() > 0


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=repr)


def brute_force(spark, docs, sf_dir):
    """What each stage but the last keeps, from the rows that the one before kept."""
    labels, items = read(spark, sf_dir, "labels"), read(spark, sf_dir, "benchmark").collect()
    scores = defaultdict(set)
    for r in toxicity.scored(docs, labels).collect():
        scores[r["doc_id"]].add(r["predicted"])
    rows = [r.asDict() for r in docs.collect()]
    for own in (scores[r["doc_id"]] for r in rows):
        assert len(own) == 1
    rows = [r for r in rows if scores[r["doc_id"]] == {0}]
    yield rows
    prints = [test_simhash.plain(r["text"]) for r in rows]
    group = test_simhash.expected(list(enumerate(prints)))
    first = {}
    for n, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0, n)
        first[group[prints[n]]] = min(first.get(group[prints[n]], key), key)
    rows = [rows[n] for _, _, n in first.values()]
    yield rows
    hit = test_decontamination.plain_matches(
        [(n, r["text"]) for n, r in enumerate(rows)], [(i["item_id"], i["text"]) for i in items]
    )
    dirty = {n for n, _, _ in hit}
    rows = [r for n, r in enumerate(rows) if n not in dirty]
    yield rows
    yield rows


def check_stages(spark, docs, sf_dir):
    wanted = brute_force(spark, docs, sf_dir)
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = defaultdict(set)
        for r in given.collect():
            before[repr(r["doc_id"])].add(r["text"])
        given = stage(spark, given, sf_dir).persist()
        want, got = next(wanted), given.collect()
        assert given.columns == docs.columns and ids(got) == ids(want), name
        for r in got:
            if name != "secret scans":
                assert r["text"] in before[repr(r["doc_id"])]
            else:
                left = test_secrets.base(r["text"])
                assert not left and (r["text"] in before[repr(r["doc_id"])] or "[SECRET]" in r["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, given, sf_dir).collect()
    texts = defaultdict(list)
    for r in given.collect():
        texts[repr(r["doc_id"])].append((r["text"] or "").encode().split())
    slots, used = Counter(), Counter()
    for p in pieces:
        own = p["text"].encode().split()
        assert len(own) == p["words"]
        assert any(w[p["first"] : p["first"] + p["words"]] == own for w in texts[repr(p["doc_id"])])
        slots[p["shard"], p["slot"]] += p["words"]
        used[repr(p["doc_id"])] += p["words"]
    assert all(n <= 128 for n in slots.values())
    assert all(n <= 2 * sum(map(len, texts[i])) for i, n in used.items())


def test_every_stage_against_brute_force(spark, documents, small):
    check_stages(spark, documents, small)


def test_nulls_copies_long_texts_and_other_columns(spark, hostile, small):
    check_stages(spark, hostile, small)


def test_empty_tables(spark, empty, small):
    rows = empty
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, small)
        assert rows.count() == 0, name
