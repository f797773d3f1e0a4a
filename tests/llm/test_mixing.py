"""Mixing: targets, permutations, draws and what is taken."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import mixing


def plain_targets(sizes):
    """Targets by weight with the excess dealt out again, in fractions."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: Fraction(2 * sizes[s]) for s in over}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 10, "b": 1000, "c": 10, None: 500, "\u00e9": 7},
        {"a": 0, "b": 5},
        {None: 3},
        {f"s{i}": 1000 * (i + 1) for i in range(20)},
    ],
)
def test_targets(sizes):
    plan = mixing.quotas(list(sizes.items()))
    want = plain_targets(sizes)
    assert {q.source: q.target for q in plan} == {s: float(t) for s, t in want.items()}
    assert all(q.slots <= 2 * q.blocks for q in plan)


def test_no_sources():
    assert mixing.quotas([]) == []


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations(size):
    index = np.arange(size, dtype=np.uint64)
    orders = set()
    for key in range(4):
        found = mixing.permuted(index, np.full(size, size, np.uint64), np.full(size, key, np.uint64))
        assert sorted(found.tolist()) == list(range(size))
        orders.add(tuple(found.tolist()))
    assert size < 5 or len(orders) == 4


def test_slots_give_each_source_its_quota(spark):
    plan = mixing.quotas([("a", 5000), ("b", 900), (None, 40_000), ("c", 0)], block_words=10)
    rows = mixing.slots(spark, plan, shard_slots=100).collect()
    got = Counter(r["source"] for r in rows)
    assert got == Counter({q.source: q.slots for q in plan if q.slots})
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) == sum(q.slots for q in plan)
    by_source = defaultdict(Counter)
    for r in rows:
        by_source[r["source"]][r["block"]] += 1
    for q in plan:
        times = by_source[q.source]
        assert all(0 <= b < q.blocks for b in times)
        if q.slots:
            assert max(times.values()) - min(times.get(b, 0) for b in range(q.blocks)) <= 1
    counts = defaultdict(Counter)
    for r in rows:
        counts[r["source"]][r["shard"]] += 1
    assert len(set(counts[None].values())) > 1  # shards draw, they do not share evenly


def check(docs, block_words=16):
    rows = mixing.packed(docs)
    plan = mixing.quotas(mixing.source_sizes(rows), block_words)
    options = {"block_words": block_words, "shard_slots": 64}
    got = mixing.taken(rows, plan, **options).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    words = lambda t: len((t or "").encode().split())
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted(
        (repr(i), words(t)) for i, t, _ in texts
    )
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += words(t)
    targets = plain_targets(dict(sizes)) if texts else {}
    totals = Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        totals[r["source_size"], round(r["target"], 6)] += r["taken"]
    by_pair = defaultdict(list)
    for s, t in targets.items():
        by_pair[sizes[s], round(float(t), 6)].append(s)
    for pair, sources in by_pair.items():
        assert abs(totals[pair] - pair[1] * len(sources)) <= 2 * block_words * len(sources)
    again = mixing.taken(rows, plan, **options).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    return rows, plan, options


def test_documents(documents):
    check(documents)


def test_hostile_texts(hostile):
    check(hostile, 4)


def test_empty_table(empty):
    check(empty)


def test_blocks_hold_the_words(hostile):
    rows, plan, options = check(hostile, 4)
    texts = {r["row"]: (r["text"] or "").encode().split() for r in rows.collect()}
    pieces = mixing.mix(rows, plan, with_text=True, **options).collect()
    lengths = Counter()
    for p in pieces:
        own = texts[p["row"]][p["first"] : p["first"] + p["words"]]
        assert p["text"].encode() == b" ".join(own) and len(own) == p["words"] > 0
        lengths[p["shard"], p["slot"]] += p["words"]
    assert set(lengths.values()) - {4} == set() or max(lengths.values()) == 4


def test_the_query_runs_alike_again(spark, small):
    from ledgerloom.llm.queries import op1_mixing

    first, second = (sorted(map(tuple, op1_mixing(spark, small).collect())) for _ in range(2))
    assert first == second


def test_the_mix_does_not_follow_the_split(spark, hostile):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for table, words in ((docs, 128), (hostile, 4)):
        found = []
        for dealt in (table.coalesce(1), table.repartition(5), table.repartition(11, "doc_id")):
            rows = mixing.packed(dealt)
            plan = mixing.quotas(mixing.source_sizes(rows), words)
            got = mixing.taken(rows, plan, block_words=words, shard_slots=64).collect()
            found.append(sorted(map(repr, got)))
        assert found[0] == found[1] == found[2]
