"""Fingerprints and classes against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.graphs import components


def plain(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, radius=2):
    """Component ids by union-find over all pairs of distinct fingerprints."""
    least = {}
    for i, f in rows:
        least[f] = min((x for x in (least.get(f), i) if x is not None), default=None)
    prints = np.array(sorted(least), np.uint64)
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= radius):
            parent[root(i)] = root(i + 1 + int(j))
    best = {}
    for i, f in enumerate(prints.tolist()):
        ids = [x for x in (best.get(root(i)), least[f]) if x is not None]
        best[root(i)] = min(ids, default=None)
    return {f: best[root(i)] for i, f in enumerate(prints.tolist())}


def check(docs):
    texts = docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain(r["text"])) for r in texts]
    comp = expected(prints)
    want = sorted((repr(i), f"{f:016x}", repr(comp[f])) for i, f in prints)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got) == want


def test_equals_brute_force_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_equals_brute_force_on_hostile_texts(hostile):
    check(hostile)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_of_planted_fingerprints(spark, radius):
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(rng.randrange(4)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            prints.add(f)
    signed = [int(np.uint64(f).view(np.int64)) for f in prints]
    table = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    roots = {int(np.int64(r[0]).view(np.uint64)): r[1] for r in simhash.classes(table, radius).collect()}
    comp = expected([(i, f) for i, f in enumerate(sorted(prints))], radius)
    assert len(roots) == len(prints)
    for a in prints:
        for b in prints:
            assert (roots[a] == roots[b]) == (comp[a] == comp[b])


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fingerprint long"), 3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(300, 500)] + [(9, 9)]
    rng = random.Random(1)
    rng.shuffle(edges)
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(100, 181)} == {100}
    assert {found[i] for i in range(300, 500)} == {7} and found[9] == 9
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_kept(docs):
    texts = [(r["doc_id"], plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
    comp, least = expected([(n, f) for n, (_, f) in enumerate(texts)]), {}
    for i, f in texts:
        key = (i is None, i or 0)
        least[comp[f]] = min(least.get(comp[f], key), key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()]
    assert sorted(got) == sorted(least.values())


def test_one_row_of_each_class_stays(hostile, documents):
    check_kept(hostile)
    check_kept(documents)


def test_copies_without_an_id_and_repeated_rows_leave_one(spark):
    rows = [(None, "some text that is here", 1)] * 5 + [(4, "another one of some words", 2)] * 3 + [(9, None, 3), (8, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_number int").repartition(4)
    check_kept(docs)
    assert simhash.keep_one(docs).count() == 3


def test_nothing_to_keep(empty):
    assert simhash.keep_one(empty).count() == 0
