"""Greedy string tiling against a direct search, and what is caught."""

import random
import re
import time

import numpy as np
import pytest

from ledgerloom.llm import decontamination as d


def plain_tiles(a, b, size):
    """Longest common run of unmarked words, again and again."""
    free_a, free_b, found = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while (
                    i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]
                    and free_a[i + k] and free_b[j + k]
                ):
                    k += 1
                if k >= size and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return found
        k, i, j = -best[0], best[1], best[2]
        for x in range(k):
            free_a[i + x] = free_b[j + x] = False
        found.append((k, i, j))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_the_direct_search(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcdef"
    a = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
    b = [rng.choice(letters) for _ in range(rng.randrange(1, 25))]
    if seed % 2:
        cut = rng.randrange(len(a))
        b = b[:5] + a[cut:] + a[: cut // 2]
    size = 2 + seed % 2
    pairs = [
        (i, j)
        for i in range(len(a) - size + 1)
        for j in range(len(b) - size + 1)
        if a[i : i + size] == b[j : j + size]
    ]
    assert d.tiles(pairs, size) == plain_tiles(a, b, size)


def words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())


def test_rolling_hashes_follow_words():
    texts = ["A b, c-d e! f", "a B c D e f", "", "x", "\u00e9t\u00e9 a b c d e", "a b c d e " * 50_000]
    found = list(d.seeds_of(texts, 5))
    assert [len(f) for f in found] == [max(0, len(words(t)) - 4) for t in texts]
    assert found[0].tolist() == found[1].tolist()
    assert found[4][-1] == found[5][0] and len(set(found[5].tolist())) == 5


def plain_matches(docs, items):
    out = set()
    for i, text in docs:
        for item, own in items:
            a, b = words(text), words(own)
            if len(b) >= 5 and set(zip(*[b[k:] for k in range(5)])) & set(zip(*[a[k:] for k in range(5)])):
                covered = sum(k for k, _, _ in plain_tiles(a, b, 5))
                if covered >= 0.5 * len(b):
                    out.add((i, item, covered))
    return out


def test_matches_equal_the_direct_search(spark):
    rng = random.Random(9)
    items = [(n, " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(4)) for _ in range(30))) for n in range(6)]
    items += [(6, None), (7, ""), (8, "too short"), (2, items[2][1])]
    docs = [(i, " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(4)) for _ in range(60))) for i in range(20)]
    for n in range(6):
        own = items[n][1].split()
        docs.append((100 + n, f"{docs[n][1]} {' '.join(own[15:])} and {' '.join(own[:15]).upper()}!"))
        docs.append((200 + n, " ".join(own[: 10 + n])))
    docs += [(300, None), (301, ""), (102, docs[22][1])]
    found = d.matches(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in found.collect()}
    assert got == plain_matches(docs, items)
    assert {(100 + n, n, 30) for n in range(6)} <= got
    kept = d.keep_clean(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    bad = {i for i, _, _ in got}
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, _ in docs if i not in bad)


def test_hostile_and_empty_tables(spark, hostile, empty):
    items = spark.createDataFrame(
        [(1, "QUICK brown fox jumps over the lazy dog"), (2, None)], "item_id long, text string"
    )
    got = {r["doc_id"] for r in d.matches(hostile, items).collect()}
    assert got == {6, 7, None}
    kept = d.keep_clean(hostile, items)
    assert kept.columns == hostile.columns
    assert kept.count() == hostile.count() - 4
    assert d.matches(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.matches(hostile, none).count() == 0


def test_seeds_are_runs_before_they_are_grouped(spark):
    """What both sides repeat gives a row per diagonal; gaps and repeated rows are seen."""
    pairs = {(a, b) for a in range(60) for b in range(40)} | {(100, 3), (101, 4), (103, 6)}
    rows = [("k", 1, a, "i", 44, b) for a, b in pairs] * 2
    joined = spark.createDataFrame(
        rows, "key string, doc_id long, place int, item_id string, item_words long, at int"
    ).repartition(4)
    runs = [(r["words"], r["place"], r["at"]) for r in d.seed_runs(joined, 5).collect()]
    assert len(runs) == 60 + 40 - 1 + 2
    assert {(6, 100, 3), (5, 103, 6), (44, 0, 0), (44, 20, 0), (5, 59, 0)} <= set(runs)
    assert sorted(d.tiles_of_runs(runs, 5)) == sorted(d.tiles(list(pairs), 5))


def test_document_and_item_that_repeat_a_word(spark):
    docs = spark.createDataFrame([(1, "ha " * 3000), (2, "other words only here and there")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "ha " * 400)], "item_id string, text string")
    rows = d.matches(docs, items).collect()
    assert [(r["doc_id"], r["covered"], r["tiles"][0]["words"]) for r in rows] == [(1, 400, 400)]


def shared_places(a, b, size):
    """Common runs of `size` words with their places on both sides."""
    sides = []
    for side in (a, b):
        places = {}
        for i in range(len(side) - size + 1):
            places.setdefault(tuple(side[i : i + size]), []).append(i)
        sides.append(places)
    names = {run: n * 0x9E3779B97F4A7C15 % 2**63 for n, run in enumerate(sorted(sides[0].keys() & sides[1].keys()))}
    return [(n, np.array(sides[0][run]), np.array(sides[1][run])) for run, n in names.items()]


@pytest.mark.parametrize("seed", range(150))
def test_tiles_of_places_equal_the_direct_search(seed):
    rng = random.Random(seed)
    letters = ("a", "ab", "abc", "abcdef")[seed % 4]
    a = [rng.choice(letters) for _ in range(rng.randrange(1, 60))]
    b = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
    if seed % 3:
        cut = rng.randrange(len(a))
        b = b[:5] + a[cut:] + b[:3] + a[: cut // 2] + a[cut:]
    size = 2 + seed % 3
    assert d.tiles_of_places(shared_places(a, b, size), size) == plain_tiles(a, b, size)


def test_repeats_on_both_sides_join_to_a_few_rows(spark):
    """10,000 equal words, and a phrase of three words 4,000 times, on both sides."""
    one, three = "ha " * 10_000, "to and fro " * 4_000
    docs = spark.createDataFrame([(1, one), (2, "so " + three), (3, one + three)], "doc_id long, text string")
    items = spark.createDataFrame([("a", one), ("b", three)], "item_id string, text string")
    seeds = d.benchmark_seeds(items)
    assert seeds.count() == 1 + 3
    assert sorted(len(r["places"]) for r in seeds.collect()) == [3998, 3999, 3999, 9996]
    started = time.monotonic()
    rows = {(r["doc_id"], r["item_id"]): (r["covered"], len(r["tiles"])) for r in d.matches(docs, items).collect()}
    assert rows == {(1, "a"): (10_000, 1), (2, "b"): (12_000, 1), (3, "a"): (10_000, 1), (3, "b"): (12_000, 1)}
    assert time.monotonic() - started < 60


def test_seeds_that_many_hold_bring_no_pair_together(spark):
    """Items that share a run of words meet only documents that hold their rare seeds."""
    phrase = "these five words are common"
    own = [" ".join(f"w{n}x{i}" for i in range(25)) for n in range(20)]
    items = [(n, f"{own[n]} {phrase}") for n in range(20)]
    docs = [(i, f"a{i} b{i} {phrase} c{i}") for i in range(200)]
    docs += [(1000 + n, f"{phrase} {' '.join(own[n].split()[:16])}") for n in range(20)]
    docs += [(2000 + n, f"{' '.join(own[n].split()[:9])} and {phrase}") for n in range(20)]
    docs_ = spark.createDataFrame(docs, "doc_id long, text string")
    items_ = spark.createDataFrame(items, "item_id long, text string")
    seeds = d.benchmark_seeds(items_)
    hits = spark.createDataFrame(
        [
            (str(i), i, int(v))
            for i, text in docs
            for v in next(d.seeds_of([text], 5)).view(np.int64)
        ],
        "key string, doc_id long, seed long",
    )
    met = hits.join(d.rare_seeds(hits, seeds, 5, 0.5), "seed").select("doc_id", "item").distinct()
    assert met.count() == 40
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in d.matches(docs_, items_).collect()}
    assert got == plain_matches(docs, items) and len(got) == 20


@pytest.mark.parametrize("coverage", [0.0, 0.2, 0.37, 0.8, 1.0])
def test_rare_seeds_lose_no_match(spark, coverage):
    """Against all pairs, for items of many lengths cut to about the coverage."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(5 + n))) for n in range(30)]
    docs = []
    for n in range(120):
        words_, text = items[n % 30][1].split(), []
        for _ in range(rng.randrange(1, 4)):
            start = rng.randrange(len(words_))
            text += words_[start : start + rng.randrange(5, 14)] + [f"z{rng.randrange(99)}"]
        docs.append((n, " ".join(text)))
    found = d.matches(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        coverage=coverage,
    )
    want = set()
    for i, text in docs:
        for item, own in items:
            covered = sum(k for k, _, _ in plain_tiles(words(text), words(own), 5))
            if covered and covered / len(words(own)) >= coverage:
                want.add((i, item, covered))
    assert {(r["doc_id"], r["item_id"], r["covered"]) for r in found.collect()} == want


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [
        " ".join("".join(rng.choice("ab\u00e9") for _ in range(rng.randrange(1, 9))) for _ in range(3000)),
        "x" * 5000 + " one two three four five " + "y" * 700,
        ",.;" * 900 + "a b c d e",
    ]
    whole = [r.tolist() for r in d.seeds_of(texts, 5)]
    monkeypatch.setattr(d, "_CHUNK", 512)
    monkeypatch.setattr(d, "_TABLES", {})
    assert [r.tolist() for r in d.seeds_of(texts, 5)] == whole
