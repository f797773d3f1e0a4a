"""Decoding, the language model, and accuracy on held-out labels."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import toxicity as t


@pytest.fixture(scope="module")
def costs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return t.language_model(t.trigram_counts(docs))


def test_counts_cover_all_texts(spark, hostile):
    want = Counter()
    for r in hostile.collect():
        s = t.symbols(r["text"] or "")
        want.update(zip(s[:-2].tolist(), s[1:-1].tolist(), s[2:].tolist()))
    got = t.trigram_counts(hostile).reshape(64, 64, 64)
    assert got.sum() == sum(want.values())
    assert all(got[k] == n for k, n in want.items())


def plain_decode(word, costs, spaced=False):
    """The cheapest of all paths."""
    best = None
    for path in itertools.product(*t.lattice(word, spaced)):
        text, cost = "".join(x for _, x in path), sum(c for c, _ in path)
        a = b = 0
        for character in [*text, " "]:
            z = t._symbol(character)
            cost += float(costs[a, b, z])
            a, b = b, z
        if best is None or cost < best[0] - 1e-9:
            best = (cost, text)
    return best


@pytest.mark.parametrize("word", ["1d10t", "m0r0n", "cl0wn", "l0$er", "tr@sh", "sccccum", "p4th3t1c", "w0rth|ess"])
def test_viterbi_finds_the_cheapest_path(costs, word):
    cost, text = plain_decode(word, costs)
    got = t.decode(word, costs)
    again = min(c for c, x in [plain_decode(word, costs)])
    assert got == text or abs(again - cost) < 1e-3


def test_disguised_words_are_restored(costs):
    restorer = t.Restorer(costs)
    found = [restorer.word(w)[0] for w in ("1diot", "m0ron", "cl0wn", "l0ser", "tr4sh", "idiooooot", "scu\u006d")]
    assert found == ["idiot", "moron", "clown", "loser", "trash", "idiot", "scum"]
    assert "idiot" in restorer.words("you i d i o t !") and "clown" in restorer.words("a c.l.o.w.n. here")
    assert restorer.words("in 2023 we paid 1000 and 3.14%") == Counter(
        ["in", "2023", "we", "paid", "1000", "and", "3", "14"]
    )


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = t.scored(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], r["toxic"]) for r in rows if r["held_out"]]
    toxic = np.array([s for s, y in held if y])
    clean = np.array([s for s, y in held if not y])
    assert (toxic[:, None] > clean[None]).mean() > 0.97
    assert (toxic >= 0.3).mean() > 0.9 and (clean >= 0.3).mean() < 0.02


def test_labels_held_out_do_not_count(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = labels.selectExpr(
        "doc_id", "quality", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic"
    )
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, t.scored(docs, labels).collect())) == sorted(map(tuple, t.scored(docs, other).collect()))


def test_hostile_texts_and_labels(spark, hostile, empty):
    ids = [1, 2, 3, 4, 5, 6, 7, 7, 8, None]
    labels = spark.createDataFrame(
        [(i, n % 2 if n != 4 else None) for n, i in enumerate(ids)], "doc_id long, toxic int"
    )
    rows = t.scored(hostile, labels).collect()
    assert len(rows) == hostile.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.filter("false")
    assert {r["predicted"] for r in t.scored(hostile, none).collect()} == {0}
    assert t.scored(empty, labels).count() == 0
    kept = t.keep_clean(hostile, none)
    assert kept.columns == hostile.columns and kept.count() == hostile.count()


SIGNS = {letter: [sign for sign, letters in t.LEET.items() if letter in letters] for letter in "abceghilostz"}


def disguised(rng, word, way):
    able = [i for i, c in enumerate(word) if SIGNS.get(c)]
    if way in ("some", "all"):
        chosen = able if way == "all" else rng.sample(able, min(len(able), rng.randrange(1, 4)))
        return "".join(rng.choice(SIGNS[c]) if i in chosen and (i or way == "some") else c for i, c in enumerate(word))
    at = rng.randrange(1, len(word) - 1)
    if way == "marks":
        return word[:at] + rng.choice("*-._~") + word[at:]
    return word[: at + 1] + word[at] * (1 if way == "twice" else 3) + word[at + 1 :]


def test_recall_of_200_restored_words(spark, costs):
    """Frequent words, disguised; the README has these figures.

    Most misses of the first two ways are signs at the edge of a word, read as punctuation.
    """
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = Counter(w for r in docs.collect() for w in re.findall(r"[a-z]{4,}", r["text"].lower()))
    frequent = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:1500]]
    rng = random.Random(3)
    words = rng.sample(frequent, 200)
    restorer = t.Restorer(costs)
    least = {"some": 160, "all": 135, "marks": 190, "twice": 135, "often": 180}
    for way, wanted in least.items():
        found = sum(w in restorer.read(disguised(rng, w, way)) for w in words)
        assert found >= wanted, (way, found)
    doubled = [w for w in frequent if re.search(r"(.)\1", w)]
    assert sum(restorer.read(w) == (w,) for w in doubled) >= 0.97 * len(doubled)


def test_words_that_were_left_as_they_are(costs):
    restorer = t.Restorer(costs)
    for raw, word in {
        "m34d0w": "meadow", "570ry": "story", "h311o": "hello", "4g41n": "again", "sto*ry": "story", "s-t0ry": "story",
        "stoory": "story",
    }.items():
        assert word in restorer.read(raw), raw
    assert {"well", "known"} <= set(restorer.read("well-known"))
    assert "".join(restorer.read("ab1" * 1000)) and len(restorer.read("a" * 100_000)) > 0


def test_one_double_is_read_as_the_lattice_reads_it(costs):
    rng = random.Random(5)
    restorer = t.Restorer(costs)
    for _ in range(400):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9)))
        word = "".join(c for i, c in enumerate(word) if not i or c != word[i - 1])
        at = rng.randrange(len(word))
        word = word[: at + 1] + word[at:]
        assert restorer.read(word) == (t.decode(word, costs),), word
