"""Edit-aware counts equal those of the whole text."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.llm.common import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.tiktoken")
PIECES = ["a", "b", " ", "  ", "\n", "'", "'re", "l", "1", "23", ".", "...", "\u00e9", "\U0001f600", " the", "\t", "ing"]


def test_edits_against_whole_texts():
    count, rng = tokens.counter(PATH), random.Random(5)
    text_of = lambda n: "".join(rng.choice(PIECES) for _ in range(n))
    for _ in range(600):
        text = text_of(rng.choice([0, 3, 50, 400, 3000]))
        tree = tokens.build(text, count)
        assert tree.total == len(count.tokens.encode_ordinary(text))
        for _ in range(rng.randrange(1, 5)):
            at, cut = rng.randrange(len(text) + 1), rng.choice([0, 1, 2, 5, 100])
            new = text_of(rng.choice([0, 1, 2, 10, 200]))
            want = text[:at] + new + text[at + cut :]
            text, tree, _, _ = tokens.edit(text, tree, at, cut, new, count)
            assert text == want
            assert tree.total == len(count.tokens.encode_ordinary(text))
            assert sum(tree.chars[0]) == len(text)
            assert tokens.Tree.read(**tree.flat()) == tree
            for low, high in zip(tree.tokens, tree.tokens[1:]):
                assert high == [sum(low[i : i + 16]) for i in range(0, len(low), 16)]


def test_a_small_edit_encodes_little():
    count = tokens.counter(PATH)
    text = "the quick brown fox jumps over the lazy dog. " * 5000
    tree = tokens.build(text, count)
    _, _, encoded, nodes = tokens.edit(text, tree, 100_000, 3, "cat", count)
    assert encoded < 2000 and nodes < 20


def check(docs):
    count = tokens.counter(PATH)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edits = rows.withColumn("edits", tokens.derived_edits("text", "doc_id", "text")).collect()
    want = []
    for r in edits:
        text = r["text"]
        for e in r["edits"]:
            text = text[: e["start"]] + e["insert"] + text[e["start"] + e["length"] :]
        n = lambda t: len(count.tokens.encode_ordinary(t))
        want.append((repr(r["doc_id"]), len(r["text"]), n(r["text"]), n(text), len(text)))
    got = [
        (repr(r["doc_id"]), r["n_chars"], r["n_tokens"], r["n_tokens_after"], r["n_chars_after"])
        for r in tokens.counted(docs).collect()
    ]
    assert sorted(got) == sorted(want)


def test_documents(documents):
    check(documents)


def test_hostile_texts(hostile):
    check(hostile.filter("doc_id <> 9 or doc_id is null"))


def test_long_and_empty(spark, empty):
    assert tokens.counted(empty).count() == 0
    docs = spark.createDataFrame([(1, "word " * 300_000)], "doc_id long, text string")
    row = tokens.counted(docs).first()
    assert row["n_tokens"] == 300_001 and row["chars_encoded"] < 5000


def test_nulls_in_edits(spark):
    kind = "array<struct<start:int,length:int,insert:string>>"
    docs = spark.createDataFrame(
        [(1, "a b", None), (2, "a b", [None, (None, None, None)]), (3, "a b", [(99, -4, "!"), (-5, 1, None)])],
        f"doc_id long, text string, changes {kind}",
    )
    rows = {r["doc_id"]: r for r in tokens.counted(docs, edits=F.col("changes")).collect()}
    assert [rows[i]["n_chars_after"] for i in (1, 2, 3)] == [3, 3, 3]
    assert rows[3]["n_tokens_after"] == 2
