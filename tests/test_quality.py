"""Token budgets, confidence and payload fields against plain Python."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import budget, consensus, payload_fields


# --------------------------------------------------------------------------- budget
def fold(tokens, sizes, total):
    zone, used, spent, placed = 0, 0, 0, []
    for number, t in enumerate(tokens, 1):
        open_ = [z for z in range(zone, len(sizes)) if t <= sizes[z] - (used if z == zone else 0)]
        if not t or spent + t > total or not open_:
            continue
        used = used + t if open_[0] == zone else t
        zone, spent = open_[0], spent + t
        placed.append((number, zone + 1, t))
    return placed


@pytest.mark.parametrize("sizes,total", [((5, 9, 12), 20), ((10,), 10), ((3, 2, 1, 8), 100), ((1500, 2500, 3000), 5000)])
def test_pages_are_packed_in_order(spark, sizes, total):
    rng = random.Random(total)
    most = 7 if total < 1000 else 900
    pages = [[rng.randrange(most) for _ in range(rng.randrange(30))] for _ in range(60)] + [[], [most * 100], [0, 0]]
    rows = [(n, [(i, "w " * t) for i, t in enumerate(own, 1)]) for n, own in enumerate(pages)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id INT, pages ARRAY<STRUCT<page_no: INT, text: STRING>>")
    got = defaultdict(list)
    for r in budget.page_zones(docs, sizes=sizes, total=total).collect():
        got[r.doc_id].append((r.page_no, r.zone, r.tokens))
    for n, own in enumerate(pages):
        assert sorted(got[n]) == fold(own, sizes, total)
    use = {r.doc_id: r for r in budget.zone_use(docs, sizes=sizes, total=total).collect()}
    assert len(use) == len(rows) and use[99].pages_placed == use[99].tokens == 0
    for n, own in enumerate(pages):
        placed = fold(own, sizes, total)
        assert (use[n].pages_placed, use[n].pages_left_out) == (len(placed), len(own) - len(placed))
        for z in range(1, len(sizes) + 1):
            assert use[n][f"zone{z}_tokens"] == sum(t for _, zone, t in placed if zone == z)
            assert use[n][f"zone{z}_tokens"] <= sizes[z - 1]
        assert use[n].tokens <= total


def test_another_measure_and_wrong_sizes(spark):
    docs = spark.createDataFrame([(1, [(1, "abcd"), (2, "ab")])], "doc_id INT, pages ARRAY<STRUCT<page_no: INT, text: STRING>>")
    rows = budget.page_zones(docs, sizes=(4, 9), total=9, measure=F.length).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 4), (1, 2, 2, 2)]
    with pytest.raises(ValueError):
        budget.packed(docs, sizes=())


# ----------------------------------------------------------------------- confidence
def plain_scores(said, models, rounds=consensus.ROUNDS):
    """Expectation and maximisation over all fields one by one."""
    accuracy = {m: consensus.FIRST_ACCURACY for m in models}

    def chances(votes):
        score = {
            v: math.prod(accuracy[m] if own == v else (1 - accuracy[m]) / consensus.WRONG_VALUES for m, own in votes.items())
            for v in set(votes.values())
        }
        return {v: s / sum(score.values()) for v, s in score.items()}

    for _ in range(rounds):
        right, cast = Counter(), Counter()
        for votes in said.values():
            found = chances(votes)
            for m, own in votes.items():
                right[m] += found[own]
                cast[m] += 1
        prior = consensus.PRIOR_VOTES
        accuracy = {m: (right[m] + prior * consensus.FIRST_ACCURACY) / (cast[m] + prior) for m in models}
    return {key: chances(votes) for key, votes in said.items()}


def test_planted_errors(spark):
    rng = random.Random(6)
    models, fields = ["m1", "m2", "m3", "m4"], ["a", "b"]
    wrong = {"m1": 0.02, "m2": 0.1, "m3": 0.3, "m4": 0.6}
    rows, said, truth = [], defaultdict(dict), {}
    for doc in range(400):
        for f in fields:
            truth[doc, f] = None if rng.random() < 0.1 else f"v{rng.randrange(50)}"
        for m in models:
            if rng.random() < 0.15:
                continue
            values = {f: f"x{rng.randrange(50)}" if rng.random() < wrong[m] else truth[doc, f] for f in fields}
            rows.append((doc, m, values["a"], values["b"]))
            for f in fields:
                said[doc, f][m] = values[f]
    rows += [(1000, "stranger", "p", "q"), (3, "m1", rows[0][2], "zzz")]
    for f, v in (("a", rows[0][2]), ("b", "zzz")):  # answered twice: the least value counts
        if "m1" in said[3, f]:
            both = [x for x in (said[3, f]["m1"], v) if x is not None]
            said[3, f]["m1"] = min(both) if both else None
        else:
            said[3, f]["m1"] = v
    replies = spark.createDataFrame(rows, "doc_id INT, model STRING, a STRING, b STRING").repartition(3)
    want = plain_scores(said, models)
    got = {(r.doc_id, r.field): (r.value, r.confidence) for r in consensus.scored(replies, fields, models).collect()}
    assert set(got) == set(want)
    for key, (value, confidence) in got.items():
        assert confidence == pytest.approx(max(want[key].values()), abs=1e-9)
        assert want[key][value] == pytest.approx(confidence, abs=1e-9)
    full = [key for key in got if len(said[key]) >= 3]
    assert sum(got[k][0] == truth[k] for k in full) / len(full) > 0.95
    sure = [k for k in got if got[k][1] >= 0.7]
    unsure = [k for k in got if got[k][1] < 0.7]
    error = lambda ks: sum(got[k][0] != truth[k] for k in ks) / len(ks)
    assert unsure and error(unsure) > 5 * error(sure)
    whole = {r.doc_id: r for r in consensus.documents(consensus.scored(replies, fields, models)).collect()}
    for doc, row in whole.items():
        own = {f: got[doc, f][1] for f in fields if (doc, f) in got}
        assert row.confidence_score == pytest.approx(sum(own.values()) / len(own))
        assert row.doubtful == sorted(f for f, c in own.items() if c < 0.7)
        assert row.confident == (row.confidence_score >= 0.7)


def test_models_are_bounded(spark):
    replies = spark.createDataFrame([], "doc_id INT, model STRING, a STRING")
    assert consensus.scored(replies, ["a"], ["m1"]).count() == 0
    with pytest.raises(ValueError):
        consensus.votes(replies, ["a"], [f"m{i}" for i in range(9)])


def test_answers_are_shuffled_once(spark):
    """Of each pass; neither the join with the patterns nor the mean of a document deals them again."""
    replies = spark.createDataFrame([(1, "m1", "x", "y"), (1, "m2", "x", "z")], "doc_id INT, model STRING, a STRING, b STRING")
    scored = consensus.scored(replies, ["a", "b"], ["m1", "m2"])
    for rows in (scored, consensus.documents(scored)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_repeated_and_missing_answers(spark):
    rows = [(None, "m1", "p"), (1, "m1", "b"), (1, "m1", "a"), (1, "m1", None), (1, "m2", None), (2, None, "q"), (3, "m2", None)]
    replies = spark.createDataFrame(rows, "doc_id INT, model STRING, `a.b` STRING")
    found = consensus.votes(replies, ["a.b"], ["m2", "m1", "m3"]).collect()
    said = {r.doc_id: (r.field, [tuple(v) for v in r.said]) for r in found}
    assert said == {None: ("a.b", [("m1", "p")]), 1: ("a.b", [("m1", "a"), ("m2", None)]), 3: ("a.b", [("m2", None)])}


# ------------------------------------------------------------------- payload fields
def plain_fields(value, depth, path=""):
    inner = (
        [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        if isinstance(value, dict)
        else [(f"{path}[]", v) for v in value]
    )
    for name, v in inner:
        kind = (
            "OBJECT" if isinstance(v, dict) else "ARRAY" if isinstance(v, list) else "NULL" if v is None
            else "BOOLEAN" if isinstance(v, bool) else "STRING" if isinstance(v, str) else "NUMBER"
        )
        yield name, kind
        if depth > 1 and kind in ("OBJECT", "ARRAY"):
            yield from plain_fields(v, depth - 1, name)


def test_fields_of_payloads_of_any_shape(spark):
    payloads = [
        {"moneda": "PEN", "items": [{"descripcion": "a", "extra": 1.5}, {"cantidad": 2}], "n": None},
        {"a": {"b": {"c": {"d": {"e": 1}}}}, "l": [[1, "x"], [], {}], "big": 10**30, "t": True},
        {}, {"detraccion": {"porcentaje": 12, "monto": 1e300}, "ñ k": "é"},
    ]
    texts = [json.dumps(p) for p in payloads] + ["[1]", "no", None, "", "1", '{"a":1} x', '{"a":']
    rows = spark.createDataFrame([(t,) for t in texts], "body STRING")
    for depth in (1, 2, 4):
        want = Counter(x for p in payloads for x in plain_fields(p, depth))
        got = {(r.path, r.type): r.times for r in payload_fields.inventory(rows, depth=depth).collect()}
        assert got == dict(want)
    extra = {r.path for r in payload_fields.extras(rows).collect()}
    assert {"n", "a.b.c", "items[].extra", "l[][]", "ñ k"} <= extra and not extra & {"moneda", "items[].cantidad"}
    shape = payload_fields.shape(rows).first()
    assert shape["payloads"] == len(payloads) and "moneda: STRING" in shape["schema"]
    values = rows.select(payload_fields.value_at(F.col("body"), "$.items[0].extra", "double").alias("v"))
    assert [r.v for r in values.collect() if r.v is not None] == [1.5]
