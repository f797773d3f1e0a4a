"""Confidence of extracted fields from the replies of several models to one document.

Models that give the same value for a field support it.  How far a model is to be trusted
is estimated from all documents at once: each field of each document gives a pattern of
who agrees with whom, equal patterns are counted, and a few rounds of expectation and
maximisation run over the counts.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv

#: Rounds of estimation, first accuracy of a model, values that a wrong answer may take,
#: and votes by which the first accuracy counts in each estimate.
ROUNDS, FIRST_ACCURACY, WRONG_VALUES, PRIOR_VOTES = 5, 0.8, 10, 10
#: Most models; with eight there are at most 21,146 patterns of agreement.
MOST_MODELS = 8


def votes(replies: DataFrame, fields: list[str], models: list[str]) -> DataFrame:
    """``doc_id, field, said``: what the models say of each field of a document, in their order.

    A model that answered a document several times counts once, with its least values.
    A missing value is an answer like any other.  Replies of other models do not count.
    All answers to a document meet in one row, in the only shuffle.
    """
    known = sorted(set(models))
    if not 1 <= len(known) <= MOST_MODELS:
        raise ValueError(f"between 1 and {MOST_MODELS} models can be weighed")
    number = F.array_position(F.array(*[F.lit(m) for m in known]), F.col("model")).cast("int")
    values = [F.col(f"`{name}`").cast("string").alias(f"v{k}") for k, name in enumerate(fields)]
    numbered = replies.where(F.col("model").isin(*known)).select("doc_id", number.alias("model"), *values)
    by_model = lambda m, value: F.min(F.when(F.col("model") == m, value))
    met = numbered.groupBy("doc_id").agg(
        *[by_model(m, F.lit(True)).alias(f"m{m}") for m in range(1, len(known) + 1)],
        *[by_model(m, F.col(f"v{k}")).alias(f"m{m}v{k}") for m in range(1, len(known) + 1) for k in range(len(fields))],
    )

    def said(k: int) -> Column:
        votes_of = [
            F.when(F.col(f"m{m}"), F.struct(F.lit(name).alias("model"), F.col(f"m{m}v{k}").alias("value")))
            for m, name in enumerate(known, 1)
        ]
        return F.array_compact(F.array(*votes_of)).alias("said")

    lines = [F.struct(F.lit(name).alias("field"), said(k)) for k, name in enumerate(fields)]
    return met.select("doc_id", F.inline(F.array(*lines)))


def patterns(cast: DataFrame) -> DataFrame:
    """``doc_id, field, answers, pattern``: the answers of a field by model, and who agrees.

    ``answers`` has one entry a model, in order of models, with its value and ``same``, the
    place of the first model that says so.  The pattern is these places as text.  A list has
    one entry for each model, so no group is larger than that.
    """
    marked = F.transform(
        "said",
        lambda vote: F.struct(
            vote["model"].alias("model"),
            vote["value"].alias("value"),
            F.array_position(
                F.transform("said", lambda other: other["value"].eqNullSafe(vote["value"])), F.lit(True)
            ).alias("same"),
        ),
    )
    pattern = F.array_join(
        F.transform("answers", lambda a: F.concat_ws(":", a["model"], a["same"])), ","
    )
    return cast.select("doc_id", "field", marked.alias("answers")).withColumn("pattern", pattern)


def _posterior(members: list[tuple[str, int]], accuracy: dict[str, float]) -> dict[int, float]:
    """Probability of each answer of a pattern, by its place."""
    score = {
        place: sum(
            math.log(accuracy[m] if own == place else (1 - accuracy[m]) / WRONG_VALUES) for m, own in members
        )
        for place in {own for _, own in members}
    }
    top = max(score.values())
    weight = {place: math.exp(s - top) for place, s in score.items()}
    whole = sum(weight.values())
    return {place: w / whole for place, w in weight.items()}


def accuracies(counted: list[tuple[str, int]], models: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Accuracy of each model from the counts of patterns."""
    accuracy = {model: FIRST_ACCURACY for model in models}
    parsed = [(_members(pattern), count) for pattern, count in sorted(counted)]
    for _ in range(rounds):
        right: dict[str, float] = defaultdict(float)
        cast: dict[str, int] = defaultdict(int)
        for members, count in parsed:
            likely = _posterior(members, accuracy)
            for model, own in members:
                right[model] += count * likely[own]
                cast[model] += count
        accuracy = {
            m: (right[m] + PRIOR_VOTES * FIRST_ACCURACY) / (cast[m] + PRIOR_VOTES) for m in models
        }
    return accuracy


def _members(pattern: str) -> list[tuple[str, int]]:
    parts = (part.rsplit(":", 1) for part in pattern.split(","))
    return [(model, int(place)) for model, place in parts]


def scored(replies: DataFrame, fields: list[str], models: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, field, value, confidence``: the most likely value of each field.

    The driver sees the counts of patterns, whose number is bounded by the models and not by
    the documents.  Of equally likely values the one of the first model by name counts.
    Names of models hold no comma.
    """
    answered = patterns(votes(replies, fields, models))
    counted = [
        (r["pattern"], r["n"]) for r in answered.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    ]
    accuracy = accuracies(counted, sorted(set(models)), rounds)
    chosen = []
    for pattern, _ in counted:
        likely = _posterior(_members(pattern), accuracy)
        place = min(likely, key=lambda p: (-round(likely[p], 9), p))
        chosen.append((pattern, place, likely[place]))
    # From Arrow it is a local table of known size, so that it is broadcast; the answers stay put.
    kinds = pa.schema([("pattern", pa.string()), ("place", pa.int32()), ("confidence", pa.float64())])
    rows = [dict(zip(kinds.names, row)) for row in chosen]
    table = replies.sparkSession.createDataFrame(pa.Table.from_pylist(rows, kinds))
    return answered.join(table, "pattern").select(
        "doc_id", "field", F.element_at("answers", F.col("place"))["value"].alias("value"), "confidence"
    )


def documents(scored_fields: DataFrame, least: float = fv.CONFIDENCE) -> DataFrame:
    """``doc_id, confidence_score, confident, doubtful``: the mean over the fields of a document,
    whether it reaches the threshold, and the fields that do not, in order."""
    low = F.when(F.col("confidence") < least, F.col("field"))
    return scored_fields.groupBy("doc_id").agg(
        F.avg("confidence").alias("confidence_score"), F.sort_array(F.collect_list(low)).alias("doubtful")
    ).select(
        "doc_id", "confidence_score", (F.col("confidence_score") >= least).alias("confident"), "doubtful"
    )
