"""Toxicity scores of texts restored through a noisy channel.

Disguised words (digits for letters, blanks between letters, repeated letters) are
decoded by the Viterbi algorithm: a lattice holds what each character may stand for,
and a character language model counted over the whole corpus picks the path.  A
logistic regression over words and word beginnings scores the restored text.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import release, saved, text_of

#: What a character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l",
    "#": "h",
}
#: Costs of the channel in nats: a replaced, a dropped and an added character.  A character
#: that may be a letter is dropped only where no reading has a likely place.
REPLACED, DROPPED, ADDED = 1.0, 20.0, 0.7
#: Costs of a letter written twice for once, and of any other mark inside of a word: one
#: that means nothing, and one that ends the word.
DOUBLED, IGNORED, ENDED = 6.0, 1.0, 3.0
#: Characters of a run without blanks that are read together.
LONGEST = 1_000
#: Letters that make a run, and the prefixes of a word that are features.
RUN, PREFIXES = 3, range(3, 9)
#: Bounds of the classifier: labelled rows, features, and rows that a feature needs.
SAMPLE_ROWS, FEATURES, LEAST_ROWS = 8_000, 1_000, 5
THRESHOLD = 0.3
#: Symbols of the language model: 0 ends a word, 1 to 26 are a to z, then Latin letters
#: from U+00DF on, and the last one is any other letter.
_SYMBOLS = 64
_SEEN = 50_000


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    for code in range(0x250):
        character = chr(code)
        if "a" <= character <= "z":
            table[code] = code - 96
        elif 0xDF <= code <= 0xFF and character.isalpha():
            table[code] = 27 + code - 0xDF
        elif character.isalpha():
            table[code] = _SYMBOLS - 1
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """The symbols of a text in lower case, runs of word ends as one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.full(len(codes), _SYMBOLS - 1, np.uint8)
    known = codes < 0x250
    found[known] = _TABLE[codes[known]]
    found = np.concatenate(([0], found, [0])).astype(np.int64)
    return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all whole texts of `docs`.

    Every task sums its own texts; at most one row for each trigram reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                s = symbols(value.as_py())
                if len(s) > 2:
                    code = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:]
                    if len(code) < 4096:
                        np.add.at(total, code, 1)
                    else:
                        total += np.bincount(code, minlength=len(total))
            release()
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(total[own])], ["trigram", "n"]
        )

    rows = docs.select(text_of(text)).mapInArrow(count, "trigram int, n long")
    table = np.zeros(_SYMBOLS**3, np.int64)
    for trigram, n in rows.groupBy("trigram").agg(F.sum("n")).collect():
        table[trigram] = n
    return table


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs in nats of each symbol after two others, smoothed by shorter contexts."""
    cube = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(np.float64)
    one = cube.sum((0, 1)) + 0.5
    one /= one.sum()
    two = cube.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (cube + 5 * two) / (cube.sum(2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


#: The symbols of the characters that have one of their own.
_KNOWN = {chr(code): int(_TABLE[code]) for code in range(0x250)}


def _symbol(character: str) -> int:
    known = _KNOWN.get(character)
    if known is not None:
        return known
    return _SYMBOLS - 1 if character.isalpha() else 0


def lattice(word: str, spaced: bool = False) -> list[list[tuple[float, str]]]:
    """For each run of equal characters of a word, what it may stand for and its cost.

    A blank as a choice is a word end, which is possible after each letter of a word
    that was written with blanks.
    """
    steps = []
    for character, run in groupby(word):
        length = len(list(run))
        if character in LEET:
            choices = [
                (REPLACED * min(length, 2) + (length > 1) * ADDED, letter * count)
                for letter in LEET[character]
                for count in ({1} if length == 1 else {1, 2})
            ]
            choices.append((DROPPED, ""))
        elif not character.isalpha():
            choices = [(IGNORED, ""), (ENDED, " ")]
        elif length == 1:
            choices = [(0.0, character)]
        elif length < RUN:
            choices = [(0.0, character * length), (DOUBLED, character)]
        else:
            choices = [(ADDED, character), (ADDED, character * 2), (DROPPED, character * 3)]
        if spaced:
            choices += [(cost + ADDED, text + " ") for cost, text in choices if text.strip()]
        steps.append(choices)
    return steps


def decode(word: str, costs: np.ndarray | list[float], spaced: bool = False) -> str:
    """The likeliest reading of a disguised word: the cheapest path of its lattice.

    A state is the last two symbols; the cheapest way to each is kept (ties: the
    reading that sorts first).  A list of costs has those of the model one after the other.
    """
    flat = costs if isinstance(costs, list) else costs.ravel().tolist()
    ways: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    links: list = []
    for step in lattice(word, spaced):
        after: dict[tuple[int, int], tuple[float, int, str]] = {}
        for (a, b), (cost, back) in ways.items():
            for price, text in step:
                x, y, sum_ = a, b, cost + price
                for character in text:
                    z = _symbol(character)
                    sum_ += flat[(x * _SYMBOLS + y) * _SYMBOLS + z]
                    x, y = y, z
                if (x, y) not in after or (sum_, text) < (after[x, y][0], after[x, y][2]):
                    after[x, y] = (sum_, back, text)
        ways = {}
        for state, (sum_, back, text) in after.items():
            links.append((back, text))
            ways[state] = (sum_, len(links) - 1)
    best = min(
        (sum_ + flat[(a * _SYMBOLS + b) * _SYMBOLS], back) for (a, b), (sum_, back) in ways.items()
    )
    out, at = [], best[1]
    while at != "":
        at, text = links[at]
        out.append(text)
    return "".join(reversed(out))


_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W_]){2,}(?![^\W_])")
#: Marks around a word: all but signs that stand for a letter there, and at its end all but
#: those that no sentence ends with.
_BEFORE = "".join(c for c in string.punctuation if c not in "@$|+!")
_AFTER = "".join(c for c in string.punctuation if c not in "@$")
_LEAD = re.compile(r"^(?:(?![@$€£|+!])[\W_])+")
_TAIL = re.compile(r"(?:(?![@$€£])[\W_])+$")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_TWICE = re.compile(r"(.)(?=\1)", re.DOTALL)


class Memory(dict):
    """Answers of a function; forgets those that were not asked for in a while.

    Holds at most two times `_SEEN` answers.
    """

    def __init__(self, find):
        self.find, self.old = find, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= _SEEN:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Restorer:
    """Restores words with a language model; remembers a bounded number of them.

    Every run of characters that holds a letter and a sign, or a letter that follows itself,
    goes through the lattice, and the cheapest path decides.  Very long runs are read in
    pieces of `LONGEST` characters, which bounds memory; no character is left out.
    """

    def __init__(self, costs: np.ndarray):
        self.costs = costs.ravel().tolist()
        self.seen = Memory(self.read)

    def word(self, raw: str) -> tuple[str, ...]:
        """The words that a run of non-blank characters, in lower case, stands for."""
        return self.seen[raw]

    def read(self, raw: str) -> tuple[str, ...]:
        return tuple(self._read(raw))

    def _read(self, raw: str) -> Iterable[str]:
        kept = raw.lstrip(_BEFORE).rstrip(_AFTER)
        if not kept.isalpha():
            kept = _TAIL.sub("", _LEAD.sub("", kept))
        if kept.isalpha():
            return [kept] if not _DOUBLE.search(kept) else self._letters(kept)
        parts = [w for w in re.split(r"[\W_]+", kept) if w]
        if not any(c.isalpha() for c in kept):
            return parts
        restored = [
            w
            for at in range(0, len(kept), LONGEST)
            for w in re.split(r"[\W_]+", decode(kept[at : at + LONGEST], self.costs))
            if w
        ]
        if any(not c.isalpha() and c not in LEET for c in kept):
            # A mark may join two words or hide in one, so both readings count.
            restored += [part for part in parts if part not in restored]
        return restored

    def _letters(self, word: str) -> list[str]:
        """A word of letters of which some follow themselves."""
        doubles = [m.start() + 1 for m in _TWICE.finditer(word)]
        if len(doubles) > 1:
            return [
                w for at in range(0, len(word), LONGEST) for w in decode(word[at : at + LONGEST], self.costs).split()
            ]
        # One double: the trigrams that differ are those of the two letters before or after it.
        at = doubles[0]
        before = _symbol(word[at - 2]) if at > 1 else 0
        own = _symbol(word[at])
        after = _symbol(word[at + 1]) if at + 1 < len(word) else 0
        costs, row = self.costs, (before * _SYMBOLS + own) * _SYMBOLS
        twice = costs[row + own] + costs[(own * _SYMBOLS + own) * _SYMBOLS + after]
        return [word] if twice <= costs[row + after] + DOUBLED else [word[:at] + word[at + 1 :]]

    def words(self, text: str) -> Counter:
        """Restored words of a whole text, with the number of times each occurs."""
        lower = text.lower()
        total: Counter = Counter()
        for raw, n in Counter(lower.split()).items():
            for word in self.seen[raw]:
                total[word] += n
        total.update(self.spaced(lower))
        return total

    def spaced(self, lower: str) -> Iterator[str]:
        """Words that are written with a blank or mark between their letters."""
        for found in _SPACED.finditer(lower):
            yield from decode(found.group()[::2], self.costs, spaced=True).split()


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if k <= len(word))]


@dataclass
class Model:
    """Weights of the features, of the text's length, and the bias."""

    costs: np.ndarray
    weights: dict[str, float]
    length_weight: float
    bias: float


class Scorer:
    """Scores texts by a model; remembers what runs of characters come to."""

    def __init__(self, model: Model):
        self.model, self.restorer = model, Restorer(model.costs)
        self.heads = {feature[1 : 1 + PREFIXES[0]] for feature in model.weights}
        self.seen = Memory(lambda raw: self.worth(self.restorer.read(raw)))

    def worth(self, words: Iterable[str]) -> tuple[int, tuple[str, ...]]:
        """The number of words and those of their features that have a weight."""
        words, known = list(words), self.model.weights
        able = [w for w in words if w[: PREFIXES[0]] in self.heads]
        return len(words), tuple(f for w in able for f in features_of(w) if f in known)

    def score(self, text: str) -> float:
        """Chance that a text is toxic."""
        lower = text.lower()
        counts: dict[str, int] = {}
        total = 0
        for raw, n in Counter(lower.split()).items():
            words, own = self.seen[raw]
            total += words * n
            for feature in own:
                counts[feature] = counts.get(feature, 0) + n
        words, own = self.worth(self.restorer.spaced(lower))
        total += words
        for feature in own:
            counts[feature] = counts.get(feature, 0) + 1
        model = self.model
        value = model.bias + model.length_weight * math.log1p(total)
        value += sum(model.weights[f] * math.log1p(n) for f, n in sorted(counts.items()))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, value))))


def sampled(labels: DataFrame, rows: int, id_column: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One label per id (1 if any row says so), for about `rows` ids chosen by hash."""
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    one = known.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    count = one.count()
    if count <= rows:
        return one
    part = int(rows / count * (1 << 30))
    return one.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    most_features: int = FEATURES,
) -> Model:
    """Count the language model over all `docs` and fit the classifier on labelled ones.

    The classifier reads about `sample_rows` labelled documents, and keeps the
    `most_features` features whose presence tells the labels apart best.
    Without labels of both kinds every score is the rate of the labels (0 if none).
    """
    costs = language_model(trigram_counts(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(costs)  # 64 ** 3 numbers
    chosen = sampled(labels, sample_rows, id_column, label)
    rows = docs.select(F.col(id_column).alias("id"), text_of(text).alias("text")).join(chosen, "id")

    @F.arrow_udf("struct<words:array<string>,counts:array<int>>")
    def restored(texts: pa.Array) -> pa.Array:
        restorer = Restorer(shared.value)
        found = [restorer.words(t.as_py()) for t in texts]
        return pa.array(
            [{"words": [*own], "counts": [*own.values()]} for own in found],
            pa.struct([("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]),
        )

    table = saved(
        rows.select("label", F.xxhash64("text").alias("order"), restored("text").alias("x")),
        "toxic-sample",
    )
    count, toxic = table.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not count or not toxic or toxic == count:
        rate = (toxic / count) if count else 0.0
        return Model(costs, {}, 0.0, math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))

    @F.arrow_udf("array<string>")
    def present(words: pa.Array) -> pa.Array:
        return pa.array(
            [sorted({f for w in own.as_py() for f in features_of(w)}) for own in words],
            pa.list_(pa.string()),
        )

    seen = (
        table.select("label", F.explode(present("x.words")).alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("n"), F.sum("label").alias("k"))
        .filter(F.col("n") >= LEAST_ROWS)
    )
    rate = toxic / count
    strength = F.abs(F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    order = seen.orderBy(strength.desc(), "feature").select("feature")
    best = [row[0] for row in order.limit(most_features).collect()]
    place = {feature: i for i, feature in enumerate(best)}

    @F.arrow_udf("struct<total:long,places:array<int>,counts:array<int>>")
    def narrowed(words: pa.Array, counts: pa.Array) -> pa.Array:
        found = []
        for own, numbers in zip(words, counts):
            own, numbers = own.as_py(), numbers.as_py()
            kept: Counter = Counter()
            for word, n in zip(own, numbers):
                for feature in features_of(word):
                    if feature in place:
                        kept[place[feature]] += n
            found.append({"total": sum(numbers), "places": [*kept], "counts": [*kept.values()]})
        kind = [("total", pa.int64()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
        return pa.array(found, pa.struct(kind))

    slim = table.select("label", "order", narrowed("x.words", "x.counts").alias("x"))
    held = slim.select("label", "order", "x.*").orderBy("order", "label", "total").toArrow()
    x = np.zeros((held.num_rows, len(best) + 1), np.float32)
    y = held.column("label").to_numpy().astype(np.float32)
    x[:, -1] = np.log1p(held.column("total").to_numpy())
    places = held.column("places").combine_chunks()
    rows_of = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
    x[rows_of, places.flatten().to_numpy()] = np.log1p(
        held.column("counts").combine_chunks().flatten().to_numpy()
    )
    weights, bias = fit(x, y)
    return Model(costs, {f: float(weights[i]) for f, i in place.items() if weights[i]}, float(weights[-1]), float(bias))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty, by accelerated gradient steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    z = np.concatenate([z, np.ones((len(z), 1), np.float32)], 1)
    v = np.random.default_rng(0).normal(size=z.shape[1]).astype(np.float32)
    for _ in range(20):  # largest eigenvalue, for the step
        v = z.T @ (z @ v)
        norm = float(np.linalg.norm(v))
        v /= norm
    step = 1 / (0.25 * norm / len(z) + penalty)
    w = np.zeros(z.shape[1], np.float32)
    ahead, turn = w.copy(), 1.0
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(z @ ahead, -60, 60)))
        gradient = z.T @ (chance - y) / len(z) + penalty * ahead
        gradient[-1] -= penalty * ahead[-1]
        new = ahead - step * gradient
        next_turn = (1 + math.sqrt(1 + 4 * turn * turn)) / 2
        ahead = new + (turn - 1) / next_turn * (new - w)
        w, turn = new, next_turn
    weights = w[:-1] / scale
    return weights, float(w[-1] - (weights * mean).sum())


def scores(docs: DataFrame, model: Model, text: str | Column = "text") -> Column:
    """Column with the score of each whole text; null and empty texts have one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as `train` says
    held: list = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(shared.value))
        found = [held[0].score(t.as_py()) for t in texts]
        release()
        return pa.array(found, pa.float64())

    return score(text_of(text))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the labels of a row are kept out of the training, by its id alone."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def scored(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: `doc_id, held_out, score, predicted`.

    Labels of ids whose CRC-32 has remainder 2 by 4 are held out of the training.
    Rows without an id are not held out and train nothing.  Repeated rows get a row
    each.  An empty table gives an empty result.
    """
    out = held_out(id_column)
    model = train(docs, labels.filter(~out), id_column, text)
    return docs.select(
        F.col(id_column).alias("doc_id"), out.alias("held_out"), scores(docs, model, text).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of `docs` with a score below the threshold, with all their columns."""
    model = train(docs, labels, id_column, text)
    return docs.filter(scores(docs, model, text) < threshold)
