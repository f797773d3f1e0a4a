"""Ranked lexical search over per-term blocks with coordinatewise-maximum summaries.

An index row is one document: its terms and how often it holds them.  Tasks read the
rows in segments of bounded size.  In a segment each term's posting list is clustered
by document similarity into blocks; a block's summary is the greatest impact of each
term among its documents, rounded up to eight bits.  The weighted sum of a summary over
an item's terms bounds the score of every document in the block.  Blocks of the item's
lists are opened by falling bound, and the rest is skipped once the bound is below the
score that the last wanted rank has reached; a bound that equals it is still opened, as
ties go by id.  So the result is exact, whatever the clusters are.

Lists and summaries cover the terms of one block of items.  Over the whole vocabulary
they would hold the square of a document's terms for each document, and coordinates
outside of the items' terms can't enter any bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import release, saved, text_of

#: Terms, and the only letters that are lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Documents that an item gets.
RANKS = 50
#: Items that are searched for at once.
ITEMS = 256
#: Documents of a block, numbers of a document's sketch, and most cells of a segment's
#: table of documents by terms; a segment has at least `_LEAST` documents.
BLOCK, SKETCH, CELLS, _LEAST = 64, 32, 1 << 23, 16
#: Bytes of summaries in a segment; blocks beyond them have none and are always opened.
SUMMARY_BYTES = 1 << 26
#: Greatest impact, and one step of a summary.
_MOST_IMPACT = 1_000_000
STEP = -(-_MOST_IMPACT // 255)
#: Characters of a text above which terms are counted without a list of them.
_LONG = 1 << 20
#: Parts that an item's candidates are ranked in before they are ranked together.
_FIRST_RANK = 16


def counted(text: str) -> Counter:
    """How often a text holds each term."""
    text = text.translate(_LOWER)
    if len(text) > _LONG:
        return Counter(found.group() for found in TERM.finditer(text))
    return Counter(TERM.findall(text))


def term_counts(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """`id, n, terms, counts` for each row whose whole text has a term."""
    chosen = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_of(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [counted(t.as_py()) for t in part.column("text")]
                own = [i for i, c in enumerate(found) if c]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(own, pa.int64())),
                        pa.array([sum(found[i].values()) for i in own], pa.int64()),
                        pa.array([list(found[i]) for i in own], pa.list_(pa.string())),
                        pa.array([list(found[i].values()) for i in own], pa.list_(pa.int32())),
                    ],
                    ["id", "n", "terms", "counts"],
                )
            release()

    return chosen.mapInArrow(count, "id long, n long, terms array<string>, counts array<int>")


def index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index: one row per document that has a term."""
    return saved(term_counts(docs, id_column, text), "search-index", compression="zstd")


def _known(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term number and count of each posting whose term is in the vocabulary."""
    terms, counts = batch.column("terms"), batch.column("counts")
    numbers = pc.index_in(terms.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
    document = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy())
    own = numbers >= 0
    return document[own], numbers[own], counts.flatten().to_numpy()[own].astype(np.int64)


def document_counts(rows: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each of the terms; one row per term comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64)
        for batch in batches:
            found += np.bincount(_known(batch, vocabulary)[1], minlength=len(terms))
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found[own])], ["term", "n"])

    partial = rows.select("terms", "counts").mapInArrow(count, "term long, n long")
    totals = partial.groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r["term"]]: r["n"] for r in totals}


@dataclass
class Best:
    """The best documents of one item so far, best first."""

    ranks: int
    score: np.ndarray
    document: np.ndarray
    unnamed: np.ndarray

    @classmethod
    def none(cls, ranks: int) -> Best:
        return cls(ranks, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    @property
    def needed(self) -> int:
        """The score that a further document must reach."""
        return int(self.score[-1]) if len(self.score) == self.ranks else 1

    def add(self, score: np.ndarray, document: np.ndarray, unnamed: np.ndarray) -> None:
        own = score >= self.needed
        if own.any():
            score = np.concatenate([self.score, score[own]])
            document = np.concatenate([self.document, document[own]])
            unnamed = np.concatenate([self.unnamed, unnamed[own]])
            order = np.lexsort((document, unnamed, -score))[: self.ranks]
            self.score, self.document, self.unnamed = score[order], document[order], unnamed[order]


class Segment:
    """Documents of a segment, their impacts, and the blocks of each term's list."""

    def __init__(self, ids, unnamed, document, term, impact, width: int, block: int = BLOCK):
        self.ids, self.unnamed = ids, unnamed
        self.impacts = np.zeros((len(ids), width), np.int32)
        self.impacts[document, term] = impact
        coarse = (-(-self.impacts // STEP)).astype(np.uint8)
        sketch = self._sketch(coarse)
        order = np.argsort(term, kind="stable")
        present, starts = np.unique(term[order], return_index=True)
        self.members: list[np.ndarray] = []
        self.blocks: dict[int, np.ndarray] = {}
        for number, own in zip(present.tolist(), np.split(document[order], starts[1:])):
            cut = self._clustered(own, sketch, block)
            self.blocks[number] = np.arange(len(self.members), len(self.members) + len(cut))
            self.members += cut
        largest = np.argsort([-len(m) for m in self.members], kind="stable")
        with_summary = largest[: SUMMARY_BYTES // max(1, width)]
        self.place = np.full(len(self.members), -1)
        self.place[with_summary] = np.arange(len(with_summary))
        self.summary = np.zeros((len(with_summary), width), np.uint8)
        for place, one in enumerate(with_summary.tolist()):
            coarse[self.members[one]].max(axis=0, out=self.summary[place])

    @staticmethod
    def _sketch(coarse: np.ndarray) -> np.ndarray:
        """Random projections of the documents, of length one, for their similarity."""
        signs = np.random.default_rng(12).choice(np.float32([-1, 1]), (coarse.shape[1], SKETCH))
        found = np.empty((len(coarse), SKETCH), np.float32)
        for at in range(0, len(coarse), 256):
            found[at : at + 256] = coarse[at : at + 256].astype(np.float32) @ signs
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _clustered(own: np.ndarray, sketch: np.ndarray, block: int) -> list[np.ndarray]:
        """A list cut into blocks: each document goes to the most similar of spread-out ones."""
        if len(own) <= block:
            return [own]
        centres = own[:: block]
        nearest = np.argmax(sketch[own] @ sketch[centres].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        groups = np.split(own[order], np.flatnonzero(np.diff(nearest[order])) + 1)
        return [g[at : at + block] for g in groups for at in range(0, len(g), block)]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> tuple[int, int]:
        """Put the segment's documents among the best; blocks opened and blocks in all."""
        lists = [self.blocks[t] for t in terms.tolist() if t in self.blocks]
        if not lists:
            return 0, 0
        blocks = np.concatenate(lists)
        place = self.place[blocks]
        bounds = np.full(len(blocks), np.iinfo(np.int64).max)
        own = place >= 0
        bounds[own] = self.summary[np.ix_(place[own], terms)].astype(np.int64) @ weights * STEP
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        seen, at, step = np.zeros(len(self.ids), bool), 0, 1
        while at < len(blocks) and bounds[at] >= best.needed:
            until = at + int(np.count_nonzero(bounds[at : at + step] >= best.needed))
            found = np.unique(np.concatenate([self.members[b] for b in blocks[at:until].tolist()]))
            found = found[~seen[found]]
            seen[found] = True
            score = self.impacts[np.ix_(found, terms)].astype(np.int64) @ weights
            best.add(score, self.ids[found], self.unnamed[found])
            at, step = until, min(2 * step, 64)
        return at, len(blocks)


def _segments(batches, vocabulary: pa.Array, documents: int, words: int, size: int) -> Iterator[Segment]:
    """Segments of at most `size` documents that hold a term of the vocabulary."""
    held, count = [], 0

    def built():
        ids, unnamed, lengths, document, term, tf = (np.concatenate(x) for x in zip(*held))
        m = 50 + (50 * lengths * documents) // words
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[document])
        return Segment(ids, unnamed, document, term, impact, len(vocabulary))

    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            document, term, tf = _known(part, vocabulary)
            own, document = np.unique(document, return_inverse=True)
            if not len(own):
                continue
            if count + len(own) > size:
                yield built()
                held, count = [], 0
            ids = part.column("id").take(pa.array(own))
            held.append(
                (
                    ids.fill_null(0).to_numpy(),
                    ids.is_null().to_numpy(zero_copy_only=False),
                    part.column("n").to_numpy()[own],
                    document + count,
                    term,
                    tf,
                )
            )
            count += len(own)
        release()
    if held:
        yield built()


def _item_blocks(items: DataFrame, id_column: str, text: str, size: int) -> Iterator[list[tuple]]:
    """Items with a term, `size` at a time: (id, terms)."""
    block: list[tuple] = []
    for row in term_counts(items, id_column, text).select("id", "terms").toLocalIterator():
        block.append((row["id"], row["terms"]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(
    rows: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    ranks: int = RANKS,
    items_at_once: int = ITEMS,
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the best documents of `index` rows for each item.

    A document's score is the sum, over the item's terms, of a term's weight times its
    impact in the document, all in whole numbers.  Only scores above 0 count.  Equal
    scores go by ascending id, documents without an id last; repeated rows are documents
    of their own, and so are repeated items.  Items and documents without a term, null
    texts among them, have no rows.  An empty table gives an empty result.

    Items are searched for in blocks of `items_at_once`, each over all rows of the index;
    the driver and every task hold the terms of one block.  A segment has as many
    documents as its table of documents by terms allows.  A task sends its best
    documents of each item, so a shuffle has `ranks` rows an item and task.
    """
    spark = rows.sparkSession
    kind = "item_id long, rank int, doc_id long, score long"
    documents, words = rows.agg(F.count("*"), F.sum("n")).first()
    result = None
    for block in _item_blocks(items, item_id, item_text, items_at_once) if documents else ():
        found = saved(_found(rows, block, int(documents), int(words), ranks), "search-found")
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], kind) if result is None else result


def _found(rows: DataFrame, block: list[tuple], documents: int, words: int, ranks: int) -> DataFrame:
    spark = rows.sparkSession
    holding = document_counts(rows, sorted({t for _, terms in block for t in terms}))
    vocabulary = sorted(holding)
    number = {term: i for i, term in enumerate(vocabulary)}
    weights = np.array([weight(documents, holding[t]) for t in vocabulary], np.int64)
    queries = [np.array(sorted(number[t] for t in terms if t in number), np.int64) for _, terms in block]
    size = max(_LEAST, CELLS // max(1, len(vocabulary)))

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best.none(ranks) for _ in queries]
        for segment in _segments(batches, pa.array(vocabulary, pa.string()), documents, words, size):
            for own, terms in zip(best, queries):
                segment.search(terms, weights[terms], own)
        part = TaskContext.get().partitionId() % _FIRST_RANK
        for item, own in enumerate(best):
            count = len(own.score)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(count, item, np.int32)),
                    pa.array(np.full(count, part, np.int32)),
                    pa.array(own.document, mask=own.unnamed),
                    pa.array(own.score),
                ],
                ["item", "part", "doc_id", "score"],
            )

    candidates = rows.mapInArrow(best_of_task, "item int, part int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("item", "part").orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    names = spark.createDataFrame([(i, one[0]) for i, one in enumerate(block)], "item int, item_id long")
    return (
        candidates.withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= ranks)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= ranks)
        .join(names, "item")
        .select("item_id", "rank", "doc_id", "score")
    )
