"""Benchmark decontamination by greedy string tiling.

Rolling (Karp-Rabin) hashes of `min_match` words are the seeds.  Documents and
benchmark items are joined on shared seeds; of each pair the longest match that
overlaps no earlier one is marked again and again, and the part of the item's words
that is marked decides.  Tiles may lie in any order, so reordered passages count.

All places of a seed in a text travel as one row, so a seed that both sides repeat
joins to one row and not to the product of its places.  A pair is a candidate only if
the document holds one of the item's rarest seeds: so many are rarest that a document
without any of them cannot reach the coverage.  Runs that many documents and items
share therefore bring no pair together by themselves.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, release, row_key, saved, split_mix, text_of

#: Least words of a tile, and part of an item's words that makes a document dirty.
MIN_MATCH, COVERAGE = 5, 0.5
#: Bits of the seed filter that tasks hold: 512 KB, whatever the benchmark's size.
FILTER_BITS = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes whose words are hashed at once, which take some 40 times as much memory.
_CHUNK = 1 << 17


_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """Powers of `base`, kept for the usual size of a chunk."""
    if count > _CHUNK:
        return np.cumprod(np.append(np.uint64(1), np.full(count - 1, base, np.uint64)), dtype=np.uint64)
    if base not in _TABLES:
        steps = np.append(np.uint64(1), np.full(_CHUNK - 1, base, np.uint64))
        _TABLES[base] = np.cumprod(steps, dtype=np.uint64)
    return _TABLES[base][:count]


_WORD_BYTE = np.array(
    [b >= 128 or chr(b).isalnum() for b in range(256)], bool
)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of an UTF-8 text in lower case.

    A word is a run of ASCII letters and digits and of any other characters.  Its
    hash is a polynomial in its bytes, from prefix sums, mixed once.
    """
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], _WORD_BYTE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    with np.errstate(over="ignore"):
        terms = (raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw))
        sums = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
        hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts]
    return split_mix(hashes), starts


_NO_WORD_BYTE = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def long_word_hashes(text: bytes) -> np.ndarray:
    """`word_hashes` of a text of any length, piece by piece; no piece cuts a word."""
    found, at = [], 0
    while at < len(text):
        to = min(at + _CHUNK, len(text))
        if to < len(text):
            gaps = np.flatnonzero(~_WORD_BYTE[np.frombuffer(text, np.uint8, to - at, at)])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                gap = _NO_WORD_BYTE.search(text, to)
                to = gap.end() if gap else len(text)
        found.append(word_hashes(text[at:to])[0])
        at = to
    return np.concatenate([*found, np.empty(0, np.uint64)])


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    count = len(hashes) - size + 1
    if count < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        value = np.zeros(count, np.uint64)
        for i in range(size):
            value = value * np.uint64(_BASE) + hashes[i : i + count]
    return split_mix(value)


def seeds_of(texts: Iterable[str], size: int) -> Iterator[np.ndarray]:
    """The rolling hashes of each text; short texts are hashed together, long ones in pieces.

    Besides the text at hand no more than a chunk is held.
    """

    def of_group(group: list[bytes]) -> Iterator[np.ndarray]:
        hashes, starts = word_hashes(b" ".join(group))
        offsets = np.cumsum([0] + [len(t) + 1 for t in group])
        cuts = np.searchsorted(starts, offsets)
        for i in range(len(group)):
            yield rolling(hashes[cuts[i] : cuts[i + 1]], size)

    group: list[bytes] = []
    total = 0
    for text in texts:
        lowered = text.lower().encode()
        if total + len(lowered) >= _CHUNK:
            yield from of_group(group)
            group, total = [], 0
        if len(lowered) >= _CHUNK:
            yield rolling(long_word_hashes(lowered), size)
        else:
            group.append(lowered)
            total += len(lowered) + 1
    yield from of_group(group)


def places_by_seed(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct seeds, the number of places of each, and all places in that order."""
    order = np.argsort(hashes, kind="stable")
    seeds, counts = np.unique(hashes[order], return_counts=True)
    return seeds, counts, places[order]


def seed_rows(batch: pa.RecordBatch, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The columns of `batch` but for `text`, with a row for each seed and its places.

    `found` gives a row's number, its hashes and their places.
    """
    rows, seeds, counts, places = [], [], [], []
    for row, hashes, at in found:
        own, times, where = places_by_seed(hashes, at)
        rows.append(np.full(len(own), row))
        seeds.append(own)
        counts.append(times)
        places.append(where)
    take = pa.array(np.concatenate([*rows, np.empty(0)]).astype(np.int64))
    ends = np.cumsum(np.concatenate([[0], *counts]).astype(np.int64))
    kept = [n for n in batch.schema.names if n != "text"]
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(n).take(take) for n in kept),
            pa.array(np.concatenate([*seeds, np.empty(0, np.uint64)]).view(np.int64)),
            pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)),
                pa.array(np.concatenate([*places, np.empty(0)]).astype(np.int32)),
            ),
        ],
        [*kept, "seed", "places"],
    )


def benchmark_seeds(
    benchmark: DataFrame, id_column: str = "item_id", text: str = "text", size: int = MIN_MATCH
) -> DataFrame:
    """`(item, item_id, seed, places)`: every run of `size` words of every item.

    `item` is the key of an id with its text.
    """

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = seeds_of((t.as_py() for t in batch.column("text")), size)
            yield seed_rows(batch, ((n, x, np.arange(len(x))) for n, x in enumerate(texts)))

    items = benchmark.select(
        F.substring(row_key(id_column, text), 1, 32).alias("item"),
        F.col(id_column).alias("item_id"),
        text_of(text).alias("text"),
    ).dropDuplicates(["item"])
    kind = f"item string, item_id {items.schema['item_id'].dataType.simpleString()}, seed long, places array<int>"
    return saved(items.mapInArrow(of_items, kind), "tiling-seeds")


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit map of the seeds; at most `bits / 64` rows reach the driver."""
    place = F.pmod("seed", F.lit(bits))
    words = seeds.groupBy(F.floor(place / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")
    )
    held = np.zeros(bits // 64, np.uint64)
    for word, value in words.collect():
        held[word] = value & 0xFFFFFFFFFFFFFFFF
    return held


def tiles(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one document and item: `(words, document place, item place)`.

    `pairs` are the places of equal runs of `size` words.  Runs along a diagonal are
    maximal matches; `tiles_of_runs` has the rest.
    """
    runs = []
    diagonals: dict[int, list[int]] = {}
    for a, b in set(pairs):
        diagonals.setdefault(a - b, []).append(a)
    for shift, places in diagonals.items():
        places.sort()
        first = last = places[0]
        for place in [*places[1:], None]:
            if place is None or place != last + 1:
                runs.append((last - first + size, first, first - shift))
                first = place
            last = place
    return tiles_of_runs(runs, size)


def tiles_of_runs(runs: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from maximal matches: `(words, document place, item place)`.

    The longest goes first (ties: first in the document, then in the item); what
    earlier tiles cover is cut off, and rests of `size` words or more wait for their
    turn.
    """
    queue = [(-words, a, b) for words, a, b in runs]
    heapq.heapify(queue)
    used_a: set[int] = set()
    used_b: set[int] = set()
    found = []
    while queue:
        words, a, b = heapq.heappop(queue)
        words = -words
        free = [a + i not in used_a and b + i not in used_b for i in range(words)]
        if all(free):
            found.append((words, a, b))
            used_a.update(range(a, a + words))
            used_b.update(range(b, b + words))
            continue
        start = None
        for i, open_ in enumerate([*free, False]):
            if open_ and start is None:
                start = i
            elif not open_ and start is not None:
                if i - start >= size:
                    heapq.heappush(queue, (start - i, a + start, b + start))
                start = None
    return found


def seed_runs(joined: DataFrame, size: int) -> DataFrame:
    """Maximal matches `(key, item_id, item_words, doc_id, words, place, at)` of seeds.

    Seeds on a diagonal whose places follow each other are one run, so that a run that
    both sides repeat gives a row per diagonal and not one per pair of places.  Rows
    that repeat a seed's places count once.
    """
    pair = ("key", "item_id", "item_words")
    shifted = joined.withColumn("shift", F.col("place") - F.col("at"))
    along = Window.partitionBy(*pair, "shift").orderBy("place")
    return (
        shifted.withColumn("run", F.col("place") - F.dense_rank().over(along))
        .groupBy(*pair, "shift", "run")
        .agg(
            F.first("doc_id").alias("doc_id"),
            (F.max("place") - F.min("place") + size).cast("int").alias("words"),
            F.min("place").alias("place"),
            F.min("at").alias("at"),
        )
    )


def longest_match(a_codes: np.ndarray, a_at: np.ndarray, b_codes: np.ndarray, b_at: np.ndarray, most: int):
    """Length in seeds, and starts on both sides, of the longest runs that hash alike.

    Karp-Rabin: hashes of all runs of one length come from prefix sums, and halving
    finds the greatest length at which both sides share one.
    """
    with np.errstate(over="ignore"):
        sums = [
            np.append(np.uint64(0), np.cumsum(x * _powers(_BASE, len(x)), dtype=np.uint64)) for x in (a_codes, b_codes)
        ]

    def of_length(n: int) -> tuple[np.ndarray, ...]:
        starts, hashes = [], []
        for total, at in zip(sums, (a_at, b_at), strict=True):
            first = np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] == n - 1)
            with np.errstate(over="ignore"):
                hashes.append((total[first + n] - total[first]) * _powers(_INVERSE, len(at))[first])
            starts.append(first)
        alike = np.isin(hashes[0], hashes[1])
        return starts[0][alike], hashes[0][alike], starts[1], hashes[1]

    low, high, best = 0, min(most, len(a_at), len(b_at)), None
    while low < high:
        middle = (low + high + 1) // 2
        found = of_length(middle)
        if len(found[0]):
            low, best = middle, found
        else:
            high = middle - 1
    return low, best


def tiles_of_places(shared: list[tuple[int, np.ndarray, np.ndarray]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one document and item: `(words, document place, item place)`.

    `shared` has each common seed with its places in the document and in the item.
    The longest match goes first (ties: first in the document, then in the item), and
    seeds that touch a marked word are taken out.  What is held grows with the places of
    both sides, never with their product; there are as many rounds as tiles of different
    lengths.
    """
    sides = []
    for side in (1, 2):
        at = np.concatenate([np.empty(0, np.int64), *(row[side] for row in shared)]).astype(np.int64)
        codes = np.repeat(
            np.array([row[0] for row in shared], np.int64).view(np.uint64), [len(row[side]) for row in shared]
        )
        order = np.argsort(at)
        sides.append((codes[order], at[order]))
    (a_codes, a_at), (b_codes, b_at) = sides
    found, most = [], len(b_at)
    while True:
        seeds, alike = longest_match(a_codes, a_at, b_codes, b_at, most)
        if not seeds:
            return found
        a_starts, a_hashes, b_starts, b_hashes = alike
        order = np.argsort(b_hashes, kind="stable")
        b_hashes, b_starts = b_hashes[order], b_starts[order]
        heads = dict(zip(a_hashes.tolist(), np.searchsorted(b_hashes, a_hashes).tolist(), strict=True))
        ends = dict(zip(a_hashes.tolist(), np.searchsorted(b_hashes, a_hashes, "right").tolist(), strict=True))
        a_gone, b_gone = np.zeros(len(a_at), bool), np.zeros(len(b_at), bool)
        words, free_from = seeds + size - 1, 0
        for i, value in zip(a_starts.tolist(), a_hashes.tolist(), strict=True):
            if i < free_from or value not in heads:
                continue
            while heads[value] < ends[value] and b_gone[(j := b_starts[heads[value]]) : j + seeds].any():
                heads[value] += 1
            if heads[value] == ends[value]:
                del heads[value]
                if not heads:
                    break
                continue
            if not np.array_equal(a_codes[i : i + seeds], b_codes[j : j + seeds]):
                continue
            place, at = int(a_at[i]), int(b_at[j])
            found.append((words, place, at))
            free_from = int(np.searchsorted(a_at, place + words))
            a_gone[np.searchsorted(a_at, place - size + 1) : free_from] = True
            b_gone[np.searchsorted(b_at, at - size + 1) : np.searchsorted(b_at, at + words)] = True
        a_codes, a_at, b_codes, b_at = a_codes[~a_gone], a_at[~a_gone], b_codes[~b_gone], b_at[~b_gone]
        most = seeds - 1


def rare_seeds(hits: DataFrame, seeds: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """`(seed, item)`: the seeds of each item one of which a matching document must hold.

    A word that is covered lies in a tile, and a tile of k words has k - min_match + 1
    seeds, which is k / min_match or more.  So a match holds at least `coverage *
    item_words / min_match` of the item's places, and leaves out fewer than all of
    those that are left when one less than that is set aside.  The most frequent ones
    are set aside.
    """
    held = hits.groupBy("seed").agg(F.count("*").alias("held"))
    rarest_first = Window.partitionBy("item").orderBy("held", "seed")
    places = F.size("places")
    ranked = (
        seeds.join(held, "seed", "left")
        .withColumn("held", F.coalesce("held", F.lit(0)))
        .withColumn("before", F.sum(places).over(rarest_first.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("all", F.sum(places).over(Window.partitionBy("item")))
    )
    least = F.ceil(coverage * (F.col("all") + min_match - 1) / min_match - 1e-9)
    return ranked.filter(
        (F.col("held") > 0) & (F.coalesce("before", F.lit(0)) <= F.col("all") - F.greatest(least, F.lit(1)))
    ).select("seed", "item")


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Documents and the items they hold, one row per pair that reaches the coverage.

    Columns `key, doc_id, item_id, item_words, covered, coverage, tiles` (each tile
    as words, place in the document, place in the item).  Whole texts are searched.
    Null and empty texts, and items of fewer than `min_match` words, match nothing.
    Rows that repeat an id and text are one document; an item that repeats an id and
    text is one item, and rows that give one id several texts are judged as one item
    per text.  Extra columns are not read.  Very long texts are hashed in pieces;
    a task holds one text, 8 bytes per word, and the places of the seeds of one pair.
    """
    seeds = benchmark_seeds(benchmark, item_id, item_text, min_match)
    held = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value

        def found(texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for row, hashes in enumerate(seeds_of(texts, min_match)):
                bit = hashes & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero((known[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    yield row, hashes[hit], hit

        for batch in batches:
            yield seed_rows(batch, found(t.as_py() for t in batch.column("text")))
            release()

    rows = docs.select(
        F.substring(row_key(id_column, text), 1, 32).alias("key"),
        F.col(id_column).alias("doc_id"),
        text_of(text).alias("text"),
    )
    kind = f"key string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, seed long, places array<int>"
    hits = saved(rows.mapInArrow(seeded, kind), "tiling-hits")

    @F.arrow_udf("array<struct<words:int,place:int,at:int>>")
    def tiled(shared: pa.Array) -> pa.Array:
        return pa.array(
            [
                [
                    {"words": w, "place": a, "at": b}
                    for w, a, b in tiles_of_places([(r["seed"], r["places"], r["at"]) for r in own], min_match)
                ]
                for own in (x.as_py() for x in shared)
            ],
            pa.list_(pa.struct([("words", pa.int32()), ("place", pa.int32()), ("at", pa.int32())])),
        )

    lengths = seeds.groupBy("item").agg(
        F.first("item_id").alias("item_id"), (F.sum(F.size("places")) + min_match - 1).alias("item_words")
    )
    candidates = (
        hits.join(rare_seeds(hits, seeds, min_match, coverage), "seed").select("key", "item").distinct()
    )
    wanted = candidates.join(seeds.select("item", "seed", F.col("places").alias("at")), "item")
    grouped = (
        hits.join(wanted, ["key", "seed"])
        .groupBy("key", "item")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.collect_set(F.struct("seed", "places", "at")).alias("shared"),
        )
    )
    found = grouped.withColumn("tiles", tiled("shared")).drop("shared").join(lengths, "item").withColumn(
        "covered", F.aggregate("tiles", F.lit(0), lambda sum_, tile: sum_ + tile["words"])
    )
    return found.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(
        F.col("coverage") >= coverage
    ).select("key", "doc_id", "item_id", "item_words", "covered", "coverage", "tiles")


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns."""
    key = free_name(docs, "row_key")
    dirty = saved(
        matches(docs, benchmark, id_column, text, **options).select(F.col("key").alias(key)).distinct(),
        "tiling-dirty",
    )
    keyed = docs.withColumn(key, F.substring(row_key(id_column, text), 1, 32))
    return keyed.join(dirty, key, "left_anti").drop(key)
