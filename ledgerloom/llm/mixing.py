"""Mixing of sources to target weights in fixed-length blocks.

Words of a source are packed end to end into blocks.  Each output shard draws how
many of its slots every source gets; a slot's index within its source runs through
pseudorandom permutations of the source's blocks, one permutation a pass; slots
and blocks are joined by `(source, block)`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, release, saved, split_mix, text_of

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a part of all words, and most times that a source is used.
SHARE, REPEATS = (3, 2), 2
#: Words of a block and slots of an output shard.
BLOCK_WORDS, SHARD_SLOTS = 128, 16384
SEED = 20


@dataclass(frozen=True)
class Quota:
    """What one source gives: its order, words, blocks, target and slots."""

    source: str | None
    index: int
    size: int
    blocks: int
    numerator: int
    denominator: int
    slots: int

    @property
    def target(self) -> float:
        return self.numerator / self.denominator


def quotas(
    sizes: list[tuple[str | None, int]],
    block_words: int = BLOCK_WORDS,
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    repeats: int = REPEATS,
) -> list[Quota]:
    """Targets by weight, with what exceeds `repeats` times a source dealt out again.

    Whole-number arithmetic, so that the targets do not depend on summation order.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    open_ = {i: weights[i % len(weights)] for i in range(len(order))}
    held: dict[int, tuple[int, int]] = {}
    left = share[0] * sum(size for _, size in order)
    while open_:
        total = sum(open_.values())
        full = [
            i for i, w in open_.items() if w * left > repeats * order[i][1] * share[1] * total
        ]
        if not full:
            held |= {i: (w * left, share[1] * total) for i, w in open_.items()}
            break
        for i in full:
            held[i] = (repeats * order[i][1], 1)
            left -= repeats * order[i][1] * share[1]
            del open_[i]
    found = []
    for i, (source, size) in enumerate(order):
        up, down = held[i]
        blocks = -(-size // block_words)
        slots = min(repeats * blocks, (2 * up * blocks + down * size) // (2 * down * size)) if size else 0
        found.append(Quota(source, i, size, blocks, up, down, slots))
    return found


@dataclass(frozen=True)
class Packed:
    """Documents with their places: `places` has no texts, `texts` is `row, text`."""

    places: DataFrame
    texts: DataFrame

    def collect(self) -> list:
        """All rows with their texts; for small tables."""
        return self.places.join(self.texts, "row").collect()


def packed(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source"
) -> Packed:
    """One row per document with its place on the word axis of its source.

    Places are `row, doc_id, source, size, task, start`.  The order of documents follows
    from hashes of their ids and texts, so it is the same however the rows are dealt over
    files and tasks; rows that agree in both may change places with each other.  Only
    these hashes and sizes are sorted, in ranges that cut a hot source into many tasks;
    the start is counted within such a range.  Both tables are written.
    """
    chosen = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        text_of(f"`{text}`").alias("text"),
        F.regexp_count(text_of(f"`{text}`"), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = saved(
        chosen.withColumns(
            {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit(SEED))}
        ),
        "mix-docs",
        compression="zstd",
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used = TaskContext.get().partitionId(), {}
        for batch in batches:
            count = batch.num_rows
            starts = np.zeros(count, np.int64)
            sources = batch.column("source").dictionary_encode()
            sizes = batch.column("size").to_numpy()
            codes = sources.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = sources.dictionary.to_pylist()
            for code in np.unique(codes).tolist():
                own, name = codes == code, names[code] if code >= 0 else None
                before = np.cumsum(sizes[own]) - sizes[own]
                starts[own] = before + used.get(name, 0)
                used[name] = used.get(name, 0) + int(sizes[own].sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(count, task, np.int32)), pa.array(starts)],
                [*batch.schema.names, "task", "start"],
            )

    order = ["source", "k1", "k2", "row"]
    slim = rows.drop("text").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, size long"
    places = slim.drop("k1", "k2").mapInArrow(place, f"{kind}, task int, start long")
    return Packed(saved(places, "mix-places"), rows.select("row", "text"))


def pieces(places: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The parts that blocks take of documents: `source, block, offset, row, doc_id, first, words`.

    The offset is the part's place in its block.
    """
    tasks = places.groupBy("source", "task").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = tasks.select(
        F.col("source").alias("base_source"),
        F.col("task").alias("base_task"),
        F.coalesce(F.sum("words").over(along), F.lit(0)).alias("base"),
    )
    placed = places.filter("size > 0").join(
        bases,
        F.col("source").eqNullSafe(F.col("base_source")) & (F.col("task") == F.col("base_task")),
    )
    at = F.col("base") + F.col("start")
    blocks = F.sequence(
        F.floor(at / block_words), F.floor((at + F.col("size") - 1) / block_words)
    )
    cut = placed.select(
        "source", "row", "doc_id", "size", at.alias("at"), F.explode(blocks).alias("block")
    )
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.select(
        "source",
        "block",
        (begin - F.col("block") * block_words).alias("offset"),
        "row",
        "doc_id",
        (begin - F.col("at")).alias("first"),
        (end - begin).alias("words"),
    )


def _with_text(used: DataFrame, texts: DataFrame) -> DataFrame:
    """Pieces with their words, joined by single blanks.

    The pieces of a document are listed first, so each text is moved and split once; a list
    has at most as many entries as the blocks of its document are used.
    """
    columns = [name for name in used.columns if name != "row"]
    lists = used.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("uses"))

    @F.arrow_udf("array<string>")
    def cut(values: pa.Array, uses: pa.Array) -> pa.Array:
        found = []
        for value, own in zip(values.cast(pa.large_binary()), uses):
            words = value.as_py().split()
            found.append(
                [b" ".join(words[u["first"] : u["first"] + u["words"]]).decode() for u in own.as_py()]
            )
        release()
        return pa.array(found, pa.list_(pa.string()))

    ranges = F.transform("uses", lambda u: F.struct(u["first"].alias("first"), u["words"].alias("words")))
    joined = lists.join(texts, "row").select("row", "uses", cut("text", ranges).alias("texts"))
    return joined.select("row", F.explode(F.arrays_zip("uses", "texts")).alias("x")).select(
        *[F.col("row") if name == "row" else F.col(f"x.uses.{name}").alias(name) for name in used.columns],
        F.col("x.texts").alias("text"),
    )


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of `range(size)` chosen by key.

    A Feistel network over the next even number of bits; results outside the range
    are put through it again until they fall inside.
    """
    index, size = index.astype(np.uint64), size.astype(np.uint64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2)).astype(np.uint64)
    bits += (np.uint64(1) << (np.uint64(2) * bits)) < size  # when log2 was rounded down
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = split_mix(key.astype(np.uint64))
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        value, b, mask, k = out[todo], bits[todo], low[todo], keys[todo]
        left, right = value >> b, value & mask
        for turn in range(4):
            with np.errstate(over="ignore"):
                mixed = split_mix(right + k + np.uint64(turn * 0x9E3779B9))
            left, right = right, left ^ (mixed & mask)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo]]
    return out


def slots(
    spark, plan: list[Quota], shard_slots: int = SHARD_SLOTS, seed: int = SEED
) -> DataFrame:
    """The mix as an index: `shard, slot, source, block`, one row per slot.

    Every shard draws its source counts from a multinomial distribution by a seed of
    its own.  Draws beyond a source's slots are handed, one for one, to sources that
    drew too few, so the totals are the targets whatever the draws were.
    """
    total = sum(q.slots for q in plan)
    kind = "shard long, source_index int, slots long, before_shard long"
    if not total:
        return spark.createDataFrame([], "shard long, slot long, source string, block long")
    shards = -(-total // shard_slots)
    share = np.array([q.slots for q in plan], np.float64) / total

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                size = min(shard_slots, total - shard * shard_slots)
                drawn = np.random.default_rng((seed, shard)).multinomial(size, share)
                own = np.flatnonzero(drawn)
                before = (np.cumsum(drawn) - drawn)[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), shard, np.int64)),
                        pa.array(own.astype(np.int32)),
                        pa.array(drawn[own].astype(np.int64)),
                        pa.array(before.astype(np.int64)),
                    ],
                    ["shard", "source_index", "slots", "before_shard"],
                )

    drawn = saved(spark.range(shards).mapInArrow(draw, kind), "mix-drawn")
    totals = {r[0]: r[1] for r in drawn.groupBy("source_index").agg(F.sum("slots")).collect()}
    surplus = [max(0, totals.get(q.index, 0) - q.slots) for q in plan]
    wanting = [max(0, q.slots - totals.get(q.index, 0)) for q in plan]
    table = spark.createDataFrame(
        [
            (q.index, q.source, q.blocks, q.slots, s, w, totals.get(q.index, 0))
            for q, s, w in zip(plan, np.cumsum(surplus) - surplus, np.cumsum(wanting) - wanting)
            for s, w in [(int(s), int(w))]
        ],
        "source_index int, source string, blocks long, quota long, spare long, want long, drawn long",
    )
    along = (
        Window.partitionBy("source_index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranged = drawn.withColumn("before", F.coalesce(F.sum("slots").over(along), F.lit(0)))
    dealt = (
        ranged.join(table, "source_index")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .select(
            "shard",
            (F.col("before_shard") + F.col("i")).alias("slot"),
            "source_index",
            (F.col("before") + F.col("i")).alias("index"),
            "quota",
            "spare",
        )
    )
    held = dealt.filter("index < quota").select("shard", "slot", "source_index", "index")
    over = dealt.filter("index >= quota").select(
        "shard", "slot", (F.col("spare") + F.col("index") - F.col("quota")).alias("number")
    )
    takers = table.filter("quota > drawn").select(
        "source_index",
        F.explode(F.sequence("drawn", F.col("quota") - 1)).alias("index"),
        "want",
        "drawn",
    ).select("source_index", "index", (F.col("want") + F.col("index") - F.col("drawn")).alias("number"))
    given = over.join(takers, "number").select("shard", "slot", "source_index", "index")
    named = held.union(given).join(table.select("source_index", "source", "blocks"), "source_index")

    @F.arrow_udf("long")
    def block_of(index: pa.Array, blocks: pa.Array, number: pa.Array) -> pa.Array:
        at, size, own = (x.to_numpy().astype(np.uint64) for x in (index, blocks, number))
        turn = at // size
        with np.errstate(over="ignore"):
            key = split_mix(own * np.uint64(0x9E3779B97F4A7C15) + turn + np.uint64(seed))
        return pa.array(permuted(at % size, size, key).astype(np.int64))

    return named.select("shard", "slot", "source", block_of("index", "blocks", "source_index").alias("block"))


def source_sizes(docs: Packed) -> list[tuple[str | None, int]]:
    """Words of each source: the mixture's own table, one entry a source.

    The driver holds this table and its quotas, and a task draws one number for each of its
    sources, so a mix is meant for up to some 100,000 sources.
    """
    return [(r[0], int(r[1])) for r in docs.places.groupBy("source").agg(F.sum("size")).collect()]


def mix(
    docs: Packed,
    plan: list[Quota],
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
    with_text: bool = False,
) -> DataFrame:
    """The mix: `shard, slot, source, block, offset, row, doc_id, first, words` (and `text`).

    A slot holds the pieces of its block; a piece is `words` words of the packed
    document `row` from word `first` on.  With text these are the training blocks
    themselves: the pieces of a slot in order of `offset`.  Slots are joined
    to pieces by index, and only then texts are cut.
    """
    index = slots(docs.places.sparkSession, plan, shard_slots, seed)
    parts = (
        pieces(docs.places, block_words)
        .withColumnRenamed("source", "s")
        .withColumnRenamed("block", "b")
    )
    used = index.join(
        parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    ).drop("s", "b")
    return _with_text(used, docs.texts) if with_text else used


def taken(docs: Packed, plan: list[Quota], **options) -> DataFrame:
    """Words that the mix takes of each document, one row per document row.

    Columns `doc_id, size, source_size, target, taken`.  Null and empty texts have
    size 0 and take nothing; null is a source of its own, the last one; repeated rows
    are documents of their own.  An empty table gives an empty result.
    """
    spark = docs.places.sparkSession
    sums = mix(docs, plan, **options).groupBy("row").agg(F.sum("words").alias("taken"))
    table = spark.createDataFrame(
        [(q.source, q.size, q.target) for q in plan],
        "table_source string, source_size long, target double",
    )
    return (
        docs.places.select("row", "doc_id", "source", "size")
        .join(sums, "row", "left")
        .join(table, F.col("source").eqNullSafe(F.col("table_source")))
        .select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
        )
    )
