"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half of the radius.  Two fingerprints
within the radius meet on a variant, so one shuffle on variants finds all links:
no band is left out and nothing is compared that does not share a variant.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, row_key, saved, text_of
from ledgerloom.llm.graphs import components

#: Words of a shingle, seed of its hash, and most bits in which linked texts differ.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; see `fingerprints`."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(joined)]))
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array(
            [
                digest(joined[first:last], seed)
                for first, last in zip(
                    starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
                )
            ],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED):
    """Column with the fingerprint of each whole text, as a signed long.

    A-Z is lower-cased, words are runs without ASCII white space, shingles are
    joined by one space and count as often as they occur.  A text with fewer words
    is one shingle; a text without words, or null, has fingerprint zero.
    """

    @F.arrow_udf("long")
    def of_batch(texts: pa.Array) -> pa.Array:
        found = np.fromiter(
            (fingerprint(t, shingle, seed) for t in _bytes(texts)), np.uint64, len(texts)
        )
        return pa.array(found.view(np.int64))

    return of_batch(text_of(text))


def _bytes(texts: pa.Array):
    """The texts as UTF-8, one after the other."""
    for text in texts.cast(pa.large_binary()):
        yield text.as_py()


def variants(bits: str, radius: int):
    """Column: all values within half of `radius` bits of the column `bits`."""
    masks = [0]
    for count in range(1, radius // 2 + 1):
        masks += [sum(1 << place for place in places) for places in combinations(range(64), count)]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    return F.explode(F.array(*[F.col(bits).bitwiseXOR(F.lit(mask)) for mask in signed]))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`(a, b)`: links that connect all distinct `fingerprint`s within `radius` bits.

    `prints` has distinct fingerprints, so a variant has at most as many holders as
    there are values within half of the radius, however many copies a text has.  All
    holders of a variant are within the radius of each other; a chain through them
    links them without all their pairs.  Each pair is found twice or more; repeats
    are removed and the distance is verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    dealt = prints.select("fingerprint", variants("fingerprint", radius).alias("variant"))
    along = Window.partitionBy("variant").orderBy("fingerprint")
    pairs = dealt.select(
        F.lag("fingerprint").over(along).alias("a"), F.col("fingerprint").alias("b")
    ).filter("a is not null")
    return pairs.distinct().filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    )


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`(fingerprint, root)` for each distinct fingerprint; linked ones share a root."""
    found = components(links(prints, radius), "simhash-classes")
    return prints.join(found, prints["fingerprint"] == found["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `fingerprint` (hex) and `component_id`.

    The component is the least id reachable over links.  Copies share a fingerprint
    and are one node of the graph.  Rows without an id get a row and lend no id; a
    class of such rows only has a null component.  Other columns are not read.
    """
    rows = saved(
        docs.select(F.col(id_column).alias("doc_id"), fingerprints(docs, text).alias("fingerprint")),
        "simhash-rows",
    )
    prints = saved(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-prints")
    grouped = saved(classes(prints.select("fingerprint"), radius), "simhash-roots")
    ids = (
        grouped.join(prints, "fingerprint")
        .groupBy("root")
        .agg(F.min("least").alias("component_id"))
    )
    named = grouped.join(ids, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """The rows of `docs`, one of each class, with all their columns.

    The row with the least id stays; rows without an id come last, and of rows that agree
    in id exactly one stays.  Texts without words, null among them, share a fingerprint and
    so a class.  An empty table gives an empty result.

    Rows are written once with a number and their fingerprint.  Fingerprints are reduced to
    distinct ones before anything is grouped, so a large group of copies is one node.
    """
    number, bits = free_name(docs, "row_number"), free_name(docs, "row_fingerprint")
    rows = saved(
        docs.withColumns({number: F.monotonically_increasing_id(), bits: fingerprints(docs, f"`{text}`")}),
        "simhash-docs",
        compression="zstd",
    )
    first = F.struct(
        F.col(f"`{id_column}`").isNull().alias("unnamed"),
        F.col(f"`{id_column}`").alias("id"),
        F.col(number).alias("number"),
    )
    prints = saved(
        rows.groupBy(F.col(bits).alias("fingerprint")).agg(F.min(first).alias("first")), "simhash-prints"
    )
    grouped = classes(prints.select("fingerprint"), radius)
    stays = (
        grouped.join(prints, "fingerprint")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.number").alias(number))
    )
    # What stays grows with the rows, so it is shuffled at every size and never broadcast.
    kept = saved(stays, "simhash-stays").hint("shuffle_merge")
    return rows.join(kept, number, "left_semi").select(
        *[F.col(f"`{name}`") for name in docs.columns]
    )
