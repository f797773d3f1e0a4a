"""Vector codes by product quantisation with equal-average search.

Components become integers, vectors are cut into parts, and each part position has a
codebook that is refined over all vectors.  The nearest entry of a part is searched
outward from the part's component sum among entries in order of theirs: the squared
difference of the sums over the dimension is a lower bound of the squared distance,
so the search ends where it exceeds the best distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved

#: Parts of a vector, entries of a codebook, rounds of refinement, steps of one unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Greatest size of a component in whole numbers; distances then fit into 64 bits.
_MOST = 1 << 26


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance for each row of integers.

    Ties go to the lower index.  `vectors` is (n, d) and `entries` (k, d), k > 0.
    """
    count, width = vectors.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ordered = sums[order]
    own = vectors.sum(axis=1)
    right = np.searchsorted(ordered, own)
    left = right - 1
    best = np.full(count, np.iinfo(np.int64).max)
    found = np.full(count, len(entries), np.int64)
    active = np.arange(count)
    never = np.iinfo(np.int64).max
    while len(active):
        low, high = left[active], right[active]
        gap_low = np.where(low >= 0, own[active] - ordered[np.maximum(low, 0)], never)
        gap_high = np.where(
            high < len(ordered), ordered[np.minimum(high, len(ordered) - 1)] - own[active], never
        )
        gap = np.minimum(gap_low, gap_high)
        done = gap == never
        # squared gap / width > best, in whole numbers; a first entry is always looked at
        reached = (found[active] < len(entries)) & ~done
        done[reached] = gap[reached] ** 2 > best[active[reached]] * width
        active, down = active[~done], (gap_low <= gap_high)[~done]
        at = np.where(down, left[active], right[active])
        left[active[down]] -= 1
        right[active[~down]] += 1
        index = order[at]
        distance = ((vectors[active] - entries[index]) ** 2).sum(axis=1)
        better = (distance < best[active]) | ((distance == best[active]) & (index < found[active]))
        best[active[better]] = distance[better]
        found[active[better]] = index[better]
    return found, best


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def integers(
    rows: DataFrame, id_column: str, vector: str, label: str, scale: int = SCALE
) -> DataFrame:
    """`vec_id, label, v`: vectors as whole numbers, without those that are incomplete."""
    value = F.col(f"`{vector}`")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled: Column = F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.filter(value.isNotNull() & ~bad).select(
        F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), scaled.alias("v")
    )


def refined(whole: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: means, rounded down, of the parts nearest to each entry.

    `books` is (parts, entries, d).  Every task adds up its own rows, so a round moves one
    row per task and entry, and the driver gets one row per entry.
    """
    parts, entries, width = books.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * width)
            for part in range(parts):
                piece = vectors[:, part * width : (part + 1) * width]
                index, _ = nearest(piece, books[part])
                np.add.at(sums[part], index, piece)
                counts[part] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(entry.astype(np.int32)),
                pa.array(counts[part, entry]),
                *[pa.array(sums[part, entry, i]) for i in range(width)],
            ],
            ["part", "entry", "n", *[f"s{i}" for i in range(width)]],
        )

    kind = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(width))
    totals = whole.select("v").mapInArrow(added, kind).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    )
    after = books.copy()
    for row in totals.collect():
        after[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def trained(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """Codebooks over all rows of `integers`; None where there are no rows.

    They start as the vectors of the least ids; ties go by the vector, rows without an id
    come last.  With fewer rows than `entries` the codebooks are that much shorter.
    """
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not first:
        return None
    dimension = len(first[0]["v"])
    if not dimension or dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    start = np.array([r["v"] for r in first], np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(whole, books)
    return books


def encoded(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """`vec_id, code, error, label_error, codebooks_sha256` for each complete vector.

    Vectors that are null or hold a null or a component that is not finite are left out,
    all others, repeated rows and rows without an id or label included, get a row.  Rows
    without a label share one `label_error`.  All vectors must have the same number of
    components, a multiple of `parts`, of less than 2^26 / `scale` each; anything else is
    an error.  An empty table gives an empty result.  Other columns are not read.
    """
    whole = saved(integers(rows, id_column, vector, label, scale), "codes-integers")
    wrong = whole.agg(
        F.min(F.size("v")).alias("least"),
        F.max(F.size("v")).alias("most"),
        F.max(F.array_max(F.transform("v", F.abs))).alias("largest"),
    ).first()
    if wrong["least"] != wrong["most"]:
        raise ValueError(f"vectors of {wrong['least']} and of {wrong['most']} components")
    if (wrong["largest"] or 0) >= _MOST:
        raise ValueError(f"a component is beyond {_MOST // scale}")
    books = trained(whole, parts, entries, rounds)
    keys = dict(whole.dtypes)
    if books is None:
        return rows.sparkSession.createDataFrame(
            [],
            f"vec_id {keys['vec_id']}, code string, error long, label_error long, codebooks_sha256 string",
        )
    dimension = books.shape[0] * books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for batch in batches:
            vectors = _matrix(batch.column("v"), dimension)
            text, error = np.full(len(vectors), "", object), np.zeros(len(vectors), np.int64)
            for part, pieces in enumerate(np.split(vectors, parts, axis=1)):
                index, distance = nearest(pieces, books[part])
                text += two[index].astype(object)
                error += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    kind = f"vec_id {keys['vec_id']}, label {keys['label']}, code string, error long"
    coded = saved(whole.mapInArrow(code, kind), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that rows of entry indexes stand for, as whole numbers."""
    return np.concatenate([books[part][codes[:, part]] for part in range(len(books))], axis=1)
