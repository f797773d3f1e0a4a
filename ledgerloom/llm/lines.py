"""Quality rules: lines that many documents of a host share.

Normalised lines are hashed and counted over the distinct documents of their host.
Lines above the limit are removed; a document that loses most of its words goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, free_name, row_key, saved, text_of

#: A line is removed when more distinct documents of its host than this have it.  The limit
#: is the same for a host of any size: a line that twenty different texts repeat is not the
#: work of any of them, and how many texts without it there are beside does not change that.
MOST_DOCUMENTS = 20
#: A document is depleted when less than this part of its words stays.
STAYS = 0.5
#: Base rules: least words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3


def normalised(line: Column) -> Column:
    """A line in lower case, white space single and none at its ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def repeated_words(words: Column, windows: Column) -> Column:
    """Words in windows whose hash is found twice or more; arrays of one document.

    Hashes are sorted with their places; equal neighbours are repeats, and each
    repeated window adds the words up to the next one's start.
    """
    sorted_ = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def places(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda p, k: (F.get(pairs, k - 1)["h"].eqNullSafe(p["h"]) & (k > 0))
            | F.get(pairs, k + 1)["h"].eqNullSafe(p["h"]),
        )
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    bound = F.transform(F.array(sorted_), lambda pairs: places(pairs))
    return F.transform(bound, lambda at: covered(at))[0]


def measured(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """Base figures and hashed lines, one row per row of `docs`, written.

    Columns `doc_id, host, key, content, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lines` (each line's hash and number of words).
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        row_key(id_column, text).alias("key"),
        text_of(text).alias("text"),
    )
    blank = r"[\x20\x09-\x0D]+"
    rows = rows.select(
        "doc_id",
        "host",
        "key",
        F.xxhash64("text").alias("content"),
        F.length(F.regexp_replace("text", blank, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    last = F.size("words") - WINDOW
    rows = rows.select(
        "doc_id",
        "host",
        "key",
        "content",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            "lines",
            lambda x: F.struct(line_hash(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")),
        ).alias("lines"),
        "words",
        F.when(
            last >= 0,
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
            ),
        ).alias("windows"),
    )
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn(
        "n_repeat_words",
        F.when(again, repeated_words(F.col("words"), F.col("windows"))).otherwise(0).cast("long"),
    ).drop("words", "windows")
    return saved(rows, "lines-measured")


def common_lines(rows: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """`(host, line, documents)` of the lines that more than `most` distinct documents have.

    Copies of a text are one document of their host.  Counts are summed within tasks
    before they are shuffled, so a very common line costs a row per task.
    """
    texts = rows.select(
        "host", "content", F.array_distinct(F.transform("lines", lambda x: x["line"])).alias("lines")
    ).dropDuplicates(["host", "content"])
    return (
        texts.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("documents"))
        .filter(F.col("documents") > most)
    )


def losses(rows: DataFrame, common: DataFrame) -> DataFrame:
    """`(key, lost_host, lost, lost_lines)`: words and lines that each document loses."""
    own = rows.dropDuplicates(["key", "host"]).select(
        "key", "host", F.explode("lines").alias("x")
    ).select("key", "host", "x.line", "x.words")
    hot = common.select(F.col("host").alias("hot_host"), F.col("line").alias("hot_line"))
    return (
        own.join(hot, F.col("host").eqNullSafe(F.col("hot_host")) & (F.col("line") == F.col("hot_line")))
        .groupBy("key", F.col("host").alias("lost_host"))
        .agg(F.sum("words").alias("lost"), F.collect_set("line").alias("lost_lines"))
    )


def verdicts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    host: str = "source",
    most: int = MOST_DOCUMENTS,
    stays: float = STAYS,
) -> DataFrame:
    """Figures and verdict of each document, one row per row of `docs`.

    Columns `doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_words`.  Null and empty texts have no words and fail the
    base rules.  Null is a host of its own.  Rows that repeat an id, text and host
    are one document and get a row each.  Other columns are not read.
    """
    rows = measured(docs, id_column, text, host)
    lost = losses(rows, saved(common_lines(rows, most), "lines-common"))
    joined = rows.drop("lines").join(
        lost.drop("lost_lines").withColumnRenamed("key", "lost_key"),
        (F.col("key") == F.col("lost_key")) & F.col("host").eqNullSafe(F.col("lost_host")),
        "left",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - lost_words >= stays * F.col("n_words"))).alias("kept"),
        lost_words.alias("lost_words"),
    )


def without_common_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", **limits
) -> DataFrame:
    """`docs` with their common lines removed; other lines and columns as they are.

    A null text stays null, and a text that loses all its lines becomes empty.
    """
    rows = measured(docs, id_column, text, host)
    lost = losses(rows, saved(common_lines(rows, **limits), "lines-common"))
    key, other, hosts, gone = (free_name(docs, n) for n in ("row_key", "lost_key", "lost_host", "lost_lines"))
    lost = lost.select(
        F.col("key").alias(other), F.col("lost_host").alias(hosts), F.col("lost_lines").alias(gone)
    )
    left = F.filter(
        F.split(F.col(text).cast("string"), "\n"),
        lambda x: ~(x.rlike(WORD) & F.array_contains(F.col(gone), line_hash(x))),
    )
    kept = docs.withColumn(key, row_key(id_column, text)).join(
        lost,
        (F.col(key) == F.col(other)) & F.col(host).cast("string").eqNullSafe(F.col(hosts)),
        "left",
    )
    kept = kept.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
