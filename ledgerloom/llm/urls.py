"""URL filters: rules for hosts and paths, and a logistic regression for the rest.

The regression reads hashed character n-grams of host and path and is trained from a
small table of labelled URLs.  All steps run inside Spark, without Python in tasks.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import bind
from ledgerloom.llm.url_labels import labelled_urls

#: Fixed values: (host, start of path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Lengths of the n-grams, places they are hashed to, and labelled rows to train from.
GRAMS, PLACES, SAMPLE_ROWS = (3, 4, 5), 1 << 13, 10_000
#: Chance of a block from which the regression blocks.
LEAST_CHANCE = 0.5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or a URL."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url).cast("string"), pattern, i), F.lit(""))
    return F.translate(part(1), _CAPITALS, _CAPITALS.lower()), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, F.lit(own + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, sizes=GRAMS, places: int = PLACES) -> Column:
    """Distinct places that the n-grams of host and path are hashed to.

    N-grams of the host and of the path have places of their own.  Characters are taken
    from an array by index, so the work is in proportion to the length of the URL.
    """

    def of_part(mark: int, text: Column) -> Column:
        def of_size(characters: Column, size: int) -> Column:
            last = F.size(characters) - size
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            place = lambda i: F.pmod(
                F.xxhash64(F.lit(mark), *[F.get(characters, i + k) for k in range(size)]), F.lit(places)
            ).cast("int")
            return F.transform(starts, place)

        def hashed(characters: Column) -> Column:
            return F.array_distinct(F.concat(*[of_size(characters, size) for size in sizes]))

        return bind(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), hashed)

    return F.array_union(
        of_part(1, F.concat(F.lit("."), host, F.lit("/"))), of_part(2, F.concat(path, F.lit("?")))
    )


def _vectors(rows: DataFrame) -> DataFrame:
    hashing = HashingTF(inputCol="grams", outputCol="places", numFeatures=PLACES, binary=True)
    return hashing.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LogisticRegressionModel | None:
    """Fit the regression to `(host, path, verdict)`; None without both verdicts.

    About `sample_rows` different URLs are read, chosen by hash among all.
    """
    known = labelled.filter("verdict is not null").select("host", "path", "verdict").distinct()
    count = known.count()
    if count > sample_rows:
        part = int(sample_rows / count * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) < part)
    known = known.withColumn("label", (F.col("verdict") == "block").cast("double"))
    if known.select("label").distinct().count() < 2:
        return None
    fit = LogisticRegression(
        featuresCol="places", labelCol="label", regParam=0.01, maxIter=30, probabilityCol="chance"
    )
    return fit.fit(_vectors(known.orderBy("host", "path")))


def judged(
    pages: DataFrame,
    id_column: str = "page_id",
    url: str = "url",
    rules=RULES,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """One row per row of `pages`: `page_id, host, path, rule, verdict, block_chance`.

    A rule decides where one fits.  Elsewhere the regression does; its labelled URLs
    are `labelled(url, verdict)`, or else the small table of `url_labels`.  Where there
    are no labels of both verdicts it allows.  Null URLs and URLs without `://` have
    an empty host and path and go the same way.  Repeated rows get a row each.  A very
    long URL takes time and memory in proportion to its length.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), says.alias("says"))
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_urls(), "url string, verdict string")
    host, path = host_and_path("url")
    table = labelled.select(host.alias("host"), path.alias("path"), "verdict")
    model = train(table)
    if model is None:
        scored = rows.withColumn("block_chance", F.lit(0.0))
    else:
        scored = model.transform(_vectors(rows)).withColumn(
            "block_chance", F.get(vector_to_array("chance"), F.lit(1))
        )
    found = F.when(F.col("block_chance") >= LEAST_CHANCE, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("says", found).alias("verdict"), "block_chance"
    )
