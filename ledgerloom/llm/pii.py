"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

All steps are column expressions.  A match's place comes from the pieces of text
between matches, whose lengths are summed, and its context from the ends of those
pieces, so that the work stays linear in the text.  The patterns hold no repeated
groups, which Java's matcher would run by recursion: where one is needed, its
separators are first marked, one character for one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of

#: Marks for separators inside a match; where a text has them itself, they count as
#: a character of no pattern.
_MARK, _NONE = "\x01", "\x02"
_LOCAL = r"A-Za-z0-9._%+\-"
#: Characters of context on either side of a match.
CONTEXT = 40
#: Score from which a proposed span is personal data; base kinds always are.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    `guard` is a cheap pattern that every text with a match has; `joins` are places
    of separators to mark; `score` counts for a confirmed match, `near` for a context
    word.  Base kinds are kept whatever their score.
    """

    name: str
    guard: str
    joins: str | None
    pattern: str
    words: str
    score: float
    near: float = 0.2
    base: bool = True


#: The base patterns and the words that raise a score.
KINDS = (
    Kind(
        "email",
        "@",
        r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
        rf"(?:\G|(?<![{_LOCAL}{_MARK}]))[{_LOCAL}{_MARK}]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++",
        "mail|contact|write|reply",
        0.8,
    ),
    Kind(
        "ip",
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        None,
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"\bip\b|address|host|server|login",
        0.6,
    ),
    Kind(
        "card",
        r"[0-9][0-9\x20-]{10}",
        r"(?<=[0-9])[\x20-](?=[0-9])",
        rf"[0-9][0-9{_MARK}]++",
        "card|visa|master|credit|payment",
        0.8,
    ),
    Kind(
        "phone",
        r"\+[0-9]",
        None,
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "phone|call|tel|mobile|fax",
        0.7,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        None,
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "iban|account|bank|transfer",
        0.9,
        base=False,
    ),
    Kind(
        "national_id",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        None,
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"\bssn\b|social security|national id|taxpayer",
        0.3,
        near=0.4,
        base=False,
    ),
)
BASE = tuple(kind.name for kind in KINDS if kind.base)
#: Entries of a running sum that are summed one by one; sums of so many are kept.
_BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... entries, in blocks so that long arrays stay cheap."""
    add = lambda values: F.aggregate(values, F.lit(0), lambda a, b: a + b)
    count = F.ceil(F.size(numbers) / _BLOCK).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    blocks = F.transform(starts, lambda b: F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, add)

    def within(block: Column, at: Column) -> Column:
        base = F.array(add(F.slice(totals, F.lit(1), at)))
        places = F.sequence(F.lit(1), F.size(block))
        return F.flatten(
            F.transform(
                base,
                lambda b: F.transform(places, lambda i: b + add(F.slice(block, F.lit(1), i))),
            )
        )

    return F.flatten(F.transform(blocks, within))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)
    place = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(place, F.lit(0), lambda sum_, i: sum_ + worth(i)) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an IBAN without blanks has check digits of remainder 1 by 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))
    letters = F.split(turned, "(?!^)(?!$)")

    def step(rest: Column, letter: Column) -> Column:
        value = F.when(letter.between("0", "9"), letter.cast("int")).otherwise(F.ascii(letter) - 55)
        return (rest * F.when(value > 9, F.lit(100)).otherwise(F.lit(10)) + value) % 97

    return F.aggregate(letters, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether the checks of a kind accept a match."""
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: _small(part) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        account = F.regexp_replace(match, r"\x20", "")
        return F.when(F.length(account).between(15, 34), mod_97(account)).otherwise(F.lit(False))
    return F.lit(True)


def _small(part: Column) -> Column:
    """The value of up to three digits behind leading zeros, 256 for more."""
    rest = F.regexp_replace(part, "^0+", "")
    return (
        F.when(rest == "", F.lit(0))
        .when(F.length(rest) > 3, F.lit(256))
        .otherwise(F.substring(rest, 1, 3).cast("int"))
    )


def with_spans(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """`docs` with an array of `struct<start, rank, kind, end, score, match>` in order.

    Whole texts are searched; null and empty texts have an empty array.  Places are
    code points, ends exclusive; order is by start, then by the order of `KINDS`.
    Columns that are there keep their names; scratch columns are chosen free.
    """
    own = [f"{name}__{step}_{kind.name}" for kind in KINDS for step in ("text", "gaps", "found", "ends")]
    clash = {c.lower() for c in docs.columns}
    if clash & {c.lower() for c in [name, *own]}:
        return with_spans(docs, text, name + "_")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    col = lambda step, kind: F.col(f"{name}__{step}_{kind.name}")
    label = lambda step, kind: f"{name}__{step}_{kind.name}"

    plain = text_of(f"`{text}`")

    def marked(kind: Kind) -> Column:
        guarded = F.when(plain.rlike(kind.guard), plain)
        if not kind.joins:
            return guarded
        return F.regexp_replace(F.translate(guarded, _MARK, _NONE), kind.joins, _MARK)

    step = docs.select(*keep, *[marked(k).alias(label("text", k)) for k in KINDS])
    step = step.select(
        *keep,
        *[F.split(col("text", k), k.pattern, -1).alias(label("gaps", k)) for k in KINDS],
        *[
            F.regexp_extract_all(col("text", k), F.lit(k.pattern), F.lit(0)).alias(label("found", k))
            for k in KINDS
        ],
    )
    sized = lambda k: F.transform(
        col("found", k), lambda m, i: F.length(m) + F.length(F.get(col("gaps", k), i))
    )
    step = step.select(
        *keep,
        *[col(s, k) for k in KINDS for s in ("gaps", "found")],
        *[
            F.when(F.size(col("found", k)) > 0, running_sums(sized(k))).alias(label("ends", k))
            for k in KINDS
        ],
    )

    def spans(rank: int, kind: Kind) -> Column:
        def one(match: Column, i: Column) -> Column:
            around = F.lower(
                F.concat_ws(
                    " ",
                    F.right(F.get(col("gaps", kind), i), F.lit(CONTEXT)),
                    F.left(F.get(col("gaps", kind), i + 1), F.lit(CONTEXT)),
                )
            )
            end = F.get(col("ends", kind), i)
            score = F.lit(kind.score) + F.when(around.rlike(kind.words), F.lit(kind.near)).otherwise(0.0)
            return F.struct(
                (end - F.length(match)).alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind.name).alias("kind"),
                end.alias("end"),
                score.alias("score"),
                match.alias("match"),
            )

        found = F.filter(F.transform(col("found", kind), one), lambda s: confirmed(kind.name, s["match"]))
        if not kind.base:
            found = F.filter(found, lambda s: s["score"] >= LEAST_SCORE)
        none = "array<struct<start:int,rank:int,kind:string,end:int,score:double,match:string>>"
        return F.when(F.size(col("found", kind)) > 0, found).otherwise(F.array().cast(none))

    return step.select(
        *keep, F.sort_array(F.concat(*[spans(i, k) for i, k in enumerate(KINDS)])).alias(name)
    )


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def listed(spans: Column) -> Column:
    """Spans as text: `kind:start:end`, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: counts, digest of the base spans, all spans, scores.

    Columns `doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores`.
    Spans of the same text by two kinds are both listed.  Repeated rows and rows
    without an id get a row each; no other column is read.
    """
    found = with_spans(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    found = found.select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("pii", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE
        ],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )
