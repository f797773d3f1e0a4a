"""Secret scans: fixed patterns, and strings that a tokenizer can't compress.

A vocabulary of ordinary text spends few tokens on words and many on random
characters.  Strings with few characters a token are secrets, unless they are known
digests or identifiers.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of, vocabulary_path

#: Patterns of the base kinds, with the length each match must reach.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 8
#: One of these is in every text that ASSIGN can match.
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Most characters a token of a random string of letters and digits, from 20 characters on and
#: from 12 to 19, where chance is greater.  Of random strings of 12 characters 99 of 100 are
#: under 1.8 in both cases and under 2.0 in one.
RATIO, SHORT, SHORT_RATIO = 2.2, 20, 1.9
#: Most characters a token of a random string of letters only.  Of 2,000 random strings of
#: 20 letters all in both cases and 97 of 100 in one case are under it; run-together words
#: of sf0.1 start at 2.22.  Shorter strings of letters only are not judged: of 12 to 19
#: letters, words of sf0.1 start at 1.5, under which half of the random ones are not.
LETTERS_RATIO = 2.1
#: Fewest characters a token of the words of an identifier.
READS = 2.2
_STRING = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Dates and times of day, which are identifiers.
_MOMENT = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-]?(?:[0-9]{2}-?){0,3}[Zz]?")
_LETTERS = re.compile(r"[A-Za-z]{4,}")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Parts of an identifier: words in one case, capitalised words, short numbers.
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]{1,4}(?![0-9])|[A-Za-z](?![A-Za-z])")
_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_LOADED: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """A tiktoken vocabulary read from a file of ranks, once a process."""
    if path not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(
            "secrets", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _LOADED[path]


def is_digest(string: str) -> bool:
    """Whether a string has the form of a known digest or of a UUID."""
    if _UUID.fullmatch(string):
        return True
    return len(string) in DIGEST_LENGTHS and bool(_HEXADECIMAL.fullmatch(string))


def is_identifier(string: str) -> bool:
    """Whether a string reads as words and short numbers joined by case or marks.

    Words of an identifier are three letters or longer on average, which random
    letters and digits are not.
    """
    found = parts = 0
    for piece in re.split(r"[_/+=-]+", string):
        at = 0
        while at < len(piece):
            part = _PART.match(piece, at)
            if not part:
                return False
            at = part.end()
            parts += 1
            found += part.end() - part.start()
    return parts > 0 and found / parts >= 3


def is_random_letters(string: str, tokens: tiktoken.Encoding, ratio: float = LETTERS_RATIO) -> bool:
    """Whether a string of letters and marks has very few characters a token.

    Runs of four letters or more are measured, if they are half of the string; letters
    of one case as lower case, of which a vocabulary knows more words.  They have no
    parts by which an identifier would show.
    """
    single = string.islower() or string.isupper()
    if not single and is_identifier(string):
        return False
    pieces = _LETTERS.findall(string.lower() if single else string)
    found = sum(map(len, pieces))
    if 2 * found < len(string):
        return False
    return found < ratio * sum(len(tokens.encode_ordinary(piece)) for piece in pieces)


def is_random(string: str, tokens: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """Whether a string has few characters a token and is no digest or identifier."""
    if not any(c.isdigit() for c in string):
        return len(string) >= SHORT and is_random_letters(string, tokens, min(ratio, LETTERS_RATIO))
    if not any(c.isalpha() for c in string) or is_digest(string) or _MOMENT.fullmatch(string):
        return False
    if is_identifier(string) and reads(string, tokens):
        return False
    least = ratio if len(string) >= SHORT else min(ratio, SHORT_RATIO)
    return len(string) < least * len(tokens.encode_ordinary(string))


def reads(string: str, tokens: tiktoken.Encoding) -> bool:
    """Whether the runs of letters of a string are words to the vocabulary."""
    pieces = [piece.lower() for piece in _WORDS.findall(string)]
    return sum(map(len, pieces)) >= READS * sum(len(tokens.encode_ordinary(p)) for p in pieces)


def find(text: str, tokens: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """`(kind, start, end)` of every secret of a text, by start and then by kind.

    Random strings that overlap a match of a fixed pattern are not named again.
    """
    spans = []
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                spans.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in spans)
    at = furthest = 0
    for m in _STRING.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            furthest = max(furthest, base[at][1])
            at += 1
        if furthest <= m.start() and is_random(m.group(), tokens, ratio):
            spans.append((m.start(), 3, m.end()))
    return [(KINDS[kind], a, b) for a, kind, b in sorted(spans)]


def spans_of(
    text: str | Column = "text", vocabulary: str | None = None, ratio: float = RATIO
) -> Column:
    """Column of the secrets of each whole text: `array<struct<kind, start, end>>`.

    Places are code points, ends exclusive.  Null and empty texts have none.  The
    vocabulary is a file of tiktoken ranks that every executor has.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        tokens = encoding(path)
        return pa.array(
            [
                [{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py(), tokens, ratio)]
                for t in texts
            ],
            kind,
        )

    return scan(text_of(text))


def listed(spans: Column) -> Column:
    """Spans as text: `kind:start:end`, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: counts of the base kinds, their digest, all spans.

    Columns `doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`.
    Repeated rows and rows without id get a row each; no other column is read.
    """
    scanned = docs.select(F.col(id_column).alias("doc_id"), spans_of(text, **options).alias("all"))
    of = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("all", lambda s: s["kind"] != KINDS[-1])
    return scanned.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"),
    )


def redact(
    docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = None, **options
) -> DataFrame:
    """`docs` with every secret replaced by a mark; other columns as they are.

    Overlapping secrets are replaced together.  Null texts stay null.  `length`
    names a column that holds the text's length; it follows the new text.
    """
    path = options.get("vocabulary") or vocabulary_path("byte_bpe_50k.tiktoken")
    ratio = options.get("ratio", RATIO)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        tokens = encoding(path)
        return pa.array(
            [
                None if t.as_py() is None else without(t.as_py(), find(t.as_py(), tokens, ratio), mark)
                for t in texts
            ],
            pa.string(),
        )

    after = docs.withColumn(text, cleaned(F.col(text).cast("string")))
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        after = after.withColumn(length, F.coalesce(F.length(text).cast(kind), F.col(length)))
    return after


def without(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
