"""String expressions: trimming, normalization, fences, file names, log lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv

_OPENING = "```json"
_CLOSING = "```"
_TO_END = 2**31 - 1


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space from both ends, in linear time."""
    return F.btrim(text, F.lit(fv.WHITESPACE_CHARS))


def normalize(text: Column) -> Column:
    """Uppercase, one space per white-space run, no space at the ends."""
    return F.trim(F.regexp_replace(F.upper(text), fv.WHITESPACE_RUN, " "))


def collapse_blank_lines(text: Column) -> Column:
    """Several blank lines become one; not part of ``normalize``."""
    return F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n")


def is_blank(text: Column) -> Column:
    """Null or empty."""
    return F.coalesce(text == "", F.lit(True))


def alphanumerics(text: Column) -> Column:
    """Number of letters and digits of any script."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    An expression that uses its input several times would have the input
    computed each time when the optimizer moves it into a filter.
    """
    return F.transform(F.array(value), body)[0]


def unfence(content: Column) -> Column:
    """Remove a leading ```json and a trailing ``` and trim around both."""

    def opened(text: Column) -> Column:
        rest = F.substring(text, len(_OPENING) + 1, _TO_END)
        return F.when(text.startswith(_OPENING), rest).otherwise(text)

    def closed(text: Column) -> Column:
        rest = text.substr(F.lit(1), F.length(text) - len(_CLOSING))
        return F.when(text.endswith(_CLOSING), rest).otherwise(text)

    return strip(bind(bind(strip(content), opened), closed))


def log_line(at: Column, message: Column) -> Column:
    """``[HH:MM:SS] message``."""
    return F.concat(F.lit("["), F.date_format(at, fv.LOG_TIME_FORMAT), F.lit("] "), message)


def invoice_code(key: Column, width: int = 8) -> Column:
    """``FACT-`` and ``width`` uppercase hex digits derived from the key."""
    digest = F.sha2(key.cast("string"), 256)
    return F.concat(F.lit(fv.INVOICE_CODE_PREFIX), F.upper(F.substring(digest, 1, width)))


def export_name(at: Column) -> Column:
    """File name of a report made at the given time."""
    return F.concat(
        F.lit(fv.EXPORT_PREFIX),
        F.date_format(at, fv.EXPORT_TIME_FORMAT),
        F.lit(fv.EXPORT_SUFFIX),
    )


def or_not_available(text: Column) -> Column:
    """Null and empty text are shown as not available."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fv.NOT_AVAILABLE))
