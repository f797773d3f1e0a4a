"""Pluggable steps: text extraction from file content, field extraction from prompts.

Both run user code on Arrow batches.  An error concerns its row only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.schemas import DEFAULTS, EXTRACTED, FIRST_FOUND, REPLY, Settings

PageReader = Callable[[bytes], list[str]]
FieldReader = Callable[[str, str], tuple[str, int]]


def plain_text_pages(content: bytes) -> list[str]:
    """Reader for UTF-8 text whose pages are separated by form feeds."""
    return content.decode("utf-8").split("\f")


def extract_pages(files: DataFrame, readers: dict[str, PageReader]) -> DataFrame:
    """Read the pages of each ``(doc_id, method, content)`` row.

    ``readers`` maps a method name to a function from file bytes to page
    texts.  A row with an unknown method, or whose reader raises, has no pages
    and carries the error.  All pages of a file stay together in one row, so
    nothing has to be grouped afterwards.
    """
    default, unknown = fv.DEFAULT_METHOD, fv.UNKNOWN_METHOD

    def reading(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            pages, errors = [], []
            for method, content in zip(batch["method"], batch["content"]):
                name = default if method is None else method
                found, error = None, None
                if name not in readers:
                    error = f"{unknown}{name}"
                else:
                    try:
                        texts = readers[name](bytes(content))
                        found = [
                            {"page_no": number, "text": text}
                            for number, text in enumerate(texts, 1)
                        ]
                    except Exception as problem:
                        error = f"{type(problem).__name__}: {problem}"
                pages.append(found)
                errors.append(error)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pages": pages, "error": errors})

    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "method", "content")
    return rows.mapInPandas(reading, EXTRACTED)


def extract_first(
    files: DataFrame, readers: dict[str, PageReader], settings: Settings = DEFAULTS
) -> DataFrame:
    """Read each ``(doc_id, content)`` with the first reader that finds text.

    Readers are tried in their order.  One that raises is skipped; the first whose
    page 1 has more letters and digits than the minimum is taken.  Adds
    ``extraction_method`` (null where none is taken), ``pages``, ``page_count`` and
    ``open_error`` (the last error where every reader raised).  Null content stays
    unread.
    """
    least = settings.min_alphanumerics

    def reading(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                method, pages, count, error, opened = None, None, None, None, False
                for name, reader in readers.items() if content is not None else ():
                    try:
                        texts = reader(bytes(content))
                    except Exception as problem:
                        error = f"{type(problem).__name__}: {problem}"
                        continue
                    opened, count = True, len(texts)
                    if texts and sum(map(str.isalnum, texts[0])) > least:
                        method = name
                        pages = [{"page_no": n, "text": t} for n, t in enumerate(texts, 1)]
                        break
                rows.append((doc_id, method, pages, count, None if opened else error))
            yield pd.DataFrame(
                rows, columns=["doc_id", "extraction_method", "pages", "page_count", "open_error"]
            ).astype({"page_count": "Int32"})

    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    return rows.mapInPandas(reading, FIRST_FOUND)


def extract_fields(prompts: DataFrame, reader: FieldReader) -> DataFrame:
    """Apply ``reader(system, user) -> (reply, tokens)`` to each prompt row.

    Tasks can be repeated, so a reader that calls a paid service should write
    through a store keyed by ``doc_id``; the default way is to join a table of
    replies instead.
    """
    prefix = fv.REPLY_STEP_ERROR

    def reading(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            replies, tokens, errors = [], [], []
            for system, user in zip(batch["system_prompt"], batch["user_prompt"]):
                reply, used, error = None, 0, None
                try:
                    reply, used = reader(system, user)
                except Exception as problem:
                    error = f"{prefix}{problem}"
                replies.append(reply)
                tokens.append(used)
                errors.append(error)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "content": replies,
                    "total_tokens": tokens,
                    "error": errors,
                }
            )

    rows = prompts.select(
        F.col("doc_id").cast("string").alias("doc_id"), "system_prompt", "user_prompt"
    )
    return rows.mapInPandas(reading, REPLY)
