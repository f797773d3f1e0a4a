"""Schemas of the tables the operators exchange, and the run settings."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerloom import fixed_values as fv

BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

PAGES = "ARRAY<STRUCT<page_no: INT, text: STRING>>"

EXTRACTED = f"doc_id STRING, pages {PAGES}, error STRING"

FIRST_FOUND = (
    "doc_id STRING, extraction_method STRING, pages ARRAY<STRUCT<page_no: INT, text: STRING>>, "
    "page_count INT, open_error STRING"
)
REPLY = "doc_id STRING, content STRING, total_tokens BIGINT, error STRING"

JOB_EVENTS = (
    "event_id BIGINT, job_id BIGINT, ts TIMESTAMP_NTZ, status STRING, "
    "filename STRING, size_bytes BIGINT, error STRING"
)

# Amounts are read at this width first, so that the two-decimals rule can be
# checked before they are brought to their stored precision.
_WIDE = "DECIMAL(38,18)"

RAW_INVOICE = f"""
    codigo_cliente STRING,
    razon_social_cliente STRING,
    direccion_cliente STRING,
    distrito STRING,
    items ARRAY<STRUCT<descripcion: STRING, cantidad: {_WIDE},
                       precio_unitario: {_WIDE}, subtotal: {_WIDE}>>,
    forma_pago STRING,
    moneda STRING,
    subtotal {_WIDE},
    igv {_WIDE},
    total {_WIDE},
    detraccion STRUCT<porcentaje: {_WIDE}, monto: {_WIDE}>
"""

ITEM = (
    "STRUCT<descripcion: STRING, cantidad: DECIMAL(18,4), "
    "precio_unitario: DECIMAL(18,2), subtotal: DECIMAL(18,2)>"
)
ITEMS = f"ARRAY<{ITEM}>"
DEDUCTION = "STRUCT<porcentaje: DECIMAL(9,2), monto: DECIMAL(18,2)>"
MONEY = "DECIMAL(18,2)"

INVOICE_FIELDS = (
    "codigo_cliente",
    "razon_social_cliente",
    "direccion_cliente",
    "distrito",
    "items",
    "forma_pago",
    "moneda",
    "subtotal",
    "igv",
    "total",
    "detraccion",
)

ITEM_FIELDS = ("descripcion", "cantidad", "precio_unitario", "subtotal")


@dataclass(frozen=True)
class Settings:
    """Limits and model parameters of a run."""

    max_size_mb: float = fv.MAX_SIZE_MB
    max_pages: int = fv.MAX_PAGES
    min_page_chars: int = fv.MIN_PAGE_CHARS
    min_alphanumerics: int = fv.MIN_ALPHANUMERICS
    model: str = fv.DEFAULT_MODEL
    max_tokens: int = fv.REPLY_MAX_TOKENS
    temperature: float = fv.TEMPERATURE
    top_p: float = fv.TOP_P
    code_width: int = 8

    def __post_init__(self) -> None:
        if not 0 < self.max_size_mb <= 100:
            raise ValueError("max_size_mb must be above 0 and at most 100")
        if self.max_pages < 1:
            raise ValueError("max_pages must be at least 1")
        if not 0.0 <= self.temperature <= 2.0:
            raise ValueError("temperature must lie between 0 and 2")
        if not 1 <= self.code_width <= 64:
            raise ValueError("code_width must lie between 1 and 64")

    @property
    def max_size_bytes(self) -> int:
        return int(self.max_size_mb * fv.BYTES_PER_MB)


DEFAULTS = Settings()
