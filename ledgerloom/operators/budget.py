"""Packing of pages into token zones under a total budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv

_STATE = "struct<zone:int,used:int,total:int,placed:array<struct<page_no:int,zone:int,tokens:int>>>"


def words(text: Column) -> Column:
    """Number of runs without white space; the measure where no other one is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def packed(
    documents: DataFrame,
    sizes: tuple[int, ...] = fv.ZONE_TOKENS,
    total: int = fv.TOTAL_TOKENS,
    measure: Callable[[Column], Column] = words,
) -> DataFrame:
    """Add ``placed``: the pages that fit, each with its zone and tokens.

    Pages go in order.  A page goes into the current zone if it fits there, or else into the
    next zone that holds it; zones before it are closed from then on.  A page that fits no
    open zone, or would exceed the total, is left out, and the pages after it are still
    tried.  Pages without a token are not placed.  ``measure`` counts the tokens of a text.

    One ordered fold over the pages of a row; a placed page has a token at least, so its
    state has at most ``total`` entries.
    """
    if not sizes or min(sizes) < 1 or total < 1:
        raise ValueError("zones and total must be positive")
    pages = F.transform(
        F.col("pages"),
        lambda page: F.struct(
            page["page_no"].cast("int").alias("page_no"),
            measure(page["text"]).cast("int").alias("tokens"),
        ),
    )

    def zone_for(state: Column, tokens: Column) -> Column:
        choice = F.when(state["used"] + tokens <= _size(sizes, state["zone"]), state["zone"])
        for number, size in enumerate(sizes, 1):
            choice = choice.when((F.lit(number) > state["zone"]) & (tokens <= size), F.lit(number))
        return F.when((tokens > 0) & (state["total"] + tokens <= total), choice)

    def step(state: Column, page: Column) -> Column:
        zone = zone_for(state, page["tokens"])
        before = F.when(zone == state["zone"], state["used"]).otherwise(0)
        after = F.struct(
            zone.alias("zone"),
            (before + page["tokens"]).alias("used"),
            (state["total"] + page["tokens"]).alias("total"),
            F.concat(
                state["placed"],
                F.array(F.struct(page["page_no"].alias("page_no"), zone.alias("zone"), page["tokens"].alias("tokens"))),
            ).alias("placed"),
        )
        return F.when(zone.isNull(), state).otherwise(after.cast(_STATE))

    start = F.struct(
        F.lit(1).alias("zone"), F.lit(0).alias("used"), F.lit(0).alias("total"), F.array().alias("placed")
    ).cast(_STATE)
    folded = F.aggregate(F.coalesce(pages, F.array().cast("array<struct<page_no:int,tokens:int>>")), start, step)
    return documents.withColumn("placed", folded["placed"])


def _size(sizes: tuple[int, ...], zone: Column) -> Column:
    return F.element_at(F.array(*[F.lit(size) for size in sizes]), zone)


def page_zones(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, page_no, zone, tokens`` of each placed page."""
    return packed(documents, **options).select("doc_id", F.inline("placed"))


def zone_use(documents: DataFrame, **options) -> DataFrame:
    """Per document: tokens of each zone and in all, and pages placed and left out."""
    sizes = options.get("sizes", fv.ZONE_TOKENS)
    placed = packed(documents, **options)

    def used_in(zone: int) -> Column:
        own = F.filter("placed", lambda page: page["zone"] == zone)
        return F.aggregate(own, F.lit(0), lambda done, page: done + page["tokens"])

    used = [used_in(zone).alias(f"zone{zone}_tokens") for zone in range(1, len(sizes) + 1)]
    return placed.select(
        "doc_id",
        *used,
        F.aggregate("placed", F.lit(0), lambda done, p: done + p["tokens"]).alias("tokens"),
        F.size("placed").alias("pages_placed"),
        (F.coalesce(F.size("pages"), F.lit(0)) - F.size("placed")).alias("pages_left_out"),
    )
