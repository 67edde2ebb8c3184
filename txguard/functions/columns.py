"""Scalar expressions shared by the plans; everything here stays inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def json_number(doc: Column, field: str) -> Column:
    """A numeric JSON field; missing or not a number reads as 0."""
    return F.coalesce(F.get_json_object(doc, f"$.{field}").try_cast("double"), F.lit(0.0))


def json_text(doc: Column, field: str) -> Column:
    """A text JSON field; missing reads as the empty string."""
    return F.coalesce(F.get_json_object(doc, f"$.{field}"), F.lit(""))


def epoch_ms(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 1000).cast("long")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_partition(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def window_label(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window holding ``ts``."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def whole_units(amount: Column) -> Column:
    """Spend counters keep whole units only."""
    return amount.cast("long")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
