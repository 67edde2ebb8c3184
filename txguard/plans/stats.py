"""Event statistics, latency histograms and decision KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.functions.columns import safe_ratio, window_label

# Default latency bucket bounds in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def tumbling_counts(df: DataFrame, by: str, seconds: int = 60) -> DataFrame:
    """Events per ``by`` (type or source) and window. A hot type combines on the map side before the shuffle."""
    return df.groupBy(window_label(F.col("timestamp"), seconds).alias("window_start"), by).agg(
        F.count(F.lit(1)).alias("count")
    )


def current_window(df: DataFrame, by: str, as_of: Column, seconds: int = 60) -> DataFrame:
    """Counts of the window holding ``as_of``. The bounds reach the scan as a plain time filter."""
    start = window_label(as_of, seconds)
    end = F.timestamp_seconds(F.unix_seconds(start) + seconds)
    inside = df.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return inside.groupBy(by).agg(F.count(F.lit(1)).alias("count"))


def stats_query(df: DataFrame, as_of: Column, seconds: int = 60, event_type: str | None = None, source: str | None = None) -> DataFrame:
    """Statistics of one type, of one source, or of all types, for a window of any size."""
    if event_type is not None:
        return current_window(df.where(F.col("type") == event_type), "type", as_of, seconds)
    if source is not None:
        return current_window(df.where(F.col("source") == source), "source", as_of, seconds)
    return current_window(df, "type", as_of, seconds)


def hopping_counts(df: DataFrame, by: str, window_s: int, slide_s: int) -> DataFrame:
    """Events per ``by`` and overlapping window.

    Where the window is a whole number of slides, events are counted per slide first, so that the expansion into
    overlapping windows touches counts and not events.
    """
    window, slide = f"{window_s} seconds", f"{slide_s} seconds"
    if window_s % slide_s:
        direct = df.groupBy(F.window("timestamp", window, slide).alias("h"), by).agg(F.count(F.lit(1)).alias("count"))
        return direct.select(F.col("h.start").alias("window_start"), by, "count")
    slid = df.groupBy(F.window("timestamp", slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return (
        slid.groupBy(F.window(F.col("w.start"), window, slide).alias("h"), by)
        .agg(F.sum("n").alias("count"))
        .select(F.col("h.start").alias("window_start"), by, "count")
    )


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("count"))


def latency_histogram(df: DataFrame, seconds: Column, by: Sequence[str] = (), buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative buckets, sum and count of a latency, one row per bucket (``+Inf`` last)."""
    measured = df.withColumn("__s", seconds)
    totals = measured.groupBy(*by).agg(
        *[F.count_if(F.col("__s") <= b).alias(f"__b{i}") for i, b in enumerate(buckets)],
        F.count("__s").alias("total"), F.sum("__s").alias("sum_seconds"),
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"__b{i}").alias("count")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("count")))
    return totals.select(*by, F.inline(F.array(*rows)), "total", "sum_seconds")


def fraud_kpis(df: DataFrame, fraud: Column, blocks: Column, card: str = "card_id") -> DataFrame:
    """Checked, detected, cards blocked and the detection rate in percent."""
    out = df.agg(
        F.count(F.lit(1)).alias("total_checked"), F.count_if(fraud).alias("fraud_detected"),
        F.count_distinct(F.when(blocks, F.col(card))).alias("cards_blocked"),
    )
    rate = safe_ratio(F.col("fraud_detected") * 100.0, F.col("total_checked"))
    return out.withColumn("fraud_rate", F.coalesce(rate, F.lit(0.0)))


def rule_trigger_counts(df: DataFrame) -> DataFrame:
    """How often each rule fired."""
    return df.select(F.explode("triggered_rules").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("count"))


def limiter_usage(df: DataFrame, client: str, admitted: str, rate: int) -> DataFrame:
    """Requests left in each client's latest window; ``admitted`` is the output of the rate limiter."""
    last = df.groupBy(client).agg(F.max(F.struct("window_start", admitted)).alias("last"))
    left = F.greatest(F.lit(rate) - F.col(f"last.{admitted}"), F.lit(0))
    return last.select(client, F.col("last.window_start").alias("window_start"), left.alias("remaining"))


def active_clients(df: DataFrame, client: str) -> DataFrame:
    return df.agg(F.count_distinct(client).alias("active_clients"))


def dashboard(df: DataFrame) -> DataFrame:
    """Total events and events per second over the observed span."""
    micros = F.unix_micros("timestamp")
    out = df.agg(F.count(F.lit(1)).alias("total_events"), ((F.max(micros) - F.min(micros)) / 1_000_000).alias("elapsed_seconds"))
    return out.withColumn("events_per_second", safe_ratio(F.col("total_events"), F.col("elapsed_seconds")))
