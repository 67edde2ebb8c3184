"""Event enrichment: each enricher takes a frame and returns it with more metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.functions.columns import any_of, blank_to_null, rfc3339
from txguard.operators.folds import anchored
from txguard.operators.running import gap_runs
from txguard.operators.skew import DEFAULT_SKEW, Skew, input_bytes
from txguard.session_dirs import written

Enricher = Callable[[DataFrame], DataFrame]

# Fragments of user agents, first match wins.
BROWSERS = (("Edge", ("Edg/",)), ("Chrome", ("Chrome/",)), ("Firefox", ("Firefox/",)), ("Safari", ("Safari/",)), ("curl", ("curl/",)))
SYSTEMS = (("Windows", ("Windows NT",)), ("iOS", ("iPhone", "iPad")), ("Android", ("Android",)), ("MacOS", ("Mac OS X",)),
           ("Linux", ("Linux",)))
DEVICES = (("Tablet", ("iPad", "Tablet")), ("Mobile", ("Mobile", "iPhone", "Android")), ("Desktop", ("Windows NT", "Macintosh", "X11")))


def run_enrichers(df: DataFrame, enrichers: Iterable[Enricher]) -> DataFrame:
    """Apply enrichers in order. Missing inputs yield nulls, so one enricher cannot stop the next."""
    return reduce(lambda frame, enricher: frame.transform(enricher), enrichers, df)


def add_metadata(df: DataFrame, entries: dict[str, Column]) -> DataFrame:
    """Merge entries into ``metadata``; null entries are left out, other keys are kept."""
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    texts = {k: v.cast("string") for k, v in entries.items()}
    full = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)])
    some = F.map_filter(full, lambda _, v: v.isNotNull())
    complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in texts.values()])
    # Nearly always all entries are there, or the only one is missing: both stay inside generated code.
    new = F.when(complete, F.map_concat(old, full))
    return df.withColumn("metadata", new.otherwise(old if len(texts) == 1 else F.map_concat(old, some)))


def server_time(now: Column) -> Enricher:
    def apply(df: DataFrame) -> DataFrame:
        return add_metadata(df, {"server_timestamp": rfc3339(now), "enriched_at": rfc3339(now)})

    return apply


def first_match(text: Column, table: Iterable[tuple[str, tuple[str, ...]]], default: str = "Other") -> Column:
    out = F.lit(default)
    for name, fragments in reversed(list(table)):
        out = F.when(any_of([text.contains(f) for f in fragments]), name).otherwise(out)
    return F.when(text.isNotNull() & (text != ""), out)


def agent_columns(agent: Column) -> dict[str, Column]:
    return {"browser": first_match(agent, BROWSERS), "device": first_match(agent, DEVICES), "os": first_match(agent, SYSTEMS)}


def classify_agent(df: DataFrame, column: str = "user_agent") -> DataFrame:
    return df.withColumns(agent_columns(F.col(column)))


def user_agent(field: str = "user_agent") -> Enricher:
    def apply(df: DataFrame) -> DataFrame:
        # A column of its own, so that the JSON is read once and not once per pattern.
        read = df.withColumn("__agent", F.get_json_object("data", f"$.{field}"))
        return add_metadata(read, agent_columns(F.col("__agent"))).select(*df.columns)

    return apply


def range_lookup(df: DataFrame, number: str, ranges: DataFrame, values: list[str], block_bits: int = 16) -> DataFrame:
    """Left join to ranges [start_num, end_num] as an equi join; of overlapping ranges the narrowest wins, then the one that starts first.

    Ranges are cut at blocks of ``2**block_bits`` numbers and gathered to one row per block, so every event meets one row at most and is
    never doubled. Catalyst broadcasts the blocks when they are small; if not, both sides shuffle on the block, and AQE splits a block that many
    rows share. A block holds the ranges of its own numbers only.
    """
    width = (F.col("end_num") - F.col("start_num")).alias("width")
    cut = ranges.select(
        F.explode(F.sequence(F.shiftright("start_num", block_bits), F.shiftright("end_num", block_bits))).alias("__block"),
        F.struct(width, "start_num", "end_num", *values).alias("range"),
    ).groupBy("__block").agg(F.array_sort(F.collect_list("range")).alias("__ranges"))
    probe = df.withColumn("__block", F.shiftright(F.col(number), block_bits))
    covers = F.filter("__ranges", lambda r: (F.col(number) >= r["start_num"]) & (F.col(number) <= r["end_num"]))
    return probe.join(cut, "__block", "left").withColumn("__range", F.get(covers, F.lit(0))).select(
        *[probe[c] for c in df.columns], *[F.col("__range")[v].alias(v) for v in values])


def ip_number(text: Column) -> Column:
    """A dotted IPv4 address as a number; anything else is null."""
    parts = [F.split_part(text, F.lit("."), F.lit(i + 1)).try_cast("long") * 256 ** (3 - i) for i in range(4)]
    return F.when(text.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), parts[0] + parts[1] + parts[2] + parts[3])


def geo(ranges: DataFrame, field: str = "ip") -> Enricher:
    """Country and city of the client address as a JSON entry."""
    def apply(df: DataFrame) -> DataFrame:
        read = df.withColumn("__text", F.get_json_object("data", f"$.{field}"))
        looked = range_lookup(read.withColumn("__ip", ip_number(F.col("__text"))), "__ip", ranges, ["country", "city"])
        found = F.when(F.col("country").isNotNull(), F.to_json(F.struct(F.col("__text").alias("ip"), "country", "city")))
        return add_metadata(looked, {"geo": found}).select(*df.columns)

    return apply


def session_ids(df: DataFrame, user: str, ts_ms: str, ttl_ms: int = 1_800_000, out: str = "session_id",
                ties: tuple[str, ...] = (), skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Fixed-length sessions: the id names the user and the second its session began."""
    placed = anchored(df, [user], ts_ms, ttl_ms, "__start", ties, skew)
    seconds = F.floor(F.col("__start") / 1000).cast("string")
    return placed.withColumn(out, F.concat(F.lit("session_"), F.col(user).cast("string"), F.lit("_"), seconds)).drop("__start")


def sessions(field: str = "user_id", skew: Skew = DEFAULT_SKEW) -> Enricher:
    def apply(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("__user", blank_to_null(F.get_json_object("data", f"$.{field}"))).withColumn(
            "__ms", F.floor(F.unix_micros("timestamp") / 1000))
        named = session_ids(keyed, "__user", "__ms", out="__session", ties=("id",), skew=skew)
        return add_metadata(named, {"session_id": F.col("__session")}).select(*df.columns)

    apply.stateful = True
    return apply


def hit_counters(df: DataFrame, ts_ms: str = "ts_ms", idle_ms: int = 3_600_000, ties: tuple[str, ...] = ("id",),
                 skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Running counts per type and per source that restart after ``idle_ms`` without a hit.

    The few types and sources of a larger input are hot keys, whose rows are read several times: the frame is written between both counts.
    """
    typed = gap_runs(df, ["type"], ts_ms, idle_ms, ties, "__run", "event_count", skew).drop("__run")
    if input_bytes(df) >= skew.min_bytes:
        typed = written(typed, "typed")
    return gap_runs(typed, ["source"], ts_ms, idle_ms, ties, "__run", "source_count", skew).drop("__run")


def counters(skew: Skew = DEFAULT_SKEW) -> Enricher:
    def apply(df: DataFrame) -> DataFrame:
        timed = df.withColumn("__ms", F.floor(F.unix_micros("timestamp") / 1000))
        if input_bytes(timed) >= skew.min_bytes:
            timed = written(timed, "before-counters")
        counted = hit_counters(timed, "__ms", skew=skew)
        return add_metadata(counted, {"event_count": F.col("event_count"), "source_count": F.col("source_count")}).select(*df.columns)

    apply.stateful = True
    return apply


def default_enrichers(now: Column, ranges: DataFrame, skew: Skew = DEFAULT_SKEW) -> list[Enricher]:
    """Time, geography, user agent, session, counters."""
    return [server_time(now), geo(ranges), user_agent(), sessions(skew=skew), counters(skew)]


def enrichment_stats(df: DataFrame, *failed: Column) -> DataFrame:
    """Events processed, events that left the chain, and errors: one for each enricher of each event that found its input unusable."""
    return df.agg(
        F.count(F.lit(1)).alias("processed"), F.count(F.lit(1)).alias("enriched"),
        F.coalesce(F.sum(reduce(lambda a, b: a + b, [f.cast("long") for f in failed])), F.lit(0)).alias("errors"),
    )
