"""The registered queries, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txguard.operators.folds import admit_anchored, token_bucket
from txguard.operators.running import as_of, distinct_in_run, gap_runs
from txguard.operators.skew import Skew
from txguard.operators.sliding import HOUR, MINUTE, Sliding, sliding
from txguard.plans import admission, banking, baselines, blocks, daily, dlq, enrich, events, features, legacy, limits, rules, scoring, stats
from txguard.plans.engine import decide, precheck_decision, precheck_reason
from txguard.sources import event_table, tables
from txguard.functions.columns import json_number, json_text
from txguard.session_dirs import scratch
from txguard.sources.storage import decode, explode_batches, read_json_events, retained, split_decoded

AS_OF = "2024-01-30"
# Spending limits of the demonstration data, default and per card.
LIMITS = limits.Limits(150.0, 200.0, 1500.0)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _tx(spark: SparkSession, sf: str) -> DataFrame:
    return tables.transactions(spark, sf)


def _micros(col: str) -> F.Column:
    return F.unix_micros(col).alias(col)


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    tx = _tx(spark, sf)
    return decide(tx, merchants=baselines.merchant_risk(tx, AS_OF))


def _custom_limits(tx: DataFrame) -> DataFrame:
    own = tx.select("card_id").distinct().where(F.col("card_id") % 10 == 0)
    return own.select("card_id", F.lit(100.0).alias("transaction_limit"), F.lit(150.0).alias("daily_limit"),
                      F.lit(1000.0).alias("monthly_limit"))


def _block_log(spark: SparkSession, sf: str) -> DataFrame:
    """Error events block their card, sign-ups unblock it."""
    ev = tables.table(spark, sf, "events").where(F.col("event_type").isin("error", "signup"))
    return ev.select(
        F.col("user_id").alias("card_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts_ms"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "block").otherwise("unblock").alias("command"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("reason"),
    )


# --- sliding features -------------------------------------------------------------------------------------------------


@query
def tx_counts_sliding(spark, sf):
    specs = features.CARD[:4]
    out = features.card_features(_tx(spark, sf).select("transaction_id", "card_id", "ts_ms"), specs)
    return out.select("transaction_id", *[s.name for s in specs])


@query
def amount_sums_sliding(spark, sf):
    specs = features.CARD[4:6]
    out = features.card_features(_tx(spark, sf).select("transaction_id", "card_id", "ts_ms", "amount"), specs)
    return out.select("transaction_id", *[F.round(s.name, 2).alias(s.name) for s in specs])


@query
def unique_merchants_countries(spark, sf):
    specs = features.CARD[6:]
    return features.card_features(_tx(spark, sf), specs).select("transaction_id", *[s.name for s in specs])


@query
def customer_features(spark, sf):
    return features.customer_features(_tx(spark, sf)).select("transaction_id", "customer__device_count", "customer__country_count")


@query
def device_card_count(spark, sf):
    return features.device_features(_tx(spark, sf)).select("transaction_id", "device__card_count")


@query
def amount_ratio_24h(spark, sf):
    out = features.amount_ratio(_tx(spark, sf))
    return out.select("transaction_id", F.round("card__amount_ratio_vs_avg24h", 6).alias("card__amount_ratio_vs_avg24h"))


def _snapshot_columns(out):
    exact = [s.name for s in (*features.CARD, *features.CUSTOMER, *features.DEVICE) if s.kind != "sum"]
    rounded = ["card__amount_sum_1h", "card__amount_sum_24h"]
    return out.select(
        "transaction_id", *exact, *[F.round(c, 2).alias(c) for c in rounded],
        F.round("card__amount_ratio_vs_avg24h", 6).alias("card__amount_ratio_vs_avg24h"),
    )


def _stretched(tx, micros):
    """The transactions with ``ts_ms`` counting steps of ``micros`` microseconds: 20,000 make 36 hours of the month, 500 make 60 days."""
    return tx.withColumn("ts_ms", F.unix_micros("ts")).withColumn("ts_ms", F.expr(f"ts_ms div {micros}"))


def _crowded(tx):
    """A third of the transactions on one card, customer and device."""
    third = F.col("event_id") % 3 == 0
    return tx.withColumns({c: F.when(third, F.lit(1).cast("long")).otherwise(F.col(c)) for c in ("card_id", "customer_id", "device_id")})


# Finds the crowded keys of the small tables as well, and cuts them into slices of five minutes.
_FINE = Skew(frame_rows=60, slice_ms=5 * MINUTE)


@query
def feature_snapshot(spark, sf):
    return _snapshot_columns(features.snapshot(_tx(spark, sf)))


@query
def feature_snapshot_36h(spark, sf):
    """The month read as 36 hours: rows leave the frames of one hour and of a day."""
    return _snapshot_columns(features.snapshot(_stretched(_tx(spark, sf), 20_000)))


@query
def feature_snapshot_60d(spark, sf):
    """The month read as 60 days: rows leave every frame."""
    return _snapshot_columns(features.snapshot(_stretched(_tx(spark, sf), 500)))


@query
def amount_sums_hot(spark, sf):
    """Sums of a crowded card, by slices."""
    tx = _stretched(_crowded(_tx(spark, sf)), 20_000)
    out = features.with_amount_ratio(features.card_features(tx, [*features.CARD[4:6], *features.PRIOR], _FINE))
    return out.select("transaction_id", F.round("card__amount_sum_1h", 2).alias("card__amount_sum_1h"), F.round("card__amount_sum_24h", 2).alias(
        "card__amount_sum_24h"), F.round("card__amount_ratio_vs_avg24h", 6).alias("card__amount_ratio_vs_avg24h"))


@query
def distinct_hot(spark, sf):
    """Counts and distincts of a crowded card, customer and device, by entries and exits."""
    tx = _stretched(_crowded(_tx(spark, sf)), 500)
    out = features.customer_features(features.device_features(features.card_features(tx, [*features.CARD[:4], *features.CARD[6:]], _FINE), _FINE), _FINE)
    return out.select("transaction_id", *[s.name for s in (*features.CARD[:4], *features.CARD[6:], *features.CUSTOMER, *features.DEVICE)])


@query
def short_window_expiry(spark, sf):
    """Windows much shorter than the data, so that every row also leaves its frames."""
    specs = [Sliding("n_10s", "count", 10_000), Sliding("merchants_30s", "distinct", 30_000, "merchant_id"),
             Sliding("prior_1m", "count", MINUTE, prior=True)]
    return sliding(_tx(spark, sf), ["card_id"], "ts_ms", specs).select("transaction_id", *[s.name for s in specs])


@query
def ttl_session_distinct(spark, sf):
    names = ("card__unique_merchants_1h", "device__card_count")
    tx = _tx(spark, sf)
    out = features.ttl_sessions(tx, names)
    out = distinct_in_run(out, ["card_id"], "ts_ms", "merchant_id", MINUTE, "merchants_idle_1m", ["transaction_id"])
    return out.select("transaction_id", *names, "merchants_idle_1m")


@query
def gap_reset_counters(spark, sf):
    out = enrich.hit_counters(tables.events(spark, sf), "ts_ms", 300)
    return out.select("id", "event_count", "source_count")


@query
def recent_declines(spark, sf):
    tx = _tx(spark, sf)
    out = features.recent_declines(tx, F.col("amount") > LIMITS.transaction, 2 * MINUTE)
    return out.select("transaction_id", "card__declines_30m")


# --- baselines --------------------------------------------------------------------------------------------------------


@query
def card_baselines(spark, sf):
    out = baselines.card_baselines(_tx(spark, sf), AS_OF)
    return out.select("card_id", "card__tx_count_30d", "card__tx_count_7d", "card__unique_merchants_30d",
                      *[F.round(c, 2).alias(c) for c in ("card__amount_sum_30d", "card__amount_avg_30d")])


@query
def card_baselines_orders(spark, sf):
    """Customer baselines over the order history, excluding the reference day."""
    orders = tables.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("card_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderpriority").alias("merchant_id"),
    )
    out = baselines.card_baselines(orders, "1998-07-01", strict=True, every=orders.select("card_id").distinct())
    return out.select("card_id", "card__tx_count_30d", "card__tx_count_7d", "card__unique_merchants_30d",
                      F.round("card__amount_sum_30d", 2).alias("card__amount_sum_30d"))


@query
def merchant_risk(spark, sf):
    out = baselines.merchant_risk(_tx(spark, sf), AS_OF)
    return out.select("merchant_id", "merchant__tx_count_30d", "merchant__fraud_count_30d",
                      F.round("merchant__fraud_rate_30d", 6).alias("merchant__fraud_rate_30d"))


@query
def approx_merchants(spark, sf):
    """Whether the sketch is within its error of the exact count, for every card."""
    tx = _tx(spark, sf)
    exact, rough = (baselines.card_baselines(tx, AS_OF, exact=e).select("card_id", F.col("card__unique_merchants_30d").alias(n))
                    for e, n in ((True, "exact"), (False, "rough")))
    error = F.abs(F.col("rough") - F.col("exact"))
    return exact.join(rough, "card_id").select("card_id", (error <= 0.05 * F.col("exact") + 1).alias("close"))


def _daily(spark, sf):
    """Daily partials of the transactions in three batches, one of them delivered twice; each batch holds rows of every day."""
    path, tx = scratch(spark, "daily"), _tx(spark, sf)
    for batch in (0, 1, 1, 2):
        daily.add_batch(tx.where(F.col("event_id") % 3 == batch), path, batch)
    return path


@query
def daily_card_baselines(spark, sf):
    """Card baselines from daily partials, and whether their sketches are within their error."""
    out = daily.card_baselines(spark, _daily(spark, sf), AS_OF)
    exact = baselines.card_baselines(_tx(spark, sf), AS_OF).select(F.col("card_id").cast("string").alias("card_id"), F.col("card__unique_merchants_30d").alias("exact"))
    error = F.abs(F.col("card__unique_merchants_30d") - F.col("exact"))
    return out.join(exact, "card_id", "left").select(
        F.col("card_id").cast("long").alias("card_id"), "card__tx_count_30d", "card__tx_count_7d",
        *[F.round(c, 2).alias(c) for c in ("card__amount_sum_30d", "card__amount_avg_30d")], (error <= 0.05 * F.col("exact") + 1).alias("close"))


@query
def daily_merchant_risk(spark, sf):
    out = daily.merchant_risk(spark, _daily(spark, sf), AS_OF)
    return out.select(F.col("merchant_id").cast("long").alias("merchant_id"), "merchant__tx_count_30d", "merchant__fraud_count_30d",
                      F.round("merchant__fraud_rate_30d", 6).alias("merchant__fraud_rate_30d"))


@query
def json_fields(spark, sf):
    """Number and text fields of JSON payloads, present and absent."""
    ev = tables.events(spark, sf)
    return ev.select("id", json_number(F.col("props"), "k").alias("k"), json_number(F.col("props"), "none").alias("absent"),
                     json_text(F.col("props"), "k").alias("text"), json_text(F.col("props"), "none").alias("no_text"))


@query
def json_event_source(spark, sf):
    """Events written as JSON lines and read by the event source."""
    ev = tables.events(spark, sf).select("id", "type", "source", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                                         F.col("props").alias("data"))
    path = scratch(spark, "json-events")
    ev.write.json(path)
    return read_json_events(spark, path).select("id", "type", "source", F.unix_seconds("timestamp").alias("seconds"), "data")


@query
def dedup_null_ids(spark, sf):
    """Events twice over, a seventh of them without id: ids stay once, events without one all stay."""
    ev = tables.events(spark, sf).select(F.when(F.col("event_id") % 7 != 0, F.col("id")).alias("id"), "event_id", "timestamp")
    return events.deduplicate(ev.unionByName(ev.where("id is not null"))).select("id", "event_id")


@query
def overlapping_ranges(spark, sf):
    """A small range inside each block's: the narrower one wins, and no event is doubled."""
    blocks = tables.geo_ranges(spark, sf).select("start_num", "end_num", F.lit("block").alias("place"))
    corners = tables.geo_ranges(spark, sf).select(
        F.explode(F.sequence("start_num", "end_num", F.lit(256).cast("long"))).alias("start_num")).select(
        "start_num", (F.col("start_num") + 15).alias("end_num"), F.lit("corner").alias("place"))
    more = F.lit(185 * 16777216 + 25 * 65536).cast("long")
    rest = spark.range(5).select((more + F.col("id") * 65536).alias("start_num"), (more + F.col("id") * 65536 + 15).alias("end_num"), F.lit("corner").alias("place"))
    return enrich.range_lookup(tables.events(spark, sf), "ip_num", blocks.unionByName(corners).unionByName(rest), ["place"]).select("id", "place")


@query
def amount_ratio_30d(spark, sf):
    tx = _tx(spark, sf)
    out = baselines.with_baselines(tx, baselines.card_baselines(tx, AS_OF), baselines.merchant_risk(tx, AS_OF))
    return out.select("transaction_id", F.round("card__amount_ratio_vs_avg30d", 6).alias("card__amount_ratio_vs_avg30d"),
                      F.round("merchant__fraud_rate_30d", 6).alias("merchant__fraud_rate_30d"))


@query
def asof_feature_join(spark, sf):
    """The customer's latest earlier order, read as of every event."""
    ev = tables.table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"),
                                                  F.expr("unix_micros(cast(ts as timestamp))").alias("at"))
    od = tables.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.expr("unix_micros(cast(o_orderdate as timestamp)) + 31536000000000 * 3").alias("order_at"),
        "o_orderkey",
    )
    return as_of(ev, od, ["k"], "at", ["o_orderkey"], right_ts="order_at").select("event_id", "o_orderkey")


# --- rules and decisions ----------------------------------------------------------------------------------------------


@query
def risk_decisions(spark, sf):
    out = _decided(spark, sf)
    return out.select(
        "transaction_id", F.col("risk_score").cast("long").alias("risk_score"), "action",
        F.array_join("reason_codes", ",").alias("reason_codes"), F.array_join("triggered_rules", ",").alias("triggered_rules"),
        F.array_join("explain_lines", "|").alias("explain_lines"),
    )


@query
def rule_versions(spark, sf):
    """Two versions of a rule set, from the 8th and from the 20th of January; rules of several conditions and comparisons."""
    rule, test = rules.Rule, rules.Condition
    large, small, seven = (test("amount", ">=", 40.0),), (test("amount", "<", 10.0), test("merchant_id", "<=", 20.0)), (test("merchant_id", "==", 7.0),)
    versions = {
        1_704_672_000: [rule("large", "large", 2, large, 300, "review", "L"), rule("small", "small", 1, small, 400, "alert", "S"),
                        rule("off", "off", 9, large, 900, "block", "O", enabled=False)],
        1_705_708_800: [rule("large", "larger", 2, (test("amount", ">", 80.0),), 600, "decline", "L"), rule("seven", "seven", 3, seven, 150, "alert", "7")],
    }
    out = scoring.score(_tx(spark, sf), rules.valid_from(versions))
    return out.select("transaction_id", F.col("risk_score").cast("long").alias("risk_score"), "action", F.array_join("triggered_rules", ",").alias("triggered_rules"))


@query
def rule_problems(spark, sf):
    """A rule for each event, with mistakes of every kind: how many rules have which problem, by points."""
    n = F.col("event_id")
    feature, operator = F.when(n % 23 != 0, "amount").otherwise(""), F.when(n % 19 == 0, "~").when(n % 2 == 0, ">").otherwise("<=")
    condition = F.struct(feature.alias("feature"), operator.alias("operator"), F.col("value").alias("threshold"))
    frame = tables.events(spark, sf).select(
        F.col("event_id").alias("position"), F.when(n % 41 == 0, None).when(n % 10 == 1, (n - 1).cast("string")).otherwise(n.cast("string")).alias("id"),
        F.when(n % 29 != 0, F.array(condition, condition)).alias("conditions"), (n % 1100 - 10).cast("int").alias("risk_points"))
    return rules.rule_problems(frame, "position").select("position", "id", "problem")


@query
def rules_fired_long(spark, sf):
    tx = _tx(spark, sf)
    feats = baselines.with_baselines(features.snapshot(tx), None, baselines.merchant_risk(tx, AS_OF))
    return rules.fired_long(feats, rules.DEFAULT_RULES).select(
        "transaction_id", "rule_id", F.col("risk_points").cast("long").alias("risk_points"), "action", "reason_code",
        F.round(F.aggregate(F.map_values("details"), F.lit(0.0), lambda a, x: a + x), 4).alias("detail_sum"),
    )


@query
def rules_fired_relational(spark, sf):
    tx = _tx(spark, sf)
    feats = baselines.with_baselines(features.snapshot(tx), None, baselines.merchant_risk(tx, AS_OF))
    table = rules.rules_frame(spark, rules.DEFAULT_RULES)
    return rules.fired_relational(feats, table).select(
        "transaction_id", "rule_id", F.col("risk_points").cast("long").alias("risk_points"), "action", "reason_code"
    )


@query
def rule_trigger_counts(spark, sf):
    return stats.rule_trigger_counts(_decided(spark, sf))


@query
def score_bands(spark, sf):
    """Transactions per action that the score alone would give."""
    banded = _decided(spark, sf).withColumn("band", scoring.action_name(scoring.band_severity(F.col("risk_score"))))
    return stats.status_counts(banded, "band")


@query
def contributing_features(spark, sf):
    """How often each feature contributed to a decision, and its mean value then."""
    out = _decided(spark, sf).select(F.explode("contributing_features").alias("feature", "value"))
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query
def precheck_failures(spark, sf):
    """Amounts shifted and cards blanked, so that each pre-check fails somewhere."""
    tx = _tx(spark, sf).withColumns({
        "amount": F.col("amount") - 5, "card_id": F.when(F.col("event_id") % 97 != 0, F.col("card_id")),
    })
    bad = tx.withColumn("precheck_reason", precheck_reason()).where("precheck_reason is not null")
    return precheck_decision(bad).select(
        "transaction_id", F.col("risk_score").cast("long").alias("risk_score"), "action",
        F.array_join("explain_lines", "|").alias("explain_lines"),
    )


@query
def decisions_with_block_log(spark, sf):
    """Decisions under a given block log: refused rows leave no trace in the features of the others."""
    out = decide(_tx(spark, sf), [rules.DEFAULT_RULES[1]], block_log=_block_log(spark, sf), block_ttl_ms=2 * MINUTE)
    return out.select("transaction_id", F.col("risk_score").cast("long").alias("risk_score"), "action", "precheck_reason")


def _legacy_input(spark, sf):
    tx = _tx(spark, sf)
    return tx.withColumns({
        "location": F.concat_ws(":", "country", "country"),
        "ip": F.concat(F.lit("10.0."), (F.col("card_id") % 200).cast("string"), F.lit("."), (F.col("event_id") % 8).cast("string")),
        "mcc": F.when(F.col("merchant_id") < 3, "7995").when(F.col("merchant_id") < 5, "6051").otherwise("5411"),
    })


@query
def legacy_best_rule(spark, sf):
    tx = _legacy_input(spark, sf)
    blacklist = tx.where(F.col("fraud_label") == "confirmed").select("ip")
    return legacy.detect(tx, blacklist).select("transaction_id", "is_fraud", "confidence", "triggered_rule", "action", "reason")


@query
def legacy_auto_block(spark, sf):
    """Transactions refused because an earlier one of the card came from a listed address."""
    tx = _legacy_input(spark, sf)
    found = legacy.detect(tx, tx.where(F.col("fraud_label") == "confirmed").select("ip"))
    out = blocks.block_feedback(found, legacy.auto_block(found))
    return out.where(F.col("blocked_by_ms").isNotNull()).select("transaction_id", "blocked_by_ms")


@query
def feature_maps(spark, sf):
    """Card features and baselines merged into one map; baselines come later and win."""
    tx = _tx(spark, sf)
    feats = baselines.with_baselines(features.card_features(tx, features.CARD[:2]), baselines.card_baselines(tx, AS_OF))
    merged = feats.select("transaction_id", features.feature_map(["card__tx_count_1m", "card__tx_count_5m"]).alias("a"),
                          features.feature_map(["card__tx_count_30d", "card__tx_count_7d"]).alias("b"))
    m = features.merge_features("a", "b")
    return merged.select("transaction_id", F.size(m).cast("long").alias("n"), m["card:tx_count_1m"].alias("one_minute"),
                         m["card:tx_count_7d"].alias("seven_days"))


@query
def location_anomaly(spark, sf):
    out = legacy.previous_location(_legacy_input(spark, sf), 20_000)
    return out.where(F.col("previous_location") != F.col("location")).select("transaction_id", "previous_location", "location")


@query
def legacy_velocity(spark, sf):
    return legacy.velocity(_tx(spark, sf)).where("velocity_count > 5").select("transaction_id", "velocity_count")


@query
def legacy_device_spread(spark, sf):
    return legacy.device_spread(_tx(spark, sf), MINUTE).select("transaction_id", "device_count")


@query
def fraud_kpis(spark, sf):
    out = stats.fraud_kpis(_decided(spark, sf), F.col("action").isin("decline", "block"), F.col("action") == "block")
    return out.select("total_checked", "fraud_detected", "cards_blocked", F.round("fraud_rate", 4).alias("fraud_rate"))


@query
def fraud_events(spark, sf):
    """Declined transactions as analytics events."""
    out = banking.fraud_event(_decided(spark, sf))
    return out.select("id", "type", "source", _micros("timestamp"),
                      F.get_json_object("data", "$.risk_score").cast("long").alias("risk_score"),
                      F.get_json_object("data", "$.transaction_id").alias("transaction_id"))


# --- limits -----------------------------------------------------------------------------------------------------------


@query
def limits_attempted(spark, sf):
    tx = _tx(spark, sf)
    out = limits.attempted_check(limits.with_limits(tx, _custom_limits(tx), LIMITS))
    return out.select("transaction_id", "day_before", "month_before", "limit_reason")


@query
def limits_greedy(spark, sf):
    tx = _tx(spark, sf).select("transaction_id", "card_id", "amount", "ts")
    out = limits.enforce(limits.with_limits(tx, _custom_limits(tx), LIMITS))
    return out.select("transaction_id", "limit_reason", "day_spent", "month_spent")


@query
def limit_decline_counts(spark, sf):
    tx = _tx(spark, sf).select("transaction_id", "card_id", "amount", "ts")
    out = limits.enforce(limits.with_limits(tx, None, LIMITS))
    return stats.status_counts(out.withColumn("status", F.coalesce("limit_reason", F.lit("approved"))))


@query
def limits_status(spark, sf):
    tx = _tx(spark, sf)
    return limits.limits_status(tx, "2024-01-15", _custom_limits(tx), LIMITS)


@query
def spend_counters(spark, sf):
    tx = _tx(spark, sf)
    daily = limits.spend_counters(tx, "day").select("card_id", F.col("day").alias("period"), "spent")
    monthly = limits.spend_counters(tx, "month").select("card_id", F.col("month").alias("period"), "spent")
    return daily.unionByName(monthly)


# --- blocks -----------------------------------------------------------------------------------------------------------


@query
def blocklist_interval_join(spark, sf):
    out = blocks.blocked_at(_tx(spark, sf), _block_log(spark, sf), 5 * MINUTE)
    return out.select("transaction_id", "blocked")


@query
def block_command_log(spark, sf):
    log = _block_log(spark, sf)
    now = 1_706_500_000
    return blocks.current_blocks(log, now, 6 * MINUTE).select("card_id", "blocked_at", "reason")


@query
def ip_blocklist_split(spark, sf):
    tx = _legacy_input(spark, sf)
    listed, _ = blocks.split_by_list(tx, tx.where(F.col("fraud_label") == "confirmed").select("ip"), "ip")
    return listed.select("transaction_id", "ip")


def _velocity(spark, sf):
    return features.card_features(_tx(spark, sf), features.CARD[:1])


@query
def block_feedback_permanent(spark, sf):
    out = blocks.block_feedback(_velocity(spark, sf), F.col("card__tx_count_1m") > 5)
    return out.select("transaction_id", "blocked_by_ms")


@query
def block_feedback_windows(spark, sf):
    """Blocks of two minutes, from given decisions."""
    out = blocks.block_feedback(_velocity(spark, sf), F.col("card__tx_count_1m") > 5, 2 * MINUTE)
    return out.select("transaction_id", "blocked_by_ms")


@query
def block_feedback_ttl(spark, sf):
    """Blocks of two minutes where refused rows leave no trace in the velocity count."""
    tx = limits.with_periods(limits.with_limits(_tx(spark, sf).withColumn("precheck_reason", precheck_reason())))
    out = banking.decide_in_order(tx, [rules.DEFAULT_RULES[0]], block_ttl_ms=2 * MINUTE)
    state = F.when(F.array_contains("reason_codes", "PRE_CHECK_FAILED"), "blocked").when(F.col("action") == "block", "blocks")
    return out.select("transaction_id", state.otherwise("passed").alias("state"))


@query
def banking_outcomes(spark, sf):
    tx = _tx(spark, sf)
    prepared = banking.prepare(tx, _custom_limits(tx), LIMITS, merchants=baselines.merchant_risk(tx, AS_OF))
    return _outcome_columns(banking.decide_in_order(prepared))


@query
def banking_outcomes_default_limits(spark, sf):
    """The default limits and rules without the velocity block: most cards need no fold."""
    tx = _tx(spark, sf)
    calm = [r for r in rules.DEFAULT_RULES if r.id not in ("velocity_1m", "geo_spread")]
    prepared = banking.prepare(tx, merchants=baselines.merchant_risk(tx, AS_OF))
    out = banking.response_annotation(banking.decide_where_needed(prepared, calm))
    return out.select("transaction_id", "status", F.col("risk_score").cast("long").alias("risk_score"), "action",
                      F.array_join("triggered_rules", ",").alias("triggered_rules"), "risk_note",
                      F.round("remaining_limit", 2).alias("remaining_limit"))


def _outcome_columns(out):
    return banking.response_annotation(out).select(
        "transaction_id", "status", "limit_reason", F.col("risk_score").cast("long").alias("risk_score"), "action",
        F.array_join("triggered_rules", ",").alias("triggered_rules"), "risk_note", F.round("remaining_limit", 2).alias("remaining_limit"))


@query
def banking_where_needed(spark, sf):
    """All rules and limits that bind: cards on which something is refused are folded, the others are not."""
    tx = _tx(spark, sf)
    prepared = banking.prepare(tx, _custom_limits(tx), limits.Limits(480.0, 2000.0, 8000.0), merchants=baselines.merchant_risk(tx, AS_OF))
    return _outcome_columns(banking.decide_where_needed(prepared))


@query
def banking_with_commands(spark, sf):
    """Operators block and unblock cards while the engine decides."""
    tx = _tx(spark, sf)
    prepared = banking.prepare(tx, _custom_limits(tx), limits.Limits(480.0, 2000.0, 8000.0), merchants=baselines.merchant_risk(tx, AS_OF),
                               commands=_block_log(spark, sf))
    return _outcome_columns(banking.decide_where_needed(prepared, block_ttl_ms=10 * MINUTE))


@query
def outcome_counts(spark, sf):
    """Transactions by status of the full decision."""
    return stats.status_counts(banking_outcomes(spark, sf))


# --- sessions and admission -------------------------------------------------------------------------------------------


@query
def fixed_sessions(spark, sf):
    ev = tables.events(spark, sf).withColumn("ms", F.expr("unix_micros(timestamp) div 1000"))
    return enrich.session_ids(ev.select("id", "user_id", "ms"), "user_id", "ms", 36 * HOUR, ties=("id",)).select("id", "session_id")


@query
def gap_sessions(spark, sf):
    out = gap_runs(tables.events(spark, sf), ["user_id"], "ts_ms", 30_000, ["id"], "session_start", "position")
    return out.groupBy("user_id", "session_start").agg(F.max("position").alias("events"), F.max("ts_ms").alias("session_end"))


@query
def rate_limit_calendar(spark, sf):
    ev = tables.events(spark, sf)
    return admission.admit_calendar(ev, "user_id", "ts_ms", 2, 20_000, ["id"]).select("id", "used", "allowed")


@query
def rate_limit_anchored(spark, sf):
    ev = tables.events(spark, sf).select("id", "user_id", "ts_ms")
    return admit_anchored(ev, "user_id", "ts_ms", 2, 60_000, ties=["id"]).select("id", "used", "allowed")


@query
def rate_limit_weighted(spark, sf):
    """Requests weigh 1 to 3; purchases reset the client's window."""
    ev = tables.events(spark, sf).withColumn("weight", F.col("event_id") % 3 + 1)
    resets = ev.where(F.col("type") == "purchase").select("user_id", "ts_ms")
    return admit_anchored(ev.select("id", "user_id", "ts_ms", "weight"), "user_id", "ts_ms", 5, 60_000, "weight", resets, ["id"]).select("id", "used", "allowed")


@query
def token_bucket_admission(spark, sf):
    ev = tables.events(spark, sf).withColumn("ms", F.expr("unix_micros(timestamp) div 1000"))
    out = token_bucket(ev.select("id", "user_id", "ms"), "user_id", "ms", 1 / 32768, 3, ["id"])
    return out.select("id", "allowed", F.round("tokens", 6).alias("tokens"))


@query
def rule_cooldown(spark, sf):
    return _cooled(_tx(spark, sf))


@query
def rule_cooldown_36h(spark, sf):
    """The month read as 36 hours: cooldowns of one and two hours end."""
    return _cooled(_stretched(_tx(spark, sf), 20_000))


def _cooled(tx):
    feats = features.snapshot(tx)
    fired = rules.fired_long(feats, rules.DEFAULT_RULES).select("card_id", "ts_ms", "transaction_id", "rule_id")
    return admission.with_cooldown(fired, rules.DEFAULT_RULES).where("not suppressed").select("transaction_id", "rule_id")


@query
def limiter_remaining(spark, sf):
    used = admission.admit_calendar(tables.events(spark, sf), "user_id", "ts_ms", 4, 60_000, ["id"])
    return stats.limiter_usage(used, "user_id", "used", 4)


@query
def active_clients(spark, sf):
    ev = tables.events(spark, sf).withColumn("client", events.client_id(
        F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("string")).otherwise(""), F.col("source"), F.lit("0.0.0.0")))
    return stats.active_clients(ev, "client")


# --- events -----------------------------------------------------------------------------------------------------------


@query
def type_stats_tumbling(spark, sf):
    return stats.tumbling_counts(tables.events(spark, sf), "type", 3600).select(_micros("window_start"), "type", "count")


@query
def source_stats_tumbling(spark, sf):
    return stats.tumbling_counts(tables.events(spark, sf), "source", 600).select(_micros("window_start"), "source", "count")


@query
def current_window_stats(spark, sf):
    at = F.lit("2024-01-15 12:34:56").cast("timestamp")
    return stats.stats_query(tables.events(spark, sf), at, 86_400)


@query
def stats_one_source(spark, sf):
    at = F.lit("2024-01-20 03:00:00").cast("timestamp")
    return stats.stats_query(tables.events(spark, sf), at, 7 * 86_400, source="mobile")


@query
def hopping_counts(spark, sf):
    return stats.hopping_counts(tables.events(spark, sf), "type", 6 * 3600, 3600).select(_micros("window_start"), "type", "count")


def _submitted(spark, sf):
    """Events as submitted: some without id, some without type."""
    return tables.events(spark, sf).withColumns({
        "id": F.when(F.col("event_id") % 97 != 0, F.col("id")).otherwise(""),
        "type": F.when(F.col("event_id") % 89 != 0, F.col("type")),
    })


@query
def event_validation(spark, sf):
    return stats.status_counts(
        events.validate(_submitted(spark, sf)).withColumn("status", F.coalesce("reject_reason", F.lit("accepted"))))


@query
def ingestion_counters(spark, sf):
    """Submitted events by status; a client's third event within 20 s is turned away before it is looked at."""
    ev = _submitted(spark, sf).select("id", "type", "event_id", "user_id", "ts_ms").withColumn("user_id", F.coalesce("user_id", F.lit(-1)))
    seen = admission.admit_calendar(ev, "user_id", "ts_ms", 2, 20_000, ["event_id"])
    status = F.when(~F.col("allowed"), "rate_limited").when(events.reject_reason().isNotNull(), "error").otherwise("accepted")
    return stats.status_counts(seen.withColumn("status", status))


@query
def batch_accept_summary(spark, sf):
    return events.batch_summary(_submitted(spark, sf).withColumn("batch_id", F.expr("event_id div 500")))


@query
def event_query_topn(spark, sf):
    return events.query(tables.events(spark, sf), "error", "web", 50).select("id", "type", "source", _micros("timestamp"))


@query
def event_feed(spark, sf):
    return events.feed(tables.events(spark, sf), "purchase").select("id", "type", "source")


@query
def event_routing(spark, sf):
    routed = events.route(tables.events(spark, sf), {
        "alerts": F.col("type") == "error", "revenue": (F.col("type") == "purchase") & (F.col("value") > 50),
        "mobile": F.col("source") == "mobile",
    })
    return stats.status_counts(routed, "route")


@query
def processed_events(spark, sf):
    """Events in storage form, read back field by field."""
    ev = tables.events(spark, sf).select(
        "id", "type", "source", "timestamp", F.create_map(F.lit("value"), F.col("value"), F.lit("user_id"), F.col("user_id").cast("double"))
        .alias("data"), F.create_map(F.lit("origin"), F.col("source")).alias("metadata"), "processed_at")
    out = events.processed(events.to_text_map(ev), F.col("processed_at"))
    return out.select("id", F.get_json_object("data", "$.value").cast("double").alias("value"),
                      F.get_json_object("metadata", "$.origin").alias("origin"), _micros("processed_at"),
                      F.date_format("timestamp", "yyyyMM").alias("yyyymm"))


def _bank_transactions(spark, sf):
    """The transactions as a bank sends them, a fifth without timestamp and a seventh without card number."""
    tx = _tx(spark, sf).select(
        "transaction_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("card_id").cast("string")).alias("card_number"),
        "amount", F.lit("RUB").alias("currency"), F.col("merchant_id").cast("string").alias("merchant_id"),
        F.concat(F.lit("merchant "), F.col("merchant_id").cast("string")).alias("merchant_name"), F.lit("5411").alias("merchant_mcc"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("timestamp"), F.lit("10.0.0.1").alias("ip_address"),
        F.col("device_id").cast("string").alias("device_id"), F.struct(F.col("country"), F.col("country").alias("city"),
                                                                       F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")).alias("location"),
        F.lit("debit").alias("card_type"), F.concat(F.lit("acc-"), F.col("customer_id").cast("string")).alias("account_id"),
        F.col("customer_id").cast("string").alias("user_id"),
    )
    return events.default_timestamp(tx, F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query
def feature_contexts(spark, sf):
    """Bank transactions in the columns that features are built from."""
    return banking.transaction_context(_bank_transactions(spark, sf)).select(
        "transaction_id", "card_id", "account_id", "customer_id", "device_id", "amount", "currency", "merchant_id", "country", "city", "ip", "mcc", "ts_ms")


@query
def analytics_events(spark, sf):
    """Transactions flattened to analytics events, with the default timestamp and the partition key."""
    tx = _bank_transactions(spark, sf)
    out = banking.transaction_event(tx)
    card = F.get_json_object("data", "$.card_number")
    return out.select("id", "type", "source", _micros("timestamp"),
                      F.round(F.get_json_object("data", "$.amount").cast("double"), 2).alias("amount"),
                      events.partition_key(card, F.get_json_object("data", "$.account_id")).alias("partition_key"),
                      F.col("metadata")["country"].alias("country"))


@query
def enrich_geo_range_join(spark, sf):
    out = enrich.range_lookup(tables.events(spark, sf), "ip_num", tables.geo_ranges(spark, sf), ["country", "city"])
    return out.select("id", "ip_num", "country", "city")


@query
def enrich_user_agent(spark, sf):
    return enrich.classify_agent(tables.events(spark, sf)).select("id", "browser", "device", "os")


@query
def enriched_metadata(spark, sf):
    """The default enrichers over every event, read back from the metadata map."""
    ev = tables.events(spark, sf)
    ip = F.concat_ws(".", *[(F.shiftright(F.col("ip_num"), s) % 256).cast("string") for s in (24, 16, 8, 0)])
    ev = ev.select(
        "id", "type", "source", "timestamp",
        F.to_json(F.struct(ip.alias("ip"), "user_agent", F.col("user_id").cast("string").alias("user_id"))).alias("data"),
        F.create_map(F.lit("origin"), F.col("source")).alias("metadata"),
    )
    now = F.lit("2024-02-01 10:20:30").cast("timestamp")
    out = enrich.run_enrichers(ev, enrich.default_enrichers(now, tables.geo_ranges(spark, sf)))
    m = F.col("metadata")
    return out.select("id", _micros("timestamp"), F.get_json_object("data", "$.user_id").alias("user_id"),
                      m["server_timestamp"].alias("server_timestamp"), F.get_json_object(m["geo"], "$.country").alias("country"),
                      m["browser"].alias("browser"), m["session_id"].alias("session_id"), m["event_count"].cast("long").alias("event_count"),
                      m["source_count"].cast("long").alias("source_count"), m["origin"].alias("origin"))


@query
def enrichment_stats(spark, sf):
    out = enrich.range_lookup(tables.events(spark, sf), "ip_num", tables.geo_ranges(spark, sf), ["country", "city"])
    return enrich.enrichment_stats(out, F.col("country").isNull())


@query
def latency_histogram(spark, sf):
    ev = tables.events(spark, sf)
    seconds = (F.unix_micros("processed_at") - F.unix_micros("timestamp")) / 1_000_000
    return stats.latency_histogram(ev, seconds, ["type"]).select("type", "le", "count", "total", F.round("sum_seconds", 3).alias("sum_seconds"))


@query
def dashboard_totals(spark, sf):
    out = stats.dashboard(tables.events(spark, sf))
    return out.select("total_events", F.round("elapsed_seconds", 3).alias("elapsed_seconds"), F.round("events_per_second", 8).alias("events_per_second"))


@query
def dedup_events(spark, sf):
    """Error events arrive a second time, a minute later."""
    ev = tables.events(spark, sf).select("id", "type", "source", "timestamp", "value")
    again = ev.where(F.col("type") == "error").withColumn("timestamp", F.expr("timestamp + interval 1 minute"))
    return events.deduplicate(ev.unionByName(again)).select("id", "type", "source", _micros("timestamp"), "value")


@query
def retention_filter(spark, sf):
    ev = tables.events(spark, sf).select("id", "type", "timestamp")
    return retained(ev, "2024-01-30", 10).select("id", "type", _micros("timestamp"))


# --- dead letters -----------------------------------------------------------------------------------------------------


@query
def dlq_ledger_stats(spark, sf):
    return dlq.stats(tables.failures(spark, sf))


@query
def dlq_schedule(spark, sf):
    linear = dlq.schedule(tables.failures(spark, sf))
    tiered = linear.withColumn("tier_seconds", dlq.tier_seconds(F.col("retry_count") + 1))
    return tiered.select("id", "state", _micros("next_retry_at"), "tier_seconds")


@query
def dlq_recent(spark, sf):
    return dlq.recent(tables.failures(spark, sf), 25).select("id", "error", "source", _micros("failed_at"))


@query
def dlq_retry_outcomes(spark, sf):
    """One retry run at noon of the 15th, exponential backoff; replays of even ids succeed."""
    ledger = dlq.schedule(tables.failures(spark, sf), 3600, "exponential").withColumn("last_retry_at", F.lit(None).cast("timestamp"))
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    out = dlq.retry(ledger, lambda due: F.col("id").cast("long") % 2 == 0, at, 3600, "exponential")
    return out.groupBy("source", "retry_count", "recovered").agg(
        F.count(F.lit(1)).alias("n"), F.count("next_retry_at").alias("waiting"), F.count("last_retry_at").alias("ran"))


@query
def dlq_replay(spark, sf):
    """All dead letters replayed, and replayed again: each event that was not stored before is stored once."""
    schema = T.StructType.fromDDL("id string, type string, source string, props string")
    ledger = dlq.schedule(tables.failures(spark, sf)).withColumn("last_retry_at", F.lit(None).cast("timestamp"))
    before = ledger.where("recovered").select("id")
    at = F.lit("2024-02-01").cast("timestamp")
    new, after = dlq.replay(ledger, before, at, schema)
    again, last = dlq.replay(after, before.unionByName(new.select("id")), at, schema)
    times = new.unionByName(again).groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.max("props").alias("props"))
    return last.join(times, "id", "left").select("id", "recovered", F.col("next_retry_at").isNotNull().alias("waiting"),
                                                 F.coalesce("times", F.lit(0).cast("long")).alias("times"), "props")


# --- sources and the events table ------------------------------------------------------------------------------------


@query
def json_array_batches(spark, sf):
    """Fifty events as one JSON array; of the bodies every seventh is empty and every eleventh no array: items and refused bodies."""
    ev = tables.events(spark, sf).withColumn("body_id", F.expr("event_id div 50"))
    text = F.when(F.col("body_id") % 11 == 0, "no array").when(F.col("body_id") % 7 == 0, "[]").otherwise(F.to_json("items"))
    bodies = ev.groupBy("body_id").agg(F.collect_list(F.struct("id", "type", "source", F.col("props").alias("data"))).alias("items")).select("body_id", text.alias("body"))
    items, refused = explode_batches(bodies)
    return items.select("body_id", "id", "type", "data", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        refused.select("body_id", "reject_reason"), allowMissingColumns=True)


@query
def decoded_payloads(spark, sf):
    """Transactions as JSON payloads, a thirteenth of them cut short: decoded ones, and dead letters with their payload's length."""
    tx = tables.events(spark, sf).select("event_id", F.to_json(F.struct(F.col("id").alias("transaction_id"), F.col("value").alias("amount"))).alias("value"))
    raw = tx.select(F.when(F.col("event_id") % 13 == 0, F.expr("substring(value, 1, 19)")).otherwise(F.col("value")).alias("value"))
    good, bad = split_decoded(decode(raw))
    return good.select(F.col("transaction_id").alias("id"), "amount", F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("length")).unionByName(
        bad.select("error", F.length("payload").alias("length")), allowMissingColumns=True)


@query
def events_table(spark, sf):
    """The events in six batches, one of them delivered twice; merged, freed of what is older than 10 days, and read back."""
    path = scratch(spark, "events-table")
    ev = tables.events(spark, sf).withColumn("data", F.col("props")).withColumn("metadata", F.lit(None).cast("string"))
    for batch in (0, 1, 2, 3, 3, 4, 5):
        event_table.append_batch(ev.where(F.col("event_id") % 6 == batch), path, batch)
    event_table.compact(spark, path, 4)
    event_table.retain(spark, path, "2024-01-30", 10)
    return event_table.read(spark, path).select("id", "type", "source", _micros("timestamp"), _micros("processed_at"), "data", "yyyymm")
