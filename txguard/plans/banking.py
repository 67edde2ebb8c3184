"""The full banking decision, where limits, blocks and features feed back into later decisions."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.functions.columns import blank_to_null, epoch_ms, whole_units
from txguard.operators.exact import ExactSum
from txguard.operators.folds import ordered_fold
from txguard.operators.running import as_of, running
from txguard.operators.skew import DEFAULT_SKEW, Skew
from txguard.operators.sliding import DAY, HOUR, MINUTE, sliding
from txguard.plans.baselines import with_baselines
from txguard.plans.engine import precheck_reason
from txguard.plans.features import CARD, CUSTOMER, DEVICE, PRIOR, feature_of, with_amount_ratio
from txguard.plans.limits import (
    DAILY_REASON, DEFAULT_LIMITS, MONTHLY_REASON, TRANSACTION_REASON, Limits, attempted_spend, limit_check, with_limits,
    with_periods,
)
from txguard.plans.rules import ACTIONS, DEFAULT_RULES, EVENT_TIME, SEVERITY, Rule
from txguard.plans.scoring import DEFAULT_THRESHOLDS, MAX_SCORE, Thresholds, by_points, explain, score
from txguard.session_dirs import written

OUTCOME = (
    "status string, limit_reason string, risk_score int, action string, reason_codes array<string>, "
    "triggered_rules array<string>, explain_lines array<string>, remaining_limit double"
)
STEP_INPUTS = (
    "ts_ms", "transaction_id", "card_id", "amount", "merchant_id", "country", "day", "month", "transaction_limit",
    "daily_limit", "monthly_limit", "precheck_reason", "manual_block_ms", "unblock_ms",
)
_TESTS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


class _Frame:
    """Count, sum and distinct values over the recorded rows of the last ``width`` ms; a row costs the same however full the frame is.

    The sum is exact and rounded when read, so taking amounts back leaves nothing behind. The rows of the latest time are summed up apart, as the mean of
    earlier ones leaves them out.
    """

    def __init__(self, width: int):
        self.width, self.rows, self.values = width, deque(), Counter()
        self.sum, self.last, self.last_sum, self.last_n = ExactSum(), None, ExactSum(), 0

    @property
    def total(self) -> float:
        return self.sum.value()

    def expire(self, now: int) -> None:
        while self.rows and self.rows[0][0] < now - self.width:
            _, amount, value = self.rows.popleft()
            self.sum.add(amount, -1)
            if value is not None:
                self.values[value] -= 1
                if not self.values[value]:
                    del self.values[value]

    def add(self, now: int, amount: float, value) -> None:
        self.rows.append((now, amount, value))
        self.sum.add(amount)
        if now != self.last:
            self.last, self.last_sum, self.last_n = now, ExactSum(), 0
        self.last_sum.add(amount)
        self.last_n += 1
        if value is not None:
            self.values[value] += 1

    def mean_before(self, now: int) -> float:
        """Mean of the rows before ``now``, 0 without any."""
        self.expire(now)
        n, total = len(self.rows), self.sum
        if self.last == now:
            n, total = n - self.last_n, total.plus(self.last_sum, -1)
        return total.value() / n if n else 0.0


class CardStep:
    """Decides the transactions of one card in order; used alike by the batch fold and the streaming state operator.

    A call takes :data:`STEP_INPUTS` and then the ``outer`` features, which do not depend on this card's decisions, and
    returns :data:`OUTCOME`. Memory is the card's recorded rows of the last 24 hours; a row takes the same time however many these are.
    """

    def __init__(self, rules: Sequence[Rule], thresholds: Thresholds, block_ttl_ms: int | None, outer: Sequence[str]):
        self.rules = by_points(rules)
        self.outer_names = [feature_of(c) for c in outer]
        self.bands = [(thresholds.block, 5), (thresholds.decline, 4), (thresholds.challenge, 3), (thresholds.review, 2),
                      (thresholds.alert, 1)]
        self.block_ttl_ms = block_ttl_ms
        self.frames = {"1m": _Frame(MINUTE), "5m": _Frame(5 * MINUTE), "1h": _Frame(HOUR), "24h": _Frame(DAY)}
        self.blocked_at = None
        self.recorded: deque = deque()
        self.n_recorded = 0
        self.manual_at, self.lifted_at = None, None
        self.day, self.month, self.day_spent, self.month_spent = None, None, 0, 0

    @property
    def scalars(self) -> tuple:
        """What is kept of a card between micro-batches besides its recorded rows."""
        return self.blocked_at, self.day, self.month, self.day_spent, self.month_spent, self.manual_at, self.lifted_at

    def with_rules(self, rules: Sequence[Rule]) -> CardStep:
        self.rules = by_points(rules)
        return self

    def restore(self, scalars: tuple, rows: Iterable[tuple]) -> CardStep:
        self.blocked_at, self.day, self.month, self.day_spent, self.month_spent, self.manual_at, self.lifted_at = scalars
        for row in rows:
            self._record(*row)
        return self

    def _record(self, ts, amount, merchant, country) -> None:
        self.n_recorded += 1
        self.recorded.append((ts, amount, merchant, country))
        while self.recorded[0][0] < ts - DAY:
            self.recorded.popleft()
        for name, frame in self.frames.items():
            frame.expire(ts)
            frame.add(ts, amount, merchant if name == "1h" else country if name == "24h" else None)

    def command(self, ts: int, block: bool) -> None:
        """An operator's block or unblock; commands come before transactions of their time."""
        self.manual_at, self.lifted_at = (ts, self.lifted_at) if block else (None, ts)

    def _running(self, start: int | None, ts: int, lifted: int | None) -> bool:
        """Whether a block made at ``start`` still holds; an unblock at or after it lifts it."""
        return (start is not None and (self.block_ttl_ms is None or ts < start + self.block_ttl_ms)
                and (lifted is None or lifted < start))

    def _limit_reason(self, amount, transaction, daily, monthly) -> str | None:
        if amount > transaction:
            return TRANSACTION_REASON
        if self.day_spent + amount > daily:
            return DAILY_REASON
        return MONTHLY_REASON if self.month_spent + amount > monthly else None

    def _holds(self, condition, fv) -> bool:
        test = _TESTS.get(condition.operator)
        return test is not None and test(fv.get(condition.feature) or 0.0, condition.threshold)

    def __call__(self, ts, tx, card, amount, merchant, country, day, month, tx_limit, daily, monthly, reason, manual, lifted, *others) -> tuple:
        manual = self.manual_at if manual is None else manual
        lifted = self.lifted_at if lifted is None else lifted
        if day != self.day:
            self.day, self.day_spent = day, 0
        if month != self.month:
            self.month, self.month_spent = month, 0
        declined = None if amount is None else self._limit_reason(amount, tx_limit, daily, monthly)
        if declined:
            return ("declined", declined, None, None, [], [], [], None)
        # Of commands at one time the log's order counts; ``manual`` is empty where an unblock came after the block.
        if reason is None and (self._running(self.blocked_at, ts, lifted) or self._running(manual, ts, None)):
            reason = f"card {card} is blocked"
        if reason is not None:
            return ("declined_by_fraud", None, MAX_SCORE, "block", ["PRE_CHECK_FAILED"], [], [f"Pre-check: {reason}"], None)

        mean = self.frames["24h"].mean_before(ts)
        self._record(ts, amount, merchant, country)
        frames = self.frames
        fv = dict(zip(self.outer_names, others))
        fv[EVENT_TIME] = ts
        fv.update({f"card:tx_count_{name}": len(frame.rows) for name, frame in frames.items()})
        fv.update({
            "card:amount_sum_1h": frames["1h"].total, "card:amount_sum_24h": frames["24h"].total,
            "card:unique_merchants_1h": len(frames["1h"].values), "card:unique_countries_24h": len(frames["24h"].values),
            "card:amount_ratio_vs_avg24h": amount / mean if mean > 0 else 0.0,
        })
        fired = [r for r in self.rules if r.conditions and all(self._holds(c, fv) for c in r.conditions)]
        points = min(MAX_SCORE, sum(r.risk_points for r in fired))
        severity = 0
        if fired:
            band = next((s for floor, s in self.bands if points >= floor), 0)
            severity = max(band, *[SEVERITY.get(r.action, 0) for r in fired])
        if severity == 5:
            self.blocked_at = ts
        status, remaining = "declined_by_fraud", None
        if severity < 4:
            status, remaining = "approved", daily - self.day_spent - amount
            self.day_spent += int(amount)
            self.month_spent += int(amount)
        return (status, None, points, ACTIONS[severity], [r.reason_code for r in fired], [r.id for r in fired],
                [explain(r) for r in fired], remaining)


def card_step(
    rules: Sequence[Rule] = DEFAULT_RULES,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
    block_ttl_ms: int | None = DAY,
    outer: Sequence[str] = (),
) -> Callable[[], CardStep]:
    """Makes the step of a new card."""
    return lambda: CardStep(rules, thresholds, block_ttl_ms, outer)


CARD_COLUMN_NAMES = frozenset(s.name for s in CARD) | {"card__amount_ratio_vs_avg24h"}


def outer_features(columns: Sequence[str]) -> list[str]:
    """Feature columns the step takes as given."""
    return [c for c in columns if "__" in c and not c.startswith("__") and c not in CARD_COLUMN_NAMES]


def prepare(
    df: DataFrame,
    custom_limits: DataFrame | None = None,
    default_limits: Limits = DEFAULT_LIMITS,
    cards: DataFrame | None = None,
    merchants: DataFrame | None = None,
    skew: Skew = DEFAULT_SKEW,
    commands: DataFrame | None = None,
) -> DataFrame:
    """Everything of a decision that does not depend on earlier decisions of the card.

    ``commands`` is the log of manual blocks and unblocks (card_id, ts_ms, seq, command); of one time, commands come before transactions.

    Customer and device features count every attempt that passes the stateless pre-checks: they cross cards, and cards
    are decided in parallel.
    """
    # Rows that fail a pre-check have no customer and no device to count for; they stay in the one pass.
    checked = df.withColumn("precheck_reason", precheck_reason())
    passes = F.col("precheck_reason").isNull()
    masked = checked.withColumns({f"__own_{c}": F.when(passes, F.col(c)) for c in ("customer_id", "device_id")})
    counted = sliding(sliding(masked, ["__own_device_id"], "ts_ms", DEVICE, skew), ["__own_customer_id"], "ts_ms", CUSTOMER, skew)
    built = with_baselines(counted.drop("__own_customer_id", "__own_device_id"), cards, merchants)
    added = [c for c in built.columns if c not in checked.columns]
    rows = built.withColumns({c: F.when(passes, F.col(c)) for c in added})
    return with_commands(with_periods(with_limits(rows, custom_limits, default_limits)), commands, skew)


def with_commands(df: DataFrame, commands: DataFrame | None, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Add manual_block_ms (the last block, unless a later unblock lifted it) and unblock_ms (the last unblock) as of each row."""
    if commands is None:
        return df.withColumns({c: F.lit(None).cast("long") for c in ("manual_block_ms", "unblock_ms") if c not in df.columns})
    lifts = F.when(F.col("command") == "unblock", F.col("ts_ms"))
    log = running(commands.select("card_id", "ts_ms", "seq", "command"), ["card_id"], "ts_ms", {"__lift": ("max", lifts)}, ["seq"], "rows", skew)
    log = log.select("card_id", F.col("ts_ms").alias("__at"), F.col("seq").alias("__seq"), (F.col("command") == "block").alias("__block"), "__lift")
    read = as_of(df, log, ["card_id"], "ts_ms", ["__seq", "__block", "__lift"], right_ts="__at", matched_ts="__when", skew=skew)
    return read.select(*df.columns, F.when(F.col("__block"), F.col("__when")).alias("manual_block_ms"), F.col("__lift").alias("unblock_ms"))


def _named() -> Column:
    return F.coalesce(F.col("card_id").cast("string") != "", F.lit(False))


def _alone_outcome() -> dict[str, Column]:
    """Outcomes of rows that fail a stateless pre-check and touch no card's history: their limits, then the pre-check."""
    zero = F.lit(0)
    over = F.coalesce(limit_check(F.col("amount"), zero, zero), F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    fraud = over.isNull()
    return {
        "status": F.when(fraud, "declined_by_fraud").otherwise("declined"),
        "limit_reason": over,
        "risk_score": F.when(fraud, F.lit(MAX_SCORE)),
        "action": F.when(fraud, "block"),
        "reason_codes": F.when(fraud, F.array(F.lit("PRE_CHECK_FAILED"))).otherwise(none),
        "triggered_rules": none,
        "explain_lines": F.when(fraud, F.array(F.concat(F.lit("Pre-check: "), "precheck_reason"))).otherwise(none),
        "remaining_limit": F.lit(None).cast("double"),
    }


def _alone(df: DataFrame) -> DataFrame:
    return df.withColumns(_alone_outcome())


def decide_in_order(
    prepared: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
    block_ttl_ms: int | None = DAY,
) -> DataFrame:
    """Limits, pre-checks, features, rules and score, card by card in event order.

    Rows that name no card share no history, so they are decided each for itself and meet in no task.
    """
    prepared = with_commands(prepared, None)
    outer = outer_features(prepared.columns)
    folded = ordered_fold(
        prepared.where(_named()), ["card_id"], ["ts_ms", "transaction_id"], [*STEP_INPUTS, *outer],
        card_step(rules, thresholds, block_ttl_ms, outer), OUTCOME,
    )
    return folded.unionByName(_alone(prepared.where(~_named())))


def decide_where_needed(
    prepared: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
    block_ttl_ms: int | None = DAY,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """The result of :func:`decide_in_order`, folding only the cards whose decisions feed back into later ones.

    Take every attempt as recorded and as spent. A card on which, even so, no limit is exceeded and no block is decided
    had nothing refused, so these windows are its true history and its decisions come from the plan. The other cards are
    folded. Rows that name no card touch no history and are decided on their own.
    """
    prepared = with_commands(prepared, None)
    passes = F.col("precheck_reason").isNull()
    # One pass by card over all rows, written once: what every attempt would give. Refused rows have no card there, so they touch no history.
    own = prepared.withColumn("__card", F.when(passes, F.col("card_id")))
    scored = score(with_amount_ratio(sliding(own, ["__card"], "ts_ms", CARD + PRIOR, skew)), rules, thresholds)
    tried = attempted_spend(scored.withColumn("__amount", F.when(passes, F.col("amount"))), skew=skew, amount="__amount")
    exceeded = limit_check(F.col("amount"), F.col("day_before"), F.col("month_before")).isNotNull()
    # A refused row with a positive amount still asks for the limits, and a command may refuse any, so their cards are folded as well.
    asks = _named() & F.coalesce(F.col("amount") > 0, F.lit(False))
    commanded = F.col("manual_block_ms").isNotNull() | F.col("unblock_ms").isNotNull()
    refused = F.when(passes, (F.col("action") == "block") | exceeded | commanded).otherwise(asks)
    outcome = [part.split()[0] for part in OUTCOME.split(", ")]
    scores = [c for c in outcome if c in tried.columns]
    every = written(tried.withColumn("__refused", refused).select(*prepared.columns, *scores, "__us", "__refused"), "attempts")
    # Cards by partial aggregation, so that a hot one is a row here.
    feeding = written(every.where(_named()).groupBy("card_id").agg(F.max("__refused").alias("__feeds")).where("__feeds").select("card_id"), "feeding-cards")

    calm = every.join(feeding, "card_id", "left_anti")
    passed = passes & ~F.col("action").isin("decline", "block")
    spent = running(calm.withColumn("__units", F.when(passed, whole_units(F.col("amount")))),
                    ["card_id", "month", "day"], "__us", {"__spent": ("sum", F.col("__units"))}, ["transaction_id"], "before",
                    replace(skew, slice_ms=skew.slice_ms * 1000))
    left = F.col("daily_limit") - F.coalesce(F.col("__spent"), F.lit(0)) - F.col("amount")
    own_outcome = {
        "status": F.when(passed, "approved").otherwise("declined_by_fraud"),
        "limit_reason": F.lit(None).cast("string"),
        "remaining_limit": F.when(passed, left),
        **{c: F.col(c) for c in scores},
    }
    alone = _alone_outcome()
    free = spent.withColumns({f"__{c}": F.when(passes, own_outcome[c]).otherwise(alone[c]) for c in outcome}).select(
        *prepared.columns, *(F.col(f"__{c}").alias(c) for c in outcome))
    folded = decide_in_order(every.join(feeding, "card_id", "left_semi").select(*prepared.columns), rules, thresholds, block_ttl_ms)
    return free.unionByName(folded.select(*prepared.columns, *outcome))


def response_annotation(df: DataFrame) -> DataFrame:
    """Risk annotation of approved transactions that need attention: challenge and review."""
    noted = (F.col("status") == "approved") & F.col("action").isin("challenge", "review")
    return df.withColumns({
        "risk_note": F.when(noted, F.col("action")), "risk_note_score": F.when(noted, F.col("risk_score")),
    })


def transaction_context(df: DataFrame) -> DataFrame:
    """Bank transactions in the columns the features are built from; empty ids become null."""
    return df.select(
        "transaction_id", F.col("card_number").alias("card_id"), blank_to_null(F.col("account_id")).alias("account_id"),
        blank_to_null(F.col("user_id")).alias("customer_id"), blank_to_null(F.col("device_id")).alias("device_id"),
        "amount", "currency", blank_to_null(F.col("merchant_id")).alias("merchant_id"),
        blank_to_null(F.col("location.country")).alias("country"), F.col("location.city").alias("city"),
        F.col("ip_address").alias("ip"), F.col("merchant_mcc").alias("mcc"), epoch_ms(F.col("timestamp")).alias("ts_ms"),
        F.col("timestamp").alias("ts"),
    )


def transaction_event(df: DataFrame) -> DataFrame:
    """Bank transactions flattened to analytics events."""
    data = F.to_json(F.struct(
        "card_number", "amount", "currency", "merchant_id", "merchant_name", "merchant_mcc",
        F.col("ip_address").alias("ip"), "device_id", "card_type", "account_id", "user_id",
    ))
    return df.select(
        F.col("transaction_id").alias("id"), F.lit("bank_transaction").alias("type"), F.lit("banking_api").alias("source"),
        "timestamp", data.alias("data"),
        F.create_map(F.lit("country"), F.col("location.country"), F.lit("city"), F.col("location.city")).alias("metadata"),
    )


def fraud_event(df: DataFrame) -> DataFrame:
    """Events for transactions declined by fraud."""
    data = F.to_json(F.struct(
        "transaction_id", F.col("card_id").alias("card_number"), "amount", "merchant_id", "risk_score", "reason_codes",
    ))
    return df.where(F.col("action").isin("decline", "block")).select(
        F.concat(F.lit("fraud_"), "transaction_id").alias("id"), F.lit("fraud_detected").alias("type"),
        F.lit("fraud_engine_v2").alias("source"), F.col("ts").alias("timestamp"), data.alias("data"),
    )

