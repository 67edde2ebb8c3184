"""Rules as data, compiled to column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.plans.features import column_of
from txguard.schemas import RULE

# Comparison operators and actions from least to most severe.
OPERATORS = (">", ">=", "<", "<=", "==")
ACTIONS = ("allow", "alert", "review", "challenge", "decline", "block")
SEVERITY = {a: i for i, a in enumerate(ACTIONS)}
EVENT_TIME = "ts_ms"


@dataclass(frozen=True)
class Condition:
    feature: str
    operator: str
    threshold: float


@dataclass(frozen=True)
class Rule:
    """All conditions must hold. A rule without conditions never fires."""

    id: str
    name: str
    priority: int
    conditions: tuple[Condition, ...] = field(default_factory=tuple)
    risk_points: int = 0
    action: str = "allow"
    reason_code: str = ""
    cooldown_minutes: int = 0
    enabled: bool = True


class InvalidRules(ValueError):
    pass


def _rule(id, name, priority, conditions, points, action, reason, cooldown, enabled=True) -> Rule:
    return Rule(id, name, priority, tuple(Condition(*c) for c in conditions), points, action, reason, cooldown, enabled)


# The built-in rule set.
DEFAULT_RULES = (
    _rule("velocity_1m", "High velocity — 1 minute", 100, [("card:tx_count_1m", ">", 5.0)], 350, "block",
          "HIGH_VELOCITY_1M", 30),
    _rule("velocity_5m", "High velocity — 5 minutes", 90, [("card:tx_count_5m", ">", 10.0)], 250, "review",
          "HIGH_VELOCITY_5M", 15),
    _rule("amount_spike", "Amount spike vs. 24h average", 85, [("card:amount_ratio_vs_avg24h", ">", 5.0)], 200, "review",
          "AMOUNT_SPIKE", 60),
    _rule("amount_spike_literal", "Any amount within 24h", 85,
          [("card:amount_sum_24h", ">", 0.0), ("card:tx_count_24h", ">", 0.0)], 200, "review", "AMOUNT_SPIKE", 60, False),
    _rule("geo_spread", "Geographic spread — multiple countries in 24h", 80, [("card:unique_countries_24h", ">", 2.0)], 300,
          "challenge", "GEO_SPREAD_24H", 120),
    _rule("device_proliferation", "Many cards on one device", 75, [("device:card_count", ">", 4.0)], 250, "review",
          "DEVICE_CARD_PROLIFERATION", 60),
    _rule("merchant_spread", "Too many distinct merchants in 1 hour", 70, [("card:unique_merchants_1h", ">", 8.0)], 150,
          "alert", "MERCHANT_SPREAD_1H", 30),
    _rule("merchant_high_fraud_rate", "High merchant fraud rate (offline baseline)", 65,
          [("merchant:fraud_rate_30d", ">", 0.05)], 100, "alert", "MERCHANT_HIGH_FRAUD_RATE", 0),
    _rule("customer_device_spread", "Customer using many devices", 60, [("customer:device_count", ">", 5.0)], 150, "alert",
          "CUSTOMER_DEVICE_SPREAD", 60),
)


def validate_rules(rules: Sequence[Rule]) -> None:
    """Raise :class:`InvalidRules` at the first malformed rule."""
    seen: set[str] = set()
    for at, rule in enumerate(rules):
        label = f"rule {rule.id!r}" if rule.id else f"rule #{at}"
        problem = None
        if not rule.id:
            problem = "needs an id"
        elif rule.id in seen:
            problem = "repeats an id"
        elif not rule.conditions:
            problem = "needs at least one condition"
        elif any(not c.feature for c in rule.conditions):
            problem = "has a condition without a feature"
        elif any(c.operator not in OPERATORS for c in rule.conditions):
            problem = f"has a condition whose operator is not one of {', '.join(OPERATORS)}"
        elif not 0 <= rule.risk_points <= 1000:
            problem = f"has {rule.risk_points} risk points, outside 0..1000"
        if problem:
            raise InvalidRules(f"{label} {problem}")
        seen.add(rule.id)


def rule_problems(frame: DataFrame, position: str) -> DataFrame:
    """The rows of a rule table with the first ``problem`` of each, null where there is none; the relational form of :func:`validate_rules`.

    Nothing reaches the driver. Of rules with one id the first by ``position`` is the rule, later ones repeat it.
    """
    named = F.coalesce(F.col("id"), F.lit("")) != ""
    first = frame.where(named).groupBy("id").agg(F.min(position).alias("__first"))
    conditions = F.coalesce("conditions", F.expr("array()").cast(frame.schema["conditions"].dataType))
    points = F.coalesce("risk_points", F.lit(0))
    listed = F.lit(f"has a condition whose operator is not one of {', '.join(OPERATORS)}")
    problem = (
        F.when(~named, "needs an id")
        .when(F.col(position) > F.col("__first"), "repeats an id")
        .when(F.size(conditions) == 0, "needs at least one condition")
        .when(F.exists(conditions, lambda c: F.coalesce(c["feature"], F.lit("")) == ""), "has a condition without a feature")
        .when(F.exists(conditions, lambda c: ~F.coalesce(c["operator"], F.lit("")).isin(*OPERATORS)), listed)
        .when(~points.between(0, 1000), F.concat(F.lit("has "), points.cast("string"), F.lit(" risk points, outside 0..1000")))
    )
    return frame.join(first, "id", "left").select(*frame.columns, problem.alias("problem"))


def valid_from(versions: Mapping[int, Sequence[Rule]]) -> list[Rule]:
    """Versions of a rule set, by the event time (ms) from which each holds, as one set: each rule holds until the next version.

    Rows before the first version have no rules. Column expressions and ordered folds evaluate the set like any other, as the time is a feature of a row.
    """
    starts = sorted(versions)
    out = []
    for start, end in zip(starts, [*starts[1:], None]):
        inside = [Condition(EVENT_TIME, ">=", float(start))] + ([] if end is None else [Condition(EVENT_TIME, "<", float(end))])
        # A rule without conditions never fires, whatever the time.
        out += [replace(r, conditions=(*inside, *r.conditions)) for r in versions[start] if r.conditions]
    return out


def publish_rules(spark: SparkSession, path: str, rules: Sequence[Rule], from_ms: int) -> None:
    """Add a version of the rules to the versions in the shared folder ``path``. A version is never changed: one of that time must not exist."""
    validate_rules(rules)
    rules_frame(spark, rules).coalesce(1).write.json(f"{path}/from_ms={from_ms}")


def _from_json(line: str) -> Rule:
    r = json.loads(line)
    return Rule(r.get("id", ""), r.get("name", ""), r.get("priority", 0),
                tuple(Condition(c.get("feature"), c.get("operator"), c.get("threshold")) for c in r.get("conditions", [])),
                r.get("risk_points", 0), r.get("action", "allow"), r.get("reason_code", ""), r.get("cooldown_minutes", 0), r.get("enabled", True))


def read_versions(path: str) -> dict[int, list[Rule]]:
    """The complete versions under ``path``, read without a session, so that tasks of a running job may ask for them. Rules are small, hand-written files."""
    files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file]
    whole = {f.rsplit("/", 1)[0] for f in found if f.endswith("/_SUCCESS")}
    versions: dict[int, list[Rule]] = {int(folder.rsplit("from_ms=", 1)[1]): [] for folder in whole}
    for f in sorted(found):
        folder = f.rsplit("/", 1)[0]
        if folder in whole and f.endswith(".json"):
            with files.open_input_stream(f) as stream:
                text = stream.read().decode()
            versions[int(folder.rsplit("from_ms=", 1)[1])] += [_from_json(line) for line in text.splitlines() if line]
    return versions


def active_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Enabled rules, highest priority first; equal priorities keep their order."""
    return sorted((r for r in rules if r.enabled), key=lambda r: -r.priority)


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (r.id, r.name, r.priority, [(c.feature, c.operator, float(c.threshold)) for c in r.conditions], r.risk_points,
         r.action, r.reason_code, r.cooldown_minutes, r.enabled)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE)


def load_rules(spark: SparkSession, source: str | DataFrame) -> list[Rule]:
    """Rules from a JSON file (one array or one object per line) or a DataFrame of the rule schema.

    Rules are hand-written configuration, so the table is read to the driver to be compiled.
    """
    frame = spark.read.schema(RULE).json(source, multiLine=True) if isinstance(source, str) else source
    rules = [
        Rule(r.id or "", r.name or "", r.priority or 0,
             tuple(Condition(c.feature, c.operator, c.threshold) for c in r.conditions or []),
             r.risk_points or 0, r.action or "allow", r.reason_code or "", r.cooldown_minutes or 0, bool(r.enabled))
        for r in frame.collect()
    ]
    validate_rules(rules)
    return rules


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_sql(columns: Sequence[str], feature: str) -> str:
    """A feature as DOUBLE; one that is missing reads as 0."""
    name = column_of(feature)
    return f"coalesce(cast(`{name}` as double), 0D)" if name in columns else "0D"


def feature_value(columns: Sequence[str], feature: str) -> Column:
    return F.expr(feature_sql(columns, feature))


def match_sql(columns: Sequence[str], rule: Rule) -> str:
    """All conditions of a rule; an unknown operator never holds."""
    tests = [
        f"{feature_sql(columns, c.feature)} {c.operator} {float(c.threshold)!r}D" if c.operator in OPERATORS else "false"
        for c in rule.conditions
    ]
    return " and ".join(tests) or "false"


def matches(columns: Sequence[str], rule: Rule) -> Column:
    return F.expr(match_sql(columns, rule))


def fired_long(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per (transaction, fired rule), with the feature values the rule looked at."""
    cols = df.columns

    def one(rule: Rule) -> str:
        details = ", ".join(f"{literal(c.feature)}, {feature_sql(cols, c.feature)}" for c in rule.conditions)
        return (
            f"case when {match_sql(cols, rule)} then struct({literal(rule.id)} as rule_id, {rule.risk_points} as risk_points, "
            f"{literal(rule.action)} as action, {literal(rule.reason_code)} as reason_code, {rule.priority} as priority, "
            f"map({details}) as details) end"
        )

    fired = F.expr(f"filter(array({', '.join(one(r) for r in active_rules(rules))}), x -> x is not null)")
    return df.withColumn("__f", F.explode(fired)).select(*cols, "__f.*")


def fired_relational(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The same as (transaction_id, rule_id, ...) rows, for rule tables too large to compile.

    Every transaction is unpivoted to the features the rules mention, joined to the conditions on the feature name, and
    a rule fires where as many conditions hold as it has.
    """
    conditions = rules.where("enabled").select(
        F.col("id").alias("rule_id"), "risk_points", "action", "reason_code", "priority",
        F.size("conditions").alias("needed"), F.explode("conditions").alias("c"),
    ).select("rule_id", "risk_points", "action", "reason_code", "priority", "needed", "c.*")
    mentioned = [r.feature for r in conditions.select("feature").distinct().collect()]
    features = F.array(*[
        F.struct(F.lit(f).alias("feature"), feature_value(df.columns, f).alias("value")) for f in sorted(mentioned)
    ])
    value, limit, op = F.col("value"), F.col("threshold"), F.col("operator")
    holds = (
        ((op == ">") & (value > limit)) | ((op == ">=") & (value >= limit)) | ((op == "<") & (value < limit))
        | ((op == "<=") & (value <= limit)) | ((op == "==") & (value == limit))
    )
    return (
        df.select("transaction_id", F.inline(features))
        .join(conditions, "feature")
        .where(holds)
        .groupBy("transaction_id", "rule_id", "risk_points", "action", "reason_code", "priority", "needed")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") == F.col("needed"))
        .drop("held", "needed")
    )
