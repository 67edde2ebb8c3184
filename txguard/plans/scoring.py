"""From fired rules to a risk score, an action and its explanation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.plans.rules import ACTIONS, SEVERITY, Rule, active_rules, feature_sql, literal, match_sql

MAX_SCORE = 1000


@dataclass(frozen=True)
class Thresholds:
    """Lowest score of each band."""

    alert: int = 200
    review: int = 400
    challenge: int = 600
    decline: int = 800
    block: int = 1000


DEFAULT_THRESHOLDS = Thresholds()


def band_severity(score: Column, t: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    out = F.when(score >= t.block, 5).when(score >= t.decline, 4).when(score >= t.challenge, 3)
    return out.when(score >= t.review, 2).when(score >= t.alert, 1).otherwise(0)


def action_name(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), severity + 1)


def explain(rule: Rule) -> str:
    return f"[{rule.id}] {rule.name} → {rule.action} (+{rule.risk_points} pts)"


def by_points(rules: Sequence[Rule]) -> list[Rule]:
    """Order of reasons: points, then priority, both descending, then definition order."""
    return sorted(active_rules(rules), key=lambda r: (-r.risk_points, -r.priority))


def score(df: DataFrame, rules: Sequence[Rule], thresholds: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Add the decision columns. Each rule is evaluated once per row; everything else reads its flag."""
    ordered = by_points(rules)
    columns = df.columns
    # By place: versions of a rule set name a rule more than once.
    flagged = [(r, f"__fired_{i}") for i, r in enumerate(ordered)]
    flags = [flag for _, flag in flagged]
    marked = df.selectExpr("*", *[f"{match_sql(columns, r)} as {flag}" for r, flag in flagged])

    def listed(value: Callable[[Rule], str]) -> Column:
        items = ", ".join(f"if({flag}, {literal(value(r))}, null)" for r, flag in flagged)
        return F.expr(f"filter(cast(array({items}) as array<string>), x -> x is not null)")

    points = " + ".join(["0", *[f"if({flag}, {r.risk_points}, 0)" for r, flag in flagged]])
    explicit = ", ".join(["0", "0", *[f"if({flag}, {SEVERITY.get(r.action, 0)}, 0)" for r, flag in flagged]])
    any_fired = " or ".join(["false", *flags])
    used: dict[str, list[str]] = {}
    for r, flag in flagged:
        for c in r.conditions:
            used.setdefault(c.feature, []).append(flag)
    entries = ", ".join(
        f"if({' or '.join(by)}, struct({literal(f)} as key, {feature_sql(columns, f)} as value), null)" for f, by in used.items()
    )
    contributing = f"map_from_entries(filter(array({entries}), x -> x is not null))" if used else "cast(map() as map<string,double>)"
    banded = marked.withColumn("risk_score", F.expr(f"cast(least({MAX_SCORE}, {points}) as int)"))
    severity = F.greatest(F.expr(f"greatest({explicit})"), band_severity(F.col("risk_score"), thresholds))
    return banded.withColumns({
        "action": F.when(F.expr(any_fired), action_name(severity)).otherwise("allow"),
        "reason_codes": listed(lambda r: r.reason_code),
        "triggered_rules": listed(lambda r: r.id),
        "contributing_features": F.expr(contributing),
        "explain_lines": listed(explain),
    }).drop(*flags)
