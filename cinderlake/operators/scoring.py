"""Confidence, grades, gate decisions, budgets and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the measurements, and the value of one that wasn't taken.
WEIGHTS = {"anchor_ratio": 0.4, "critic_agreement": 0.3, "schema_completeness": 0.2, "self_assessed": 0.1}
NEUTRAL = 0.5
CRITIC = {"high": 1.0, "moderate": 0.6, "low": 0.2}
#: Factors of the source and information grades; F and 6 have none.
SOURCE_FACTORS = {"A": 1.00, "B": 0.90, "C": 0.75, "D": 0.55, "E": 0.30}
INFO_FACTORS = {"1": 1.00, "2": 0.90, "3": 0.75, "4": 0.50, "5": 0.20}
WEIGHT_BANDS = ((0.9, "A"), (0.8, "B"), (0.6, "C"), (0.4, "D"), (0.0, "E"))
#: Floors by kind and over all, and what a local run adds to both.
FLOORS = {"ioc": 0.85, "ttp": 0.70, "narrative": 0.90, "sketch": 0.75, "diamond": 0.75}
OVERALL, LOCAL_LIFT = 0.75, 0.10
#: Sharing levels from open to closed.
TLP = ("clear", "green", "amber", "amber+strict", "red")


def lookup(values: dict, c: Column) -> Column:
    """The value of a key, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def composite(values: dict[str, Column], not_applicable: dict[str, Column] | None = None) -> Column:
    """Weighted mean of the measurements: a missing one counts as neutral, one that doesn't apply is left out."""
    skip = not_applicable or {}
    weight = {k: F.when(skip[k], 0.0).otherwise(w) if k in skip else F.lit(w) for k, w in WEIGHTS.items()}
    total = sum(weight.values(), F.lit(0.0))
    dot = sum((F.coalesce(values[k], F.lit(NEUTRAL)) * weight[k] for k in WEIGHTS), F.lit(0.0))
    return F.when(total > 0, dot / total).otherwise(NEUTRAL)


def anchor_ratio(kept: Column, rejected: Column) -> Column:
    """Share of proposals that were kept; null if there were none."""
    return kept / F.nullif(kept + rejected, F.lit(0))


def completeness(*optional: Column) -> Column:
    """Share of filled optional fields: empty texts and nulls aren't filled; null without fields."""
    if not optional:
        return F.lit(None).cast("double")
    filled = [F.when(c.isNotNull() & (c.cast("string") != ""), 1.0).otherwise(0.0) for c in optional]
    return sum(filled, F.lit(0.0)) / len(optional)


def source_grade(letter: Column) -> Column:
    """A to E as given, anything else F."""
    up = F.upper(F.trim(letter))
    return F.when(up.isin(*SOURCE_FACTORS), up).otherwise("F")


def grade_of_weight(weight: Column) -> Column:
    """Grade of a trust weight by bands."""
    out = F.lit("F")
    for floor, grade in reversed(WEIGHT_BANDS):
        out = F.when(weight >= floor, grade).otherwise(out)
    return out


def info_grade(others: Column, contradicted: Column, consistent: Column) -> Column:
    """From corroboration: contradicted 5, another source 1, inconsistent 5, else 3; unknown 6."""
    return F.when(others.isNull(), "6").when(contradicted, "5").when(others >= 1, "1").when(~consistent, "5").otherwise("3")


def axes(raw: Column, source: Column, info: Column) -> dict[str, Column]:
    """Factors, total and whether an axis can't be judged."""
    f1, f2 = lookup(SOURCE_FACTORS, source), lookup(INFO_FACTORS, info)
    return {"source_factor": f1, "info_factor": f2, "score_total": raw * F.coalesce(f1, F.lit(1.0)) * F.coalesce(f2, F.lit(1.0)), "unjudgeable": f1.isNull() | f2.isNull()}


def floors(kind: Column, local: Column) -> tuple[Column, Column]:
    """Floor of the kind and over all, lifted for local runs, 1 at most."""
    lift = F.when(local, LOCAL_LIFT).otherwise(0.0)
    return F.least(F.lit(1.0), lookup(FLOORS, kind) + lift), F.least(F.lit(1.0), F.lit(OVERALL) + lift)


def decide(rows: DataFrame, raw: str, kind: str, local: str) -> DataFrame:
    """``decision, reason`` from the raw score and the axes' columns; an axis without a grade stages."""
    own, overall = floors(F.col(kind), F.col(local))
    score = F.format_string("%.6f", F.col(raw))
    axis = F.when(F.col("source_factor").isNull() & F.col("info_factor").isNull(), "neither source nor information").when(F.col("source_factor").isNull(), "source").otherwise("information")
    reason = (
        F.when(F.col("unjudgeable"), F.concat(axis, F.lit(" has no grade")))
        .when(F.col(raw) < own, F.concat(score, F.lit(" is below the floor of "), F.col(kind)))
        .when(F.col(raw) < overall, F.concat(score, F.lit(" is below the floor over all")))
        .otherwise(F.concat(score, F.lit(" passes")))
    )
    auto = ~F.col("unjudgeable") & (F.col(raw) >= own) & (F.col(raw) >= overall)
    return rows.withColumn("decision", F.when(auto, "auto").otherwise("staged")).withColumn("reason", reason)


def tlp_rank(level: Column) -> Column:
    """0 for clear to 4 for red; an unknown level counts as amber+strict."""
    return F.coalesce(lookup({t: i for i, t in enumerate(TLP)}, F.lower(F.trim(level))), F.lit(3))


def most_restrictive(rows: DataFrame, by: list[str], level: str) -> DataFrame:
    """The most closed level per group."""
    worst = rows.groupBy(*by).agg(F.max(tlp_rank(F.col(level))).alias("_r"))
    return worst.withColumn("tlp", F.element_at(F.array(*map(F.lit, TLP)), F.col("_r") + 1)).drop("_r")


def budget(spend_month: Column, spend_day: Column, month_cap: float, day_cap: float, degrade: float = 0.8) -> Column:
    """Verdict: refuse at a cap, degrade from a share of the monthly one, else allow."""
    return F.when((spend_month >= month_cap) | (spend_day >= day_cap), "refuse").when(spend_month >= degrade * month_cap, "degrade").otherwise("allow")


def route(size: Column, limit: int, tlp: Column, override: Column, banned: Column, verdict: Column, providers: list[tuple[str, str]]) -> Column:
    """Choice or refusal: size, sharing level (open to green, or an override, unless the source is banned),
    a provider for the tier (the first that serves it), then the budget."""
    tier = F.when(verdict == "degrade", "small").otherwise("large")
    chosen = F.coalesce(*[F.when(tier == t, F.lit(p)) for p, t in providers])
    shareable = (tlp_rank(tlp) <= 1) | F.coalesce(override, F.lit(False))
    return F.when(size > limit, "refused:size").when(banned, "refused:source").when(~shareable, "refused:tlp").when(chosen.isNull(), "refused:provider").when(verdict == "refuse", "refused:budget").otherwise(chosen)


def price(tokens_in: Column, tokens_out: Column, per_million_in: float, per_million_out: float) -> Column:
    """Cost in dollars of a call."""
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1e6


def age_status(last: Column, as_of: str, degraded: float = 2.0, down: float = 4.0) -> Column:
    """ok, degraded or down by age in days; never seen is down."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 86_400_000_000
    return F.when(age < degraded, "ok").when(age < down, "degraded").otherwise("down")


def revert(audit: DataFrame, key: str, field: str, before: str, order: str) -> DataFrame:
    """``key, field, value``: what each changed field had before its first change."""
    return audit.groupBy(key, field).agg(F.min_by(before, order).alias("value"))
