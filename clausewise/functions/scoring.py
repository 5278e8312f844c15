"""Numeric column expressions: penalties, scores, bands, grades, Beta moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions.text import col, strip


def clamp01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def missing_penalty(n, slope=lexicon.PENALTY_SLOPE, cap=lexicon.PENALTY_CAP) -> Column:
    return F.least(F.lit(cap), F.lit(slope) * F.greatest(col(n), F.lit(0)))


def risk_band(c, high=lexicon.HIGH_RISK_FROM, medium=lexicon.MEDIUM_RISK_FROM) -> Column:
    x = col(c)
    return F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def lag_hours(collected, updated) -> Column:
    """Days from update to collection, in hours; null when unknown or negative."""
    days = F.date_diff(col(collected), col(updated))
    return F.when(days >= 0, (days * 24).cast("double"))


def annotation_severity(rows, categories) -> Column:
    weight = col(rows) + col(categories) * 10
    return F.when(weight >= 700, "high").when(weight >= 250, "medium").otherwise("low")


def claim_adjusted_rate(base, status) -> Column:
    b, s = col(base), col(status)
    return (
        F.when(s.isNull(), b)
        .when(s == "compliant", F.least(b, F.lit(0.12)) * 0.65)
        .when(s == "partial", F.greatest(b, F.lit(0.18)))
        .otherwise(F.greatest(b, F.lit(0.45)))
    )


def grade(score) -> Column:
    s = col(score)
    return (F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 55, "C").when(s >= 40, "D")
            .otherwise("F"))


def status(score) -> Column:
    s = col(score)
    return (F.when(s >= 85, "Compliant").when(s >= 70, "Mostly Compliant")
            .when(s >= 55, "Needs Attention").otherwise("High Compliance Risk"))


def normalize_band(label) -> Column:
    """Free-form compliance wording to low / medium / high; null when unclear."""
    t = F.translate(F.lower(strip(label)), "_-", "  ")
    has = t.contains
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(has("medium") | has("partial"), "medium")
        .when(has("low") | has("non compliant") | has("noncompliant") | has("violation")
              | has("risk"), "low")
        .when(has("high") | (has("compliant") & ~has("non")) | has("positive"), "high")
    )


def binary_band(label) -> Column:
    band = F.when(col(label).isin("low", "medium", "high"), col(label)).otherwise(
        normalize_band(label))
    return F.when(band == "low", "non_compliant").when(band.isNotNull(), "compliant")


def beta_mean(alpha, beta) -> Column:
    total = col(alpha) + col(beta)
    return F.when(total <= 0, 0.0).otherwise(col(alpha) / total)


def beta_interval(alpha, beta, z: float = 1.959964) -> tuple[Column, Column]:
    """Normal approximation to the central 95 % interval, clipped to [0, 1]."""
    a, b = col(alpha), col(beta)
    total = a + b
    spread = F.lit(z) * F.sqrt(a * b / (total * total * (total + 1.0)))
    mean = a / total
    lower = F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), mean - spread))
    upper = F.when(total <= 0, 1.0).otherwise(F.least(F.lit(1.0), mean + spread))
    return lower, upper


def bounded_probability(c) -> Column:
    return clamp01(F.coalesce(col(c).try_cast("double"), F.lit(0.0)))


def positive_or_default(c, default: float) -> Column:
    value = col(c).try_cast("double")
    return F.when(value > 0, value).otherwise(F.lit(float(default)))
