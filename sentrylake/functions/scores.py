"""Score and severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import DEFAULTS, Options
from .timefn import seconds_between


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def noisy_or(a: Column, b: Column) -> Column:
    return F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - b)


def quantile_scaled(x: Column, q10: Column, q90: Column) -> Column:
    return clip01((x - q10) / F.greatest(F.lit(1e-6), q90 - q10))


def severity(score: Column, opts: Options = DEFAULTS) -> Column:
    return severity_between(score, F.lit(opts.severity_medium), F.lit(opts.severity_high))


def severity_between(score: Column, medium: Column, high: Column) -> Column:
    return (
        F.when(score >= high, F.lit("high"))
        .when(score >= medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def severity_rank(sev: Column) -> Column:
    """1, 2, 3 for low, medium, high; anything else counts as low."""
    return F.when(sev == "high", 3).when(sev == "medium", 2).otherwise(1)


def severity_of_rank(rank: Column) -> Column:
    return F.when(rank >= 3, "high").when(rank == 2, "medium").otherwise("low")


def logistic_risk(x: Column) -> Column:
    return F.lit(0.4) + F.lit(0.55) / (F.lit(1.0) + F.exp(F.lit(-4.0) * (x - F.lit(0.5))))


def rule_fusion(confidence: Column, model_score: Column) -> Column:
    return F.when(
        model_score > 0, F.lit(0.7) * confidence + F.lit(0.3) * model_score
    ).otherwise(confidence)


def percentile_band(value: str, stats: str) -> str:
    """SQL text: the percentile band of a value against a statistics struct."""
    # The middle of each percentile band.
    bands = (("p5", 5.0), ("p25", 15.0), ("p50", 37.5), ("p75", 62.5), ("p95", 85.0), ("p99", 97.0))
    steps = " ".join(f"when {value} <= {stats}.{p} then {mid}D" for p, mid in bands)
    return f"case {steps} else 99.5D end"


def entity_risk(
    max_risk: Column, incidents: Column, severity_weight: Column, latest: Column, as_of: Column
) -> Column:
    hours = seconds_between(latest, as_of) / F.lit(3600.0)
    recency = F.greatest(F.lit(0.5), F.lit(1.0) - hours / F.lit(168.0))
    return F.round(
        max_risk * 0.4
        + F.least(incidents / F.lit(10.0), F.lit(1.0)) * 0.3
        + F.least(severity_weight / F.lit(30.0), F.lit(1.0)) * 0.2
        + recency * 0.1,
        3,
    )


def agreement(window_score: Column, sequence_score: Column) -> Column:
    d = F.abs(window_score - sequence_score)
    return F.when(d < 0.2, "High").when(d < 0.4, "Medium").otherwise("Low")


def risk_band(risk: Column) -> Column:
    return F.when(risk > 0.8, "high").when(risk > 0.5, "elevated").otherwise("guarded")
