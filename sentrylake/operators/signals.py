"""Window, sequence and rule signals in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import present, stable_id
from ..functions.scores import rule_fusion
from ..functions.timefn import iso_utc
from ..options import DEFAULTS, Options
from ..schema import FEATURES
from .classify import classified, evidence_keys, sorted_keys, window_keys
from .features import EVIDENCE_FLAGS, evidence_aggregates, window_bounds
from .skew import spread_join

SIGNAL_COLUMNS = [
    "signal_id", "kind", "start_ts", "end_ts", "user_name", "ip", "score", "window_score",
    "sequence_score", "final_risk", "detection_type", "category", "mitre_keys", *EVIDENCE_FLAGS,
    *FEATURES,
]


def _ip_count(df: DataFrame) -> DataFrame:
    return df.withColumn("n_ips", F.when(present(F.col("ip")), 1).otherwise(0))


def window_signal_id() -> Column:
    return F.concat(
        F.lit("win_"), stable_id(F.col("user_name"), F.col("ip"), iso_utc(F.col("start_ts")))
    )


def _shape(df: DataFrame, signal_id: Column, kind: Column) -> DataFrame:
    have = set(df.columns)
    numbers = ["window_score", "sequence_score", "final_risk"]
    return df.select(
        *[
            signal_id.alias("signal_id") if c == "signal_id"
            else kind.alias("kind") if c == "kind"
            else (F.col(c) if c in have else F.lit(0.0)).alias(c) if c in numbers
            else (F.col(c) if c in have else F.lit(None)).cast("double").alias(c) if c in FEATURES
            else F.col(c)
            for c in SIGNAL_COLUMNS
        ]
    )


def window_signals(scored: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Windows (with evidence flags and n_hosts) whose window_score reaches the threshold."""
    kept = scored.filter(F.col("window_score") >= opts.signal_min_score)
    typed = classified(_ip_count(kept.withColumn("sequence_score", F.lit(0.0))))
    return _shape(
        typed.withColumn("score", F.col("window_score")).withColumn(
            "mitre_keys", sorted_keys(window_keys(), evidence_keys(), F.col("class_keys"))
        ),
        window_signal_id(),
        F.lit("window_anomaly"),
    )


def sequence_signals(scored: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Sessions (with evidence flags and n_hosts) whose sequence_score reaches the threshold."""
    kept = scored.filter(F.col("sequence_score") >= opts.signal_min_score)
    bare = kept.withColumn("window_score", F.lit(0.0))
    for f in FEATURES:
        bare = bare.withColumn(f, F.lit(None).cast("double"))
    typed = classified(_ip_count(bare))
    own = evidence_keys()
    keys = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("valid_accounts")))
    return _shape(
        typed.withColumn("score", F.col("sequence_score")).withColumn(
            "mitre_keys", sorted_keys(keys, F.col("class_keys"))
        ),
        F.col("session_id"),
        F.lit("sequence_anomaly"),
    )


def fused_rules(rules: DataFrame, model_signals: DataFrame) -> DataFrame:
    """Add model_score (the largest score of a model signal with the rule's address or user,
    0 without one) and final_score. The OR of the two keys becomes two joins on pre-aggregated
    maxima; null keys match nothing."""
    scores = model_signals.select("user_name", "ip", "score")
    out = rules
    for key in ("ip", "user_name"):
        best = (
            scores.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.max("score").alias(f"best_{key}"))
        )
        out = spread_join(out, best, [key], ["rule_id"], "left")
    model = F.coalesce(F.greatest("best_ip", "best_user_name"), F.lit(0.0))
    return (
        out.withColumn("model_score", model)
        .withColumn("final_score", rule_fusion(F.col("confidence"), F.col("model_score")))
        .drop("best_ip", "best_user_name")
    )


def rule_signals(
    rules: DataFrame, evidence: DataFrame, model_signals: DataFrame, opts: Options = DEFAULTS
) -> DataFrame:
    """Rule alerts as signals; evidence is rule_evidence of the same events."""
    fused = fused_rules(rules, model_signals)
    flags = evidence.groupBy("rule_id").agg(*evidence_aggregates(opts))
    rows = (
        fused.join(flags, "rule_id")
        .withColumn("score", F.col("final_score"))
        .withColumn("final_risk", F.col("final_score"))
        .withColumn("window_score", F.col("model_score"))
        .withColumn("detection_type", F.col("rule_name"))
        .withColumn("category", F.lit("rule_based"))
        .withColumn("mitre_keys", F.array("rule_name"))
    )
    return _shape(rows, F.col("rule_id"), F.concat(F.lit("rule_"), F.col("rule_name")))


def signal_hosts(
    events: DataFrame, by_session: DataFrame, evidence: DataFrame, opts: Options = DEFAULTS
) -> DataFrame:
    """Distinct (signal_id, host) over the evidence of every possible signal, from the events,
    their session_hosts and rule_evidence. Host counts do not add up over overlapping evidence,
    so clusters count them from here."""
    seen = events.filter(present(F.col("host")))
    by_window = (
        window_bounds(seen, opts)
        .select("user_name", "ip", "start_ts", "host")
        .distinct()
        .select(window_signal_id().alias("signal_id"), "host")
    )
    by_session = by_session.select(F.col("session_id").alias("signal_id"), "host")
    by_rule = (
        evidence.filter(present(F.col("host")))
        .select(F.col("rule_id").alias("signal_id"), "host")
        .distinct()
    )
    return by_window.unionByName(by_session).unionByName(by_rule)


def signal_ips(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct (signal_id, ip) over the evidence of the given signals."""
    own = signals.filter(present(F.col("ip"))).select("signal_id", "ip")
    legs = (
        evidence.filter(present(F.col("ip")))
        .select(F.col("rule_id").alias("signal_id"), "ip")
        .distinct()
    )
    return own.unionByName(legs).distinct()
