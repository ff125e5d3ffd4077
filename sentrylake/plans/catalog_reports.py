"""Registered queries over alert tables, labels and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import evaluation as ev
from ..operators import reports as rp
from ..operators import rules as ru
from ..operators import tables as tb
from ..sources.projection import security_alerts, security_events
from . import detect as dt
from .registry import query, rounded


def _incidents(alerts):
    """Alerts of the fixture grouped by their incident."""
    return (
        alerts.filter(F.col("incident_id").isNotNull())
        .groupBy("incident_id")
        .agg(
            F.min("start_ts").alias("start_ts"),
            F.max("start_ts").alias("end_ts"),
            F.count(F.lit(1)).alias("total_alerts"),
            F.lit("open").alias("status"),
            F.lit("").alias("analyst_notes"),
            F.lit("").alias("resolution_reason"),
        )
    )


@query
def alerts_list(spark, sf):
    a = security_alerts(spark, sf)
    return rp.alerts_list(a, _incidents(a), "medium", 200)


@query
def alerts_min_severity(spark, sf):
    return rp.alerts_with(security_alerts(spark, sf), "medium").select("alert_id", "severity")


@query
def alerts_by_entity(spark, sf):
    found = rp.alerts_with(security_alerts(spark, sf), "low", "USER3", "10.0.1.2")
    return found.select("alert_id", "user_name", "ip")


@query
def incidents_list(spark, sf):
    return rp.incidents_list(_incidents(security_alerts(spark, sf)), 50)


@query
def incident_detail(spark, sf):
    a = security_alerts(spark, sf)
    return rp.incident_detail(
        _incidents(a),
        a.select("incident_id", "alert_id", "created_ts", "severity", "final_risk",
                 "detection_type", "category"),
    )


def _top(spark, sf, key):
    a = security_alerts(spark, sf)
    return rp.top_risk(a, key, a.agg(F.max("created_ts").alias("as_of")))


@query
def top_risk_users(spark, sf):
    return _top(spark, sf, "user_name")


@query
def top_risk_ips(spark, sf):
    return _top(spark, sf, "ip")


@query
def health_counts(spark, sf):
    return rp.health_counts(security_events(spark, sf), security_alerts(spark, sf))


@query
def severity_distribution(spark, sf):
    return rp.severity_distribution(security_alerts(spark, sf))


@query
def category_distribution(spark, sf):
    return rp.category_distribution(security_alerts(spark, sf))


@query
def alerts_per_minute(spark, sf):
    return rounded(rp.alerts_per_minute(security_alerts(spark, sf)))


@query
def alerts_per_hour(spark, sf):
    return rp.alerts_per_hour(security_alerts(spark, sf))


@query
def alert_timeline(spark, sf):
    return rp.alert_timeline(security_alerts(spark, sf))


@query
def latest_alerts(spark, sf):
    return rp.latest_alerts(security_alerts(spark, sf))


@query
def related_alerts(spark, sf):
    return rp.related_alerts(security_alerts(spark, sf))


@query
def evidence_timeline(spark, sf):
    return rp.evidence_timeline(
        ru.rule_evidence(security_events(spark, sf), limit=ru.EVIDENCE_LIMIT), "rule_id"
    )


@query
def model_agreement(spark, sf):
    return rounded(rp.model_agreement(security_alerts(spark, sf)))


@query
def eval_metrics(spark, sf):
    a = security_alerts(spark, sf)
    return rounded(ev.detection_metrics(a, a.select("alert_id", "is_attack")))


@query
def eval_roc(spark, sf):
    a = security_alerts(spark, sf)
    curve = ev.roc_curve(a, a.select("alert_id", "is_attack"))
    threshold = F.when(F.col("threshold") < 2, F.col("threshold"))
    return rounded(curve.withColumn("threshold", threshold))


@query
def eval_auc(spark, sf):
    a = security_alerts(spark, sf)
    return rounded(ev.auc_score(a, a.select("alert_id", "is_attack")))


@query
def synthetic_labels(spark, sf):
    return ev.synthetic_labels(security_alerts(spark, sf))


@query
def recent_events(spark, sf):
    return dt.recent_events(security_events(spark, sf)).select("event_id", "ts")


@query
def retain_latest(spark, sf):
    return tb.retain_latest(security_events(spark, sf), 5000).select("event_id", "ts")


@query
def upsert_new_alerts(spark, sf):
    """Insert all alerts into a table that already holds the severe ones."""
    a = security_alerts(spark, sf)
    return tb.absent_rows(a, a.filter(F.col("severity") == "high"), "alert_id").select(
        "alert_id", "severity"
    )


@query
def incident_updates(spark, sf):
    """Notes on every incident, a new status on large ones; an unknown status is rejected."""
    a = security_alerts(spark, sf)
    i = _incidents(a)
    updates = i.select(
        "incident_id",
        F.when(F.col("total_alerts") > 170, "investigating")
        .when(F.col("total_alerts") > 160, "closed")
        .otherwise(F.lit(None))
        .alias("status"),
        F.concat(F.lit("seen "), F.col("total_alerts").cast("string")).alias("analyst_notes"),
        F.lit(None).cast("string").alias("resolution_reason"),
    )
    return tb.incident_updates(i, updates)[0]


@query
def validate_events(spark, sf):
    """Rows as they might arrive: some sources are unknown, some timestamps missing."""
    e = security_events(spark, sf)
    raw = e.select(
        "event_id",
        F.when(F.col("host") == "host3", "dns").otherwise(F.col("source")).alias("source"),
        F.when(F.col("action") == "deny", F.lit("")).otherwise(F.col("ts").cast("string")).alias("ts"),
    )
    return tb.validate_events(raw).select("event_id", "source", "reject_reason")


@query
def noisy_or(spark, sf):
    """Two scores of an alert taken as independent evidence."""
    both = scores.noisy_or(F.col("window_score"), F.col("sequence_score"))
    return rounded(security_alerts(spark, sf).select("alert_id", both.alias("joint_score")))
