"""Registered queries over signals, clusters, incidents and alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as cl
from ..operators import correlate as co
from ..operators import features as ft
from ..operators import merge as mg
from ..operators import rules as ru
from ..operators import signals as sg
from ..operators.merge_state import merge_batch, merged_members
from ..operators.reports import json_columns
from ..operators.sequences import PAD, UNKNOWN
from ..operators.staging import run_folder, stage
from ..schema import mitre_dimension
from ..sources.projection import security_alerts, security_events
from . import detect as dt
from .registry import query, rounded

FLAT_SIGNAL = [
    "signal_id", "kind", "start_ts", "end_ts", "user_name", "ip", "score", "window_score",
    "sequence_score", "final_risk", "detection_type", "category",
]


def _signals(spark, sf) -> DataFrame:
    return dt.build_signals(_events(spark, sf)).signals


def _events(spark, sf) -> DataFrame:
    """The events stored once in columnar form, as every detection run reads them."""
    return stage(security_events(spark, sf), "events")


def _flat(signals: DataFrame) -> DataFrame:
    return rounded(
        signals.select(*FLAT_SIGNAL, F.concat_ws(",", "mitre_keys").alias("mitre_keys"))
    )


def _scored(spark, sf) -> DataFrame:
    windows = stage(ft.window_features(_events(spark, sf), with_evidence=True), "windows")
    return dt.score_windows(windows, dt.Models())


@query
def classify_windows(spark, sf):
    scored = _scored(spark, sf).withColumn("sequence_score", F.lit(0.0))
    scored = scored.withColumn("n_ips", F.when(F.col("ip") != "", 1).otherwise(0))
    out = cl.classified(scored)
    keys = cl.sorted_keys(cl.window_keys(), cl.evidence_keys(), F.col("class_keys"))
    return rounded(
        out.select(
            "user_name", "ip", "start_ts", "window_score", "detection_type", "category",
            F.concat_ws(",", keys).alias("mitre_keys"),
        )
    )


@query
def signal_filter(spark, sf):
    kept = _scored(spark, sf).filter(F.col("window_score") >= 0.25)
    return rounded(kept.select("user_name", "ip", "start_ts", "window_score"))


@query
def signals_window(spark, sf):
    return _flat(sg.window_signals(_scored(spark, sf)))


@query
def signals_sequence(spark, sf):
    return _flat(_signals(spark, sf).filter(F.col("kind") == "sequence_anomaly"))


@query
def rule_fusion(spark, sf):
    ev = _events(spark, sf)
    signals = dt.build_signals(ev).signals.filter(~F.col("kind").startswith("rule_"))
    fused = sg.fused_rules(ru.all_rules(ev), signals)
    return rounded(
        fused.select("rule_id", "rule_name", "confidence", "model_score", "final_score")
    )


@query
def signals(spark, sf):
    return _flat(_signals(spark, sf))


@query
def mitre_map(spark, sf):
    return cl.mitre_map(
        _signals(spark, sf), "signal_id", "mitre_keys", mitre_dimension(spark)
    ).drop("pos")


@query
def correlate_clusters(spark, sf):
    return co.signal_clusters(_signals(spark, sf)).select(
        "signal_id", "entity", "cluster_start", "cluster_id"
    )


@query
def correlate_latest(spark, sf):
    return co.signal_clusters(_signals(spark, sf), latest_only=True).select(
        "signal_id", "entity", "cluster_start", "cluster_id"
    )


def _text_of(categories):
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(categories)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )


def _detected(spark, sf) -> dt.Detection:
    ev = _events(spark, sf)
    return dt.detect(ev, created_ts=ev.agg(F.max("ts")).scalar())


@query
def incident_summary(spark, sf):
    ev = _events(spark, sf)
    found = dt.build_signals(ev)
    clustered = stage(co.signal_clusters(found.signals), "clustered")
    hosts = sg.signal_hosts(ev, found.session_hosts, found.evidence)
    s = co.cluster_summary(clustered, hosts, sg.signal_ips(found.signals, found.evidence))
    return rounded(
        s.select(
            "cluster_id", "entity", "n_signals", "start_ts", "end_ts", "primary_user",
            "primary_ip", "window_score", "sequence_score", "raw_risk",
            F.concat_ws(",", "kinds").alias("kinds"), "service_account", "admin_port",
            "external_dst", "login_events", "n_hosts", "n_ips", "detection_type", "category",
            F.concat_ws(",", "mitre_keys").alias("mitre_keys"),
        )
    )


@query
def incident_top_features(spark, sf):
    found = dt.build_signals(_events(spark, sf))
    clustered = stage(co.signal_clusters(found.signals), "clustered")
    return rounded(co.incident_top_features(clustered, found.stats))


def flat_alerts(a: DataFrame) -> DataFrame:
    return rounded(
        a.withColumn("mitre", F.concat_ws(",", F.col("mitre.technique_id")))
        .withColumn("top_features", F.concat_ws(",", F.col("top_features.feature")))
    )


@query
def alerts(spark, sf):
    return flat_alerts(_detected(spark, sf).alerts)


@query
def incidents(spark, sf):
    i = _detected(spark, sf).correlation.incidents
    return i.withColumn("categories", _text_of(F.col("categories")))


@query
def incident_entities(spark, sf):
    return _detected(spark, sf).correlation.entities


@query
def merge_incidents(spark, sf):
    i = _detected(spark, sf).incidents
    return i.withColumn("categories", _text_of(F.col("categories")))


@query
def incidents_json(spark, sf):
    """Incidents as they leave the system: nested columns as JSON text."""
    return json_columns(_detected(spark, sf).incidents).select("incident_id", "categories")


@query
def merge_members(spark, sf):
    """Every member of every merged incident with its own text."""
    return _detected(spark, sf).members.select("incident_id", "merged_id", "summary")


def _single_incidents(spark, sf):
    """Alerts of the fixture taken as one incident each."""
    return security_alerts(spark, sf).select(
        F.col("alert_id").alias("incident_id"),
        "start_ts",
        F.col("start_ts").alias("end_ts"),
        F.col("ip").alias("primary_ip"),
        F.col("user_name").alias("primary_user"),
        F.lit(1).alias("total_alerts"),
        F.col("severity").alias("max_severity"),
        F.create_map("detection_type", F.lit(1).cast("bigint")).alias("categories"),
        F.col("detection_type").alias("summary"),
        F.lit("open").alias("status"),
        F.lit("").alias("analyst_notes"),
        F.lit("").alias("resolution_reason"),
    )


@query
def merge_alert_groups(spark, sf):
    """Merging on its own, in one run."""
    members = mg.merge_incidents(_single_incidents(spark, sf)).members
    return members.select("incident_id", "merged_id")


@query
def merge_alert_batches(spark, sf):
    """The same incidents taken in as three batches that overlap in time: every third one."""
    root = f"{run_folder(spark)}/merging-{uuid.uuid4().hex}"
    each = stage(_single_incidents(spark, sf), "single-incidents")
    for number in range(3):
        third = F.pmod(F.xxhash64("incident_id"), F.lit(3)) == number
        merge_batch(each.filter(third), root, number)
    return merged_members(spark, root)


@query
def risk_normalize(spark, sf):
    a = security_alerts(spark, sf).select("alert_id", F.col("final_risk").alias("raw_risk"))
    return rounded(co.normalized_risk(a))


@query
def severity_quantile(spark, sf):
    a = security_alerts(spark, sf).select("alert_id", "final_risk")
    return rounded(co.quantile_severity(a))


@query
def incident_severity(spark, sf):
    a = security_alerts(spark, sf).filter(F.col("incident_id").isNotNull())
    i = a.select("incident_id").distinct().withColumn("max_severity", F.lit("low"))
    return co.incident_severity(i, a)


@query
def alert_evidence(spark, sf):
    return _detected(spark, sf).evidence.select("alert_id", "signal_id", "kind", "event_id")


# ---------------------------------------------------------------- trained models


def _forest_windows(spark, sf) -> DataFrame:
    return stage(ft.window_features(_events(spark, sf)), "windows")


@query
def isolation_forest(spark, sf):
    """Scores of a forest grown on the same windows."""
    from ..operators.iforest import forest_scores, train_forest

    windows = _forest_windows(spark, sf)
    nodes = stage(train_forest(windows), "trees")
    return rounded(
        forest_scores(windows, nodes).select("user_name", "ip", "start_ts", "forest_raw")
    )


@query
def reconstruction_error(spark, sf):
    from ..operators.reconstruction import fit_reconstruction, reconstruction_errors

    windows = _forest_windows(spark, sf)
    scored = reconstruction_errors(windows, fit_reconstruction(windows))
    return rounded(scored.select("user_name", "ip", "start_ts", "reconstruction_raw"))


@query
def detect_with_models(spark, sf):
    """Full detection with trained models instead of the baseline score."""
    from ..operators.staging import run_folder
    from .train import fit

    ev = _events(spark, sf)
    models = fit(ev, f"{run_folder(spark)}/models-{uuid.uuid4().hex}")
    found = dt.detect(ev, models, created_ts=ev.agg(F.max("ts")).scalar()).alerts
    return rounded(found.select("alert_id", "start_ts", "end_ts", "severity", "final_risk",
                                "window_score", "sequence_score", "detection_type"))


@query
def stored_models(spark, sf):
    """What a training run leaves behind, read back by path: how often each token of the stored
    vocabulary comes before another one in the stored transitions."""
    from .train import fit, load_models

    root = f"{run_folder(spark)}/models-{uuid.uuid4().hex}"
    fit(_events(spark, sf), root, trees=20, sample=64)
    models = load_models(spark, root)
    before = models.transitions.groupBy(F.col("prev_id").alias("token_id")).agg(
        F.sum("n_pair").alias("n_pairs")
    )
    start, unknown = F.col("token_id") == PAD, F.col("token_id") == UNKNOWN
    return before.join(models.vocab, "token_id", "left").select(
        F.when(start, "<start>").when(unknown, "<unknown>").otherwise(F.col("token")).alias("token"),
        "n_pairs",
    )
