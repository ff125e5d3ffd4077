"""Full detection: events -> signals, alerts, incidents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import noisy_or
from ..operators import features as ft
from ..operators import rules as ru
from ..operators import scoring as sc
from ..operators import sequences as sq
from ..operators import sessions as se
from ..operators import signals as sg
from ..operators.correlate import Correlation, correlate
from ..operators.evidence import alert_evidence
from ..operators.iforest import forest_scores
from ..operators.merge import merge_incidents, remap_incident
from ..operators.reconstruction import reconstruction_errors
from ..operators.staging import stage
from ..options import DEFAULTS, Options


@dataclass(frozen=True)
class Models:
    """Tables a training run leaves behind. Anything absent is fitted on the batch itself."""

    stats: DataFrame | None = None
    vocab: DataFrame | None = None
    transitions: DataFrame | None = None
    trees: DataFrame | None = None
    reconstruction: DataFrame | None = None
    # name, p10, p90 of the training scores; absent: each batch is scaled by its own quantiles
    quantiles: DataFrame | None = None

    def frozen(self, name: str) -> DataFrame | None:
        return None if self.quantiles is None else self.quantiles.filter(F.col("name") == name)


@dataclass(frozen=True)
class Detection:
    signals: DataFrame
    alerts: DataFrame
    incidents: DataFrame
    entities: DataFrame
    members: DataFrame
    correlation: Correlation
    evidence: DataFrame


def recent_events(
    events: DataFrame, as_of: Column | None = None, opts: Options = DEFAULTS
) -> DataFrame:
    """Events of the last recent_minutes before as_of (default: the newest event)."""
    span = F.expr(f"interval '{opts.recent_minutes}' minute")
    if as_of is not None:
        return events.filter(F.col("ts") >= as_of - span)
    newest = events.agg((F.max("ts") - span).alias("cutoff"))  # one row
    return events.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("cutoff")).drop(
        "cutoff"
    )


def score_windows(windows: DataFrame, models: Models) -> DataFrame:
    """Add window_score. With trained trees and reconstruction the noisy OR of both; without,
    the baseline: largest z of the row, scaled over the batch."""
    if models.trees is not None and models.reconstruction is not None:
        raw = reconstruction_errors(forest_scores(windows, models.trees), models.reconstruction)
        raw = stage(raw, "raw-scores")
        both = sc.scale_by_batch(raw, "forest_raw", "forest_score", models.frozen("forest_raw"), True)
        both = sc.scale_by_batch(
            both, "reconstruction_raw", "reconstruction_score", models.frozen("reconstruction_raw")
        )
        return both.withColumn(
            "window_score", noisy_or(F.col("forest_score"), F.col("reconstruction_score"))
        )
    stats = models.stats if models.stats is not None else sc.feature_stats(windows)
    raw = stage(sc.baseline_scores(windows, stats), "raw-scores")
    return sc.scale_by_batch(raw, "raw_score", "window_score", stored=True)


def score_sessions(
    events: DataFrame,
    models: Models,
    opts: Options = DEFAULTS,
    slots: DataFrame | None = None,
) -> DataFrame:
    """session_id, sequence_score."""
    vocab = models.vocab if models.vocab is not None else stage(sq.token_vocab(events, opts), "vocab")
    pairs = stage(sq.session_transitions(sq.session_tail(events, vocab, opts, slots)), "pairs")
    table = models.transitions if models.transitions is not None else sq.fit_transitions(pairs)
    raw = stage(sq.surprisal(pairs, table, vocab), "surprisal")
    frozen = models.frozen("sequence_raw")
    return sc.scale_by_batch(raw, "raw_score", "sequence_score", frozen, True).select(
        "session_id", "sequence_score"
    )


@dataclass(frozen=True)
class Signals:
    """All signals and the stored tables later steps share."""

    signals: DataFrame
    evidence: DataFrame
    session_hosts: DataFrame
    slots: DataFrame
    stats: DataFrame


def build_signals(
    events: DataFrame, models: Models = Models(), opts: Options = DEFAULTS
) -> Signals:
    windows = stage(ft.window_features(events, opts, with_evidence=True), "windows")
    stats = models.stats if models.stats is not None else sc.feature_stats(windows, stored=True)
    known = replace(models, stats=stats)
    by_window = sg.window_signals(score_windows(windows, known), opts)

    slots = stage(se.evidence_slots(events, opts), "slots")
    hosts = stage(se.session_hosts(events, opts, slots), "session-hosts")
    per_session = hosts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_hosts"))
    found = (
        se.sessions(events, opts, with_evidence=True, slots=slots)
        .join(score_sessions(events, known, opts, slots), "session_id")
        .join(per_session, "session_id", "left")
        .withColumn("n_hosts", F.coalesce("n_hosts", F.lit(0)))
    )
    by_session = sg.sequence_signals(found, opts)
    model_signals = stage(by_window.unionByName(by_session), "model-signals")

    rules = stage(ru.rule_alerts(events), "rules")
    evidence = stage(ru.rule_evidence(events, rules), "evidence")
    by_rule = sg.rule_signals(rules.select(*ru.RULE_COLUMNS), evidence, model_signals, opts)
    signals = stage(model_signals.unionByName(by_rule), "signals")
    return Signals(signals, evidence, hosts, slots, stats)


def detect(
    events: DataFrame,
    models: Models = Models(),
    opts: Options = DEFAULTS,
    created_ts: Column | None = None,
    latest_only: bool = False,
) -> Detection:
    """All outputs. events should be a stored table: it is read several times."""
    s = build_signals(events, models, opts)
    found = correlate(
        s.signals,
        sg.signal_hosts(events, s.session_hosts, s.evidence, opts),
        sg.signal_ips(s.signals, s.evidence),
        s.stats,
        opts,
        created_ts,
        latest_only,
    )
    merged = merge_incidents(found.incidents, opts)
    return Detection(
        signals=s.signals,
        alerts=remap_incident(found.alerts, merged.members),
        incidents=merged.incidents,
        entities=remap_incident(found.entities, merged.members).distinct(),
        members=merged.members,
        correlation=found,
        evidence=alert_evidence(events, found.clustered, found.rated, s.evidence, opts, s.slots),
    )


def detect_recent(
    events: DataFrame,
    models: Models = Models(),
    opts: Options = DEFAULTS,
    as_of: Column | None = None,
) -> Detection:
    return detect(recent_events(events, as_of, opts), models, opts, as_of)
