"""Registered queries: each reads the given tables and returns one flat DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import rules as ru
from ..operators import scoring as sc
from ..operators import sequences as sq
from ..operators import sessions as se
from ..operators.reports import percentile_text
from ..operators.staging import stage
from ..sources.projection import security_events
from .registry import query, rounded

def _stored_events(spark, sf) -> DataFrame:
    """The events in columnar form, for queries that read them more than once."""
    return stage(security_events(spark, sf), "events")


def _staged_windows(spark, sf) -> DataFrame:
    """The feature table, written once: statistics, scaling and scores each read it."""
    return stage(ft.window_features(_stored_events(spark, sf)), "windows")


# ---------------------------------------------------------------- features


@query
def window_features(spark, sf):
    return rounded(ft.window_features(_stored_events(spark, sf)))


@query
def window_bounds(spark, sf):
    return ft.window_bounds(security_events(spark, sf)).select("event_id", "start_ts", "end_ts")


@query
def command_frequency(spark, sf):
    return ft.command_frequency(security_events(spark, sf))


@query
def rare_commands(spark, sf):
    return ft.rare_commands(security_events(spark, sf)).select("event_id", "command", "freq")


@query
def user_hour_profile(spark, sf):
    return rounded(ft.user_hour_profile(security_events(spark, sf)))


@query
def login_deviation(spark, sf):
    return rounded(ft.login_deviation(security_events(spark, sf)))


@query
def entity_flags(spark, sf):
    return ft.entity_flags(security_events(spark, sf))


@query
def feature_stats(spark, sf):
    return rounded(sc.feature_stats(_staged_windows(spark, sf), stored=True))


# ---------------------------------------------------------------- rules


def _rule_rows(df: DataFrame) -> DataFrame:
    return rounded(df.select(*ru.RULE_COLUMNS))


@query
def rule_brute_force(spark, sf):
    return _rule_rows(ru.brute_force(security_events(spark, sf)))


@query
def rule_brute_force_sliding(spark, sf):
    return _rule_rows(ru.brute_force(security_events(spark, sf), sliding=True))


@query
def rule_impossible_travel(spark, sf):
    found = ru.impossible_travel(security_events(spark, sf))
    return rounded(
        found.withColumn("event_from", F.col("login_from.event_id"))
        .withColumn("event_to", F.col("login_to.event_id"))
        .drop("login_from", "login_to")
    )


@query
def rule_lateral_movement(spark, sf):
    return rounded(ru.lateral_movement(security_events(spark, sf)))


@query
def all_rules(spark, sf):
    return _rule_rows(ru.all_rules(security_events(spark, sf)))


@query
def rule_evidence(spark, sf):
    found = ru.rule_evidence(security_events(spark, sf), limit=ru.EVIDENCE_LIMIT)
    return found.select("rule_id", "event_id")


@query
def rule_evidence_all(spark, sf):
    return ru.rule_evidence(security_events(spark, sf)).select("rule_id", "event_id")


@query
def lateral_hosts(spark, sf):
    return ru.lateral_hosts(security_events(spark, sf))


# ---------------------------------------------------------------- sessions and sequences


@query
def sessions(spark, sf):
    return se.sessions(security_events(spark, sf))


@query
def session_events(spark, sf):
    return se.session_events(security_events(spark, sf)).select("session_id", "event_id")


@query
def sessions_by_key(spark, sf):
    return se.sessions_by_key(se.sessions(security_events(spark, sf)))


@query
def token_vocab(spark, sf):
    return sq.token_vocab(security_events(spark, sf))


@query
def token_sequences(spark, sf):
    ev = _stored_events(spark, sf)
    # Stored, its size is known: Spark broadcasts the vocabulary if it is small.
    return sq.token_sequences(ev, stage(sq.token_vocab(ev), "vocab")).select(
        "session_id", "length", F.concat_ws(" ", F.col("token_ids").cast("array<string>")).alias("ids")
    )


@query
def sequence_surprisal(spark, sf):
    ev = _stored_events(spark, sf)
    vocab = stage(sq.token_vocab(ev), "vocab")
    pairs = stage(sq.session_transitions(sq.session_tail(ev, vocab)), "pairs")
    scored = sq.surprisal(pairs, stage(sq.fit_transitions(pairs), "transitions"), vocab)
    return rounded(scored.select("session_id", "length", "raw_score"))


# ---------------------------------------------------------------- scores


@query
def baseline_window_score(spark, sf):
    windows = _staged_windows(spark, sf)
    scored = sc.baseline_scores(windows, sc.feature_stats(windows, stored=True))
    scaled = sc.scale_by_batch(scored, "raw_score", "window_score")
    return rounded(scaled.select("user_name", "ip", "start_ts", "raw_score", "window_score"))


@query
def quantile_scale(spark, sf):
    windows = _staged_windows(spark, sf)
    scaled = sc.scale_by_batch(windows, "bytes_sum", "bytes_scaled", stored=True)
    return rounded(scaled.select("user_name", "ip", "start_ts", "bytes_sum", "bytes_scaled"))


@query
def explain_features(spark, sf):
    windows = _staged_windows(spark, sf)
    found = sc.explain_features(windows, sc.feature_stats(windows, stored=True))
    return rounded(found).withColumn("percentile_text", percentile_text(F.col("percentile")))


@query
def explain_features_within(spark, sf):
    return rounded(sc.explain_features(_staged_windows(spark, sf), None, 3))
