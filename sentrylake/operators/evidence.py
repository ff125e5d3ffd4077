"""The events behind each alert, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import DEFAULTS, Options
from .features import window_bounds
from .sessions import session_events
from .signals import window_signal_id
from .skew import spread_join

COLUMNS = ["event_id", "ts", "source", "event_type", "user_name", "ip", "host"]


def alert_evidence(
    events: DataFrame,
    clustered: DataFrame,
    alerts: DataFrame,
    rule_evidence: DataFrame,
    opts: Options = DEFAULTS,
    slots: DataFrame | None = None,
) -> DataFrame:
    """alert_id, signal_id, kind and the event: once per signal it belongs to. alerts must
    carry alert_id and cluster_id. Rows rather than a nested list per alert, since an alert may
    rest on any number of events."""
    owners = clustered.select("signal_id", "kind", "cluster_id").join(
        alerts.select("alert_id", "cluster_id"), "cluster_id"
    ).drop("cluster_id")
    lean = events.select(*COLUMNS)
    by_window = window_bounds(lean, opts).select(
        window_signal_id().alias("signal_id"), *COLUMNS
    )
    by_session = session_events(lean, opts, slots).select(F.col("session_id").alias("signal_id"), *COLUMNS)
    by_rule = rule_evidence.select(F.col("rule_id").alias("signal_id"), *COLUMNS)
    found = by_window.unionByName(by_session).unionByName(by_rule)
    # A long session is one signal with very many events.
    return spread_join(found, owners, ["signal_id"], ["event_id"]).select("alert_id", "signal_id", "kind", *COLUMNS)
