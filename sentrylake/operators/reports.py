"""Analyst queries over the alert and incident tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import present, title_case
from ..functions.scores import agreement, entity_risk, risk_band, severity_rank
from ..functions.timefn import floor_minutes
from ..schema import SEVERITIES
from .skew import spread_join


def _bounded(name: str, value: int, largest: int) -> int:
    if not 1 <= value <= largest:
        raise ValueError(f"{name} must lie between 1 and {largest}")
    return value


def alerts_with(
    alerts: DataFrame, min_severity: str = "low", user: str | None = None, ip: str | None = None
) -> DataFrame:
    """Severity at least min_severity; user compared without case, address exactly."""
    if min_severity not in SEVERITIES:
        raise ValueError(f"min_severity must be one of {SEVERITIES}")
    out = alerts.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(min_severity) + 1)
    if user:
        out = out.filter(F.lower("user_name") == user.lower())
    if ip:
        out = out.filter(F.col("ip") == ip)
    return out


def alerts_list(
    alerts: DataFrame,
    incidents: DataFrame | None = None,
    min_severity: str = "low",
    limit: int = 100,
    user: str | None = None,
    ip: str | None = None,
) -> DataFrame:
    """The newest alerts that pass the filters."""
    _bounded("limit", limit, 1000)
    newest = [F.desc("created_ts"), F.asc("alert_id")]
    out = alerts_with(alerts, min_severity, user, ip).orderBy(*newest).limit(limit)
    if "score" not in out.columns:
        out = out.withColumn("score", F.col("final_risk"))
    if incidents is None:
        return out
    known = incidents.select(F.col("incident_id").alias("incident_id_str"))
    return out.join(known, F.col("incident_id") == F.col("incident_id_str"), "left")


def incidents_list(incidents: DataFrame, limit: int = 100) -> DataFrame:
    _bounded("limit", limit, 500)
    return incidents.orderBy(F.desc("end_ts"), "incident_id").limit(limit)


def incident_detail(
    incidents: DataFrame, alerts: DataFrame, incident_id: str | None = None
) -> DataFrame:
    """One row per alert of the incident (or of every incident), with the incident's columns
    prefixed. Rows rather than a nested list: an incident may hold any number of alerts."""
    if incident_id is not None:
        incidents = incidents.filter(F.col("incident_id") == incident_id)
    head = incidents.select(
        *[F.col(c).alias(c if c == "incident_id" else f"incident_{c}") for c in incidents.columns]
    )
    return head.join(alerts, "incident_id", "left")


def top_risk(alerts: DataFrame, key: str, as_of: Column | DataFrame, k: int = 10) -> DataFrame:
    """Entities of column `key` by weighted risk. `incidents` counts alerts that belong to an
    incident, not distinct incidents."""
    weight = severity_rank(F.col("severity")).cast("double")
    per = (
        alerts.filter(present(F.col(key)))
        .groupBy(key)
        .agg(
            F.greatest(F.max("final_risk"), F.lit(0.0)).alias("max_risk"),
            F.count("incident_id").alias("incidents"),
            F.count(F.lit(1)).alias("alerts"),
            F.sum(weight).alias("weight"),
            F.max("created_ts").alias("latest"),
        )
    )
    if isinstance(as_of, DataFrame):  # one row, one column
        name = as_of.columns[0]
        per, now = per.crossJoin(F.broadcast(as_of)), F.col(name)
    else:
        now = as_of
    risk = entity_risk(
        F.col("max_risk"), F.col("incidents"), F.col("weight"), F.col("latest"), now
    )
    return (
        per.select(key, risk.alias("risk"), "alerts", "incidents")
        .orderBy(F.desc("risk"), key)
        .limit(k)
    )


def health_counts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    e = events.agg(F.count(F.lit(1)).alias("events"))
    return e.crossJoin(alerts.agg(F.count(F.lit(1)).alias("alerts")))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def category_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )


def alerts_per_minute(alerts: DataFrame) -> DataFrame:
    """Counts per minute with the mean of the last five minutes present. The window runs over
    one row per minute of the calendar."""
    per = alerts.groupBy(floor_minutes(F.col("start_ts"), 1).alias("minute")).agg(
        F.count(F.lit(1)).alias("n")
    )
    last5 = Window.orderBy("minute").rowsBetween(-4, 0)
    return per.withColumn("rolling_avg", F.avg("n").over(last5))


def alerts_per_hour(alerts: DataFrame) -> DataFrame:
    """Counts per hour from the first to the last hour, empty hours as 0."""
    per = alerts.groupBy(floor_minutes(F.col("created_ts"), 60).alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hours = per.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(
        F.explode(F.expr("sequence(a, b, interval '1' hour)")).alias("hour")
    )
    return hours.join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


TIMELINE = ["start_ts", "alert_id", "severity", "final_risk", "detection_type", "user_name", "ip"]


def alert_timeline(alerts: DataFrame) -> DataFrame:
    return alerts.select(*TIMELINE).orderBy("start_ts", "alert_id")


def latest_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select("created_ts", *TIMELINE[1:]).orderBy(F.desc("created_ts"), "alert_id")


def related_alerts(alerts: DataFrame, k: int = 20, alert_id: str | None = None) -> DataFrame:
    """For each alert (or the one given) the newest k alerts of the same address and the newest
    k of the same user, itself left out: alert_id, related_id.

    The newest k per key are ranked once (the limit applies before the shuffle); each alert
    then meets at most 2k rows, never all alerts of its key."""
    base = alerts.select("alert_id", "created_ts", "user_name", "ip")
    asked = base if alert_id is None else base.filter(F.col("alert_id") == alert_id)
    found = None
    for key in ("ip", "user_name"):
        newest = Window.partitionBy(key).orderBy(F.desc("created_ts"), "alert_id")
        top = (
            base.filter(present(F.col(key)))
            .withColumn("rn", F.row_number().over(newest))
            .filter(F.col("rn") <= k)
            .select(key, F.col("alert_id").alias("related_id"))
        )
        part = (
            spread_join(asked, top, [key], ["alert_id"])
            .filter(F.col("alert_id") != F.col("related_id"))
            .select("alert_id", "related_id")
        )
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def evidence_timeline(evidence: DataFrame, owner: str, n: int = 10) -> DataFrame:
    """The first n evidence events of each owner, in time order."""
    first = Window.partitionBy(owner).orderBy("ts", "event_id")
    return (
        evidence.withColumn("pos", F.row_number().over(first))
        .filter(F.col("pos") <= n)
        .select(owner, "pos", "event_id", "ts", "source", "event_type", "user_name", "ip")
    )


def model_agreement(alerts: DataFrame) -> DataFrame:
    w, s = F.col("window_score"), F.col("sequence_score")
    return alerts.select(
        "alert_id",
        risk_band(F.col("final_risk")).alias("risk_band"),
        F.abs(w - s).alias("difference"),
        agreement(w, s).alias("agreement"),
        title_case(F.col("detection_type")).alias("detection"),
        title_case(F.coalesce("category", F.lit("unknown"))).alias("category"),
    )


def json_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for output and for stores without nested types."""
    nested = ("array", "map", "struct")
    return df.select(
        *[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]
    )


def percentile_text(p: Column) -> Column:
    return F.when(p == 50.0, "median").otherwise(F.format_string("%.1fth percentile", p))
