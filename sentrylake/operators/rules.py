"""The three fixed rules: brute force, impossible travel, lateral movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import present, stable_id
from ..functions.timefn import floor_minutes, iso_utc, minutes, seconds, seconds_between, time_slot
from .ordered import previous_row
from .skew import spread_join

# Event types read as failed and successful authentication.
FAILURES = ("login_failure", "authentication_failure")
SUCCESSES = ("login_success", "authentication_success")
EVIDENCE_LIMIT = 20
# Fixed value: the distance assumed between two addresses.
DISTANCE_KM = 100.0

RULE_COLUMNS = [
    "rule_id", "rule_name", "confidence", "description", "user_name", "ip", "start_ts", "end_ts",
    "n_events",
]


def _null() -> Column:
    return F.lit(None).cast("string")


def auth_failures(events: DataFrame) -> DataFrame:
    return events.filter(
        (F.col("source") == "auth") & F.col("event_type").isin(*FAILURES) & present(F.col("ip"))
    )


def auth_successes(events: DataFrame) -> DataFrame:
    return events.filter(
        (F.col("source") == "auth")
        & F.col("event_type").isin(*SUCCESSES)
        & present(F.col("user_name"))
        & present(F.col("ip"))
    )


def _rule(name: str, confidence: Column, description: Column) -> list[Column]:
    return [
        stable_id(
            F.lit(name),
            F.col("user_name"),
            F.col("ip"),
            iso_utc(F.col("start_ts")),
            iso_utc(F.col("end_ts")),
        ).alias("rule_id"),
        F.lit(name).alias("rule_name"),
        F.least(F.lit(1.0), confidence).alias("confidence"),
        description.alias("description"),
        "user_name",
        "ip",
        "start_ts",
        "end_ts",
        F.col("n_events").cast("bigint").alias("n_events"),
    ]


def _failure_alerts(
    failures: DataFrame, spans: DataFrame, window_minutes: int, threshold: int
) -> DataFrame:
    """Count the failures of each address between span_from and span_to."""
    # One attacking address may hold most failures; it has one span.
    counted = (
        spread_join(failures.select("ip", "ts"), spans, ["ip"], ["ts"])
        .filter(F.col("ts").between(F.col("span_from"), F.col("span_to")))
        .groupBy("ip")
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .withColumn("user_name", _null())
    )
    return burst_alerts(counted, window_minutes, threshold)


def burst_alerts(counted: DataFrame, window_minutes: int, threshold: int) -> DataFrame:
    """counted: ip, user_name (null), start_ts, end_ts, n_events -> alerts."""
    text = F.format_string(
        "Brute force detected: %d failed logins from %s in %d minutes",
        F.col("n_events"),
        F.col("ip"),
        F.lit(window_minutes),
    )
    return counted.select(
        *_rule("brute_force", F.col("n_events") / F.lit(threshold * 2.0), text)
    )


def _first_per(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)


def _cumulative_spans(failures: DataFrame, window_minutes: int, threshold: int) -> DataFrame:
    """From the first failure of an address to window_minutes past the failure that fires.

    Event i fires once `threshold` failures lie before its time plus the window, which only
    the first `threshold` events of an address can decide; the rank limit keeps just those
    before the shuffle.
    """
    head = _first_per(failures.select("ip", "ts", "event_id"), ["ip"], threshold)
    by_ip = Window.partitionBy("ip")
    decided = head.withColumn(
        "nth", F.max(F.when(F.col("rn") == threshold, F.col("ts"))).over(by_ip)
    )
    fires = F.col("ts") + minutes(window_minutes) >= F.col("nth")
    return (
        decided.filter(F.col("nth").isNotNull())
        .groupBy("ip")
        .agg(F.min("ts").alias("span_from"), F.min(F.when(fires, F.col("ts"))).alias("fire_ts"))
        .select("ip", "span_from", (F.col("fire_ts") + minutes(window_minutes)).alias("span_to"))
    )


def _sliding_spans(failures: DataFrame, window_minutes: int, threshold: int) -> DataFrame:
    """The earliest span of window_minutes holding `threshold` failures of an address.

    Within one slot as long as the window, `threshold` failures already make a hit at the
    first of them, so only the first `threshold` of each slot can matter.
    """
    slotted = failures.select("ip", "ts", "event_id").withColumn(
        "slot", time_slot(F.col("ts"), window_minutes * 60)
    )
    head = _first_per(slotted, ["ip", "slot"], threshold)
    nth = F.lead("ts", threshold - 1).over(Window.partitionBy("ip").orderBy("ts", "event_id"))
    return (
        head.withColumn("nth", nth)
        .filter(F.col("nth") <= F.col("ts") + minutes(window_minutes))
        .groupBy("ip")
        .agg(F.min("ts").alias("span_from"))
        .withColumn("span_to", F.col("span_from") + minutes(window_minutes))
    )


def brute_force(
    events: DataFrame, window_minutes: int = 5, threshold: int = 5, sliding: bool = False
) -> DataFrame:
    """One alert per address. By default failures are counted from the first one on;
    sliding=True asks for `threshold` failures inside one window."""
    failures = auth_failures(events)
    spans = _sliding_spans if sliding else _cumulative_spans
    return _failure_alerts(
        failures, spans(failures, window_minutes, threshold), window_minutes, threshold
    )


def impossible_travel(events: DataFrame, max_speed_kmh: float = 900.0) -> DataFrame:
    """Consecutive logins of a user from two addresses, 100 km apart by assumption, faster
    than max_speed_kmh."""
    # Logins of one user at the same instant never fire against each other, so each instant
    # keeps its first and last one only.
    login = F.struct("event_id", "ts", "event_type", "ip", "host")
    moments = (
        auth_successes(events)
        .groupBy("user_name", "ts")
        .agg(F.min(login).alias("first"), F.max(login).alias("last"))
    )
    pairs = (
        previous_row(moments, ["user_name"], "ts", ["ts"], ["ts", "last"], 10)
        .withColumn("ip", F.col("first.ip"))
        .withColumn("prev_ip", F.col("prev_last.ip"))
    )
    hours = seconds_between(F.col("prev_ts"), F.col("ts")) / F.lit(3600.0)
    speed = F.lit(DISTANCE_KM) / F.col("hours")
    hits = (
        pairs.filter(
            (F.col("prev_ip") != F.col("ip"))
            # Coarse bound first, on the interval; the exact speed decides below.
            & (
                F.col("ts") - F.col("prev_ts")
                <= seconds(int(DISTANCE_KM / max_speed_kmh * 3600) + 1)
            )
        )
        .withColumn("hours", hours)
        .filter(speed > max_speed_kmh)
        .select(
            "user_name",
            F.col("prev_ip").alias("ip_from"),
            F.col("ip").alias("ip_to"),
            F.col("prev_last").alias("login_from"),
            F.col("first").alias("login_to"),
            F.col("prev_ts").alias("start_ts"),
            F.col("ts").alias("end_ts"),
            "hours",
            speed.alias("speed"),
        )
    )
    return travel_alerts(hits, max_speed_kmh)


def travel_alerts(hits: DataFrame, max_speed_kmh: float) -> DataFrame:
    """hits: user_name, ip_from, ip_to, login_from, login_to, start_ts, end_ts, hours, speed ->
    alerts."""
    text = F.format_string(
        "Impossible travel: %s logged in from %s then %s within %.2f hours "
        "(required speed: %.0f km/h)",
        "user_name",
        "ip_from",
        "ip_to",
        "hours",
        "speed",
    )
    alerts = hits.withColumn("ip", _null()).withColumn("n_events", F.lit(2))
    return alerts.select(
        *_rule("impossible_travel", F.col("speed") / F.lit(max_speed_kmh * 2), text),
        "ip_from",
        "ip_to",
        "login_from",
        "login_to",
    )


def host_contacts(events: DataFrame, bucket_minutes: int) -> DataFrame:
    return events.filter(
        F.col("source").isin("network", "auth") & present(F.col("ip")) & present(F.col("host"))
    ).withColumn("bucket_ts", floor_minutes(F.col("ts"), bucket_minutes))


def lateral_movement(
    events: DataFrame, window_minutes: int = 10, threshold: int = 3, bucket_minutes: int = 1
) -> DataFrame:
    """Addresses reaching `threshold` hosts inside one bucket."""
    found = (
        host_contacts(events, bucket_minutes)
        .groupBy("ip", "bucket_ts")
        .agg(
            F.count_distinct("host").alias("n_hosts"),
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .filter(F.col("n_hosts") >= threshold)
        .withColumn("user_name", _null())
    )
    return movement_alerts(found, window_minutes, threshold)


def movement_alerts(found: DataFrame, window_minutes: int, threshold: int) -> DataFrame:
    """found: ip, user_name (null), bucket_ts, n_hosts, start_ts, end_ts, n_events -> alerts."""
    text = F.format_string(
        "Lateral movement detected: %s accessed %d distinct hosts in %d minutes",
        F.col("ip"),
        F.col("n_hosts"),
        F.lit(window_minutes),
    )
    return found.select(
        *_rule("lateral_movement", F.col("n_hosts") / F.lit(threshold * 2.0), text),
        "n_hosts",
        "bucket_ts",
    )


def lateral_hosts(events: DataFrame, threshold: int = 3, bucket_minutes: int = 1) -> DataFrame:
    """The hosts behind each lateral-movement alert: rule_id, host."""
    alerts = lateral_movement(events, threshold=threshold, bucket_minutes=bucket_minutes)
    return (
        host_contacts(events, bucket_minutes)
        .select("ip", "bucket_ts", "host")
        .distinct()
        .join(alerts.select("rule_id", "ip", "bucket_ts"), ["ip", "bucket_ts"])
        .select("rule_id", "host")
        .distinct()
    )


def rule_alerts(events: DataFrame) -> DataFrame:
    """All three rules with the columns their evidence is found by (login_from, login_to,
    bucket_ts), for storing once."""
    parts = [brute_force(events), impossible_travel(events), lateral_movement(events)]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True)
    out = out.unionByName(parts[2], allowMissingColumns=True)
    return out.select(*RULE_COLUMNS, "login_from", "login_to", "bucket_ts")


def all_rules(events: DataFrame) -> DataFrame:
    return rule_alerts(events).select(*RULE_COLUMNS)


EVIDENCE_COLUMNS = [
    "event_id", "ts", "source", "event_type", "user_name", "ip", "host", "dst_ip", "dst_port",
    "command",
]


def rule_evidence(
    events: DataFrame, alerts: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """rule_id and the event columns: the events behind each alert, or for display the first
    `limit` of them in time. alerts: rule_alerts of the same events, when stored."""
    if alerts is None:
        alerts = rule_alerts(events)
    of = {n: alerts.filter(F.col("rule_name") == n) for n in
          ("brute_force", "impossible_travel", "lateral_movement")}
    burst = of["brute_force"].select(
        "rule_id", F.col("ip").alias("rule_ip"), F.col("end_ts").alias("rule_end")
    )
    first = auth_failures(events).select(*EVIDENCE_COLUMNS)
    if limit is not None:
        first = _first_per(first, ["ip"], limit)
    # one alert per address, whose failures may be many
    out = (
        spread_join(first, burst.withColumnRenamed("rule_ip", "ip"), ["ip"], ["event_id"])
        .filter(F.col("ts") <= F.col("rule_end"))
        .select("rule_id", *EVIDENCE_COLUMNS)
    )

    legs = of["impossible_travel"].select(
        "rule_id", "user_name", F.explode(F.array("login_from", "login_to")).alias("e")
    ).select("rule_id", F.lit("auth").alias("source"), "user_name", "e.*")
    out = out.unionByName(legs, allowMissingColumns=True)

    moves = of["lateral_movement"].select("rule_id", "ip", "bucket_ts")
    contacts = host_contacts(events, 1).select("bucket_ts", *EVIDENCE_COLUMNS)
    if limit is not None:
        contacts = _first_per(contacts, ["ip", "bucket_ts"], limit)
    return out.unionByName(
        spread_join(contacts, moves, ["ip", "bucket_ts"], ["event_id"]).select("rule_id", *EVIDENCE_COLUMNS)
    )
