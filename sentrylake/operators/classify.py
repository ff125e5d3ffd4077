"""Detection type, category and technique keys from features, evidence flags and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MITRE, MITRE_ALIASES

# Category and technique keys of each detection type.
DETECTIONS = {
    "credential_stuffing": ("authentication", ("bruteforce",)),
    "brute_force_login": ("authentication", ("bruteforce",)),
    "port_scan": ("network_recon", ("port_scan",)),
    "lateral_movement_attempt": ("lateral_movement", ("remote_services",)),
    "exfil_spike": ("exfiltration", ("ingress_tool_transfer",)),
    "service_acct_abuse": ("privilege_misuse", ("valid_accounts", "account_manipulation")),
    "bruteforce": ("authentication", ("bruteforce",)),
    "lateral_movement": ("lateral_movement", ("remote_services",)),
    "abnormal_service_usage": ("privilege_misuse", ("valid_accounts",)),
    "anomalous_behavior": ("suspicious_activity", ("valid_accounts",)),
    "unknown": ("unknown", ()),
}
# Titles exist for these types only.
TITLES = {
    "bruteforce": "Brute Force Attack Detected",
    "port_scan": "Port Scanning Activity",
    "lateral_movement": "Lateral Movement Attempt",
    "exfil_spike": "Data Exfiltration Spike",
    "service_acct_abuse": "Service Account Abuse",
    "anomalous_behavior": "Anomalous Behavior Detected",
}
OTHER_TITLE = "Security Alert"


def _feature(name: str, prefix: str) -> Column:
    return F.coalesce(F.col(f"{prefix}{name}").cast("double"), F.lit(0.0))


def detection_type(prefix: str = "") -> Column:
    """First matching rule over the row's features (absent ones count as 0), evidence flags,
    n_hosts, n_ips, window_score and sequence_score."""
    fails, wins = _feature("auth_failures", prefix), _feature("auth_successes", prefix)
    ports, peers = _feature("distinct_dst_ports", prefix), _feature("distinct_dst_ips", prefix)
    volume = _feature("bytes_sum", prefix)
    rare, runs = _feature("rare_command_count", prefix), _feature("process_exec_count", prefix)
    admin = F.col("admin_port")
    service = F.col("service_account")
    # The thresholds of each rule, in order of priority.
    by_features = [
        (fails >= 15, "credential_stuffing"),
        ((fails >= 10) | ((fails >= 5) & (wins >= 1)), "brute_force_login"),
        ((ports >= 5) & (volume < 1_000_000), "port_scan"),
        ((peers >= 3) & admin, "lateral_movement_attempt"),
        (
            (volume > 10_000_000) | ((volume > 5_000_000) & F.col("external_dst")),
            "exfil_spike",
        ),
        (service & ((rare > 0) | (runs > 10)), "service_acct_abuse"),
    ]
    by_evidence = [
        (F.col("has_auth") & (F.col("login_events") >= 5) & (F.col("n_ips") <= 2), "bruteforce"),
        ((F.col("n_hosts") >= 3) | ((peers >= 3) & admin), "lateral_movement"),
        (volume > 5_000_000, "exfil_spike"),
        (service & F.col("has_process"), "abnormal_service_usage"),
        (F.col("has_network") & (ports >= 3) & (volume < 500_000), "port_scan"),
        (F.lit(True), "anomalous_behavior"),
    ]
    anomalous = (F.col("window_score") > 0.7) | (F.col("sequence_score") > 0.7)
    steps = by_features + [(anomalous & cond, name) for cond, name in by_evidence]
    out = None
    for cond, name in steps:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


def _text_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def category_of(kind: Column) -> Column:
    return _text_map({k: v[0] for k, v in DETECTIONS.items()})[kind]


def class_keys(kind: Column, successes: Column) -> Column:
    """Technique keys of a detection type; a brute-force login that got in adds one."""
    keys = F.create_map(
        *[
            x
            for k, v in DETECTIONS.items()
            for x in (
                F.lit(k),
                F.array(*[F.lit(t) for t in v[1]]) if v[1] else F.array().cast("array<string>"),
            )
        ]
    )[kind]
    return F.when(
        (kind == "brute_force_login") & (successes >= 1),
        F.concat(keys, F.array(F.lit("valid_accounts"))),
    ).otherwise(keys)


def _chosen(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, as an array."""
    return F.filter(
        F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda k: k.isNotNull()
    )


def window_keys() -> Column:
    """Technique keys read off the window features."""
    fails, wins = F.col("auth_failures"), F.col("auth_successes")
    # Thresholds of the mapping.
    guessed = (fails >= 15) & (wins >= 1)
    return _chosen(
        (guessed | (fails >= 20), "bruteforce"),
        (guessed, "valid_accounts"),
        (F.col("rare_command_count") >= 1, "ingress_tool_transfer"),
        (
            (F.col("distinct_dst_ports") >= 3) & (F.col("bytes_sum") > 250_000),
            "command_and_control",
        ),
    )


def evidence_keys() -> Column:
    """Technique keys read off the commands in the evidence."""
    return _chosen(
        (F.col("makes_accounts"), "account_manipulation"),
        (F.col("runs_ssh"), "remote_services"),
        (F.col("downloads"), "ingress_tool_transfer"),
    )


def sorted_keys(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def classified(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add detection_type, category and class_keys."""
    wins = _feature("auth_successes", prefix)
    return (
        df.withColumn("detection_type", detection_type(prefix))
        .withColumn("category", category_of(F.col("detection_type")))
        .withColumn("class_keys", class_keys(F.col("detection_type"), wins))
    )


def mitre_for(
    keys: Column,
    dimension: Sequence[tuple[str, str, str, str]] = tuple(MITRE),
    aliases: Sequence[tuple[str, str]] = tuple(MITRE_ALIASES),
) -> Column:
    """Techniques of an array of keys in key order, each once. The dimension is a handful of
    fixed rows, so it is a literal map inside the row rather than a join."""
    rows = {d[0]: d[1:] for d in dimension}
    rows |= {a: rows[k] for a, k in aliases if k in rows}
    lookup = F.create_map(
        *[
            x
            for k, (tactic, technique, tid) in rows.items()
            for x in (
                F.lit(k),
                F.struct(
                    F.lit(tid).alias("technique_id"),
                    F.lit(technique).alias("technique"),
                    F.lit(tactic).alias("tactic"),
                ),
            )
        ]
    )
    found = F.transform(keys, lambda k: F.try_element_at(lookup, k))
    return F.array_distinct(F.filter(found, lambda m: m.isNotNull()))


def mitre_map(df: DataFrame, id_column: str, keys: str, dimension: DataFrame) -> DataFrame:
    """One row per (id, technique) for a dimension given as a DataFrame; pos follows the key
    order and each technique is kept once."""
    listed = df.select(id_column, F.posexplode(F.array_sort(F.array_distinct(keys))))
    return (
        listed.join(dimension, F.col("col") == F.col("mitre_key"))
        .groupBy(id_column, "technique_id", "technique")
        .agg(F.min("pos").alias("pos"), F.min_by("tactic", "pos").alias("tactic"))
    )


def title(kind: Column, severity: Column, user: Column, ip: Column) -> Column:
    base = F.coalesce(_text_map(TITLES)[kind], F.lit(OTHER_TITLE))
    return F.concat(
        F.upper(severity), F.lit(" "), base, F.lit(" - "),
        F.coalesce(user, ip, F.lit("unknown entity")),
    )
