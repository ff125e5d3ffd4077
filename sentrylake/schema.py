"""Canonical event schema and the fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_FIELDS: dict[str, str] = {
    "event_id": "string",
    "ts": "timestamp_ntz",
    "source": "string",
    "event_type": "string",
    "user_name": "string",
    "ip": "string",
    "host": "string",
    "method": "string",
    "reason": "string",
    "app": "string",
    "dst_ip": "string",
    "dst_port": "int",
    "proto": "string",
    "bytes": "bigint",
    "action": "string",
    "sensor": "string",
    "command": "string",
    "parent": "string",
    "extra": "map<string,string>",
}
EVENT_COLUMNS = list(EVENT_FIELDS)
ENVELOPE = ["event_id", "ts", "source", "event_type", "user_name", "ip", "host"]
SOURCES = ("auth", "network", "process")

# Names of the window features, in their order.
FEATURES = [
    "auth_failures",
    "auth_successes",
    "distinct_users_in_window",
    "distinct_dst_ips",
    "distinct_dst_ports",
    "deny_rate",
    "bytes_sum",
    "process_exec_count",
    "rare_command_count",
    "max_rare_command_score",
    "login_hour_deviation_z",
    "event_sequence_len",
    "sources_count",
]

# ATT&CK techniques by detection key (key, tactic, technique, technique id).
MITRE = [
    ("bruteforce", "Credential Access", "Brute Force", "T1110"),
    ("valid_accounts", "Defense Evasion", "Valid Accounts", "T1078"),
    ("command_and_control", "Command and Control", "Application Layer Protocol", "T1071"),
    ("ingress_tool_transfer", "Command and Control", "Ingress Tool Transfer", "T1105"),
    ("account_manipulation", "Persistence", "Account Manipulation", "T1098"),
    ("remote_services", "Lateral Movement", "Remote Services", "T1021"),
    ("port_scan", "Discovery", "Network Service Scanning", "T1046"),
]
# Rule names resolve to the technique they stand for.
MITRE_ALIASES = [
    ("brute_force", "bruteforce"),
    ("impossible_travel", "valid_accounts"),
    ("lateral_movement", "remote_services"),
]
# The severities, from low to high.
SEVERITIES = ("low", "medium", "high")
# The states of an incident.
INCIDENT_STATUSES = ("open", "investigating", "resolved", "false_positive")


def conform(df: DataFrame) -> DataFrame:
    """Select the canonical columns in order; columns the input lacks become typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
            for c, t in EVENT_FIELDS.items()
        ]
    )


def mitre_dimension(spark: SparkSession) -> DataFrame:
    """Technique rows by key, alias keys included (10 rows)."""
    by_key = {row[0]: row[1:] for row in MITRE}
    rows = MITRE + [(alias, *by_key[key]) for alias, key in MITRE_ALIASES]
    return spark.createDataFrame(
        rows, "mitre_key string, tactic string, technique string, technique_id string"
    )
