"""Security events and alerts derived from the given `events` table.

The same column texts serve Spark and the checking SQL; only the spelling of the string type,
the JSON access and the time arithmetic differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import conform

_EVENT_TEXT = {
    "event_id": "lpad(cast(event_id as {S}), 12, '0')",
    "ts": "{T}",
    "source": "case event_type when 'error' then 'auth' when 'signup' then 'auth' "
    "when 'purchase' then 'process' else 'network' end",
    "event_type": "case event_type when 'error' then 'login_failure' when 'signup' then "
    "'login_success' when 'purchase' then 'process_exec' else 'netflow' end",
    "user_name": "case when event_type in ('click','view') then null "
    "else 'user' || cast(user_id % 12 as {S}) end",
    "ip": "'10.0.' || cast(user_id % 2 as {S}) || '.' || cast(user_id % 7 as {S})",
    "host": "case when event_type in ('click','view') then null "
    "else 'host' || cast(event_id % 6 as {S}) end",
    "dst_ip": "case when event_type in ('click','view') then "
    "(case when event_id % 5 = 0 then '203.0.113.' else '10.1.0.' end) "
    "|| cast({K} % 9 as {S}) end",
    "dst_port": "case when event_type in ('click','view') then case {K} % 10 when 0 then 22 "
    "when 1 then 443 when 2 then 3389 when 3 then 4444 when 4 then 53 when 5 then 445 "
    "else 1000 + {K} % 10 end end",
    "bytes": "case when event_type in ('click','view') then cast(floor(value * 1000) as bigint) end",
    "action": "case when event_type in ('click','view') then "
    "case when {K} % 25 = 0 then 'deny' else 'allow' end end",
    "command": "case when event_type = 'purchase' then (case {K} % 8 when 0 then 'curl http://x/' "
    "when 1 then 'ssh -o a@' when 2 then 'sudo useradd -m u' else 'ls ' end) "
    "|| cast(case when {K} % 8 < 3 then event_id else {K} end as {S}) end",
}

_ALERT_TEXT = {
    "alert_id": "'al_' || lpad(cast(event_id as {S}), 12, '0')",
    "created_ts": "{T}",
    "start_ts": "{T}",
    "user_name": "case when event_id % 7 = 0 then null else 'user' || cast(user_id % 12 as {S}) end",
    "ip": "'10.0.' || cast(user_id % 2 as {S}) || '.' || cast(user_id % 7 as {S})",
    "final_risk": "cast((event_id * 37) % 1000 as double) / 1000",
    "window_score": "cast((event_id * 53) % 1000 as double) / 1000",
    "sequence_score": "cast((event_id * 71) % 1000 as double) / 1000",
    "severity": "case when (event_id * 37) % 1000 >= 750 then 'high' "
    "when (event_id * 37) % 1000 >= 450 then 'medium' else 'low' end",
    "detection_type": "case event_type when 'error' then 'bruteforce' when 'view' then 'port_scan' "
    "when 'click' then 'exfil_spike' when 'signup' then 'anomalous_behavior' else 'unknown' end",
    "category": "case event_type when 'error' then 'authentication' when 'view' then "
    "'network_recon' when 'click' then 'exfiltration' when 'signup' then 'suspicious_activity' end",
    "incident_id": "case when event_id % 3 = 0 then null "
    "else 'inc_' || cast(event_id % 40 as {S}) end",
    "is_attack": "(event_id * 29) % 1000 >= 600",
}

_SPARK = {
    "S": "string",
    "K": "props_k",
    "T": "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,0,"
    "cast(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 30 "
    "as decimal(18,0)) * 0.000001BD)",
}
_DUCK = {
    "S": "varchar",
    "K": "cast(json_extract_string(props,'$.k') as integer)",
    "T": "timestamp '2024-01-01 00:00:00' "
    "+ to_microseconds((epoch_us(ts) - 1704067200000000) // 30)",
}


def _filled(text: str, words: dict[str, str]) -> str:
    for name, word in words.items():
        text = text.replace("{" + name + "}", word)
    return text


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Parsed once a row: written out, it would be parsed anew for each branch that asks for it.
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "*", "cast(get_json_object(props,'$.k') as int) as props_k"
    )
    return conform(raw.selectExpr(*[f"{_filled(t, _SPARK)} as {c}" for c, t in _EVENT_TEXT.items()]))


def security_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.selectExpr(*[f"{_filled(t, _SPARK)} as {c}" for c, t in _ALERT_TEXT.items()])


def _sql(texts: dict[str, str]) -> str:
    cols = ", ".join(f"{_filled(t, _DUCK)} as {c}" for c, t in texts.items())
    return f"select {cols} from events"


EVENTS_SQL = _sql(_EVENT_TEXT)
ALERTS_SQL = _sql(_ALERT_TEXT)
