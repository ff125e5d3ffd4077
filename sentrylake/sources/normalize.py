"""Raw auth, network and process records to canonical events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import (
    blank_to_null,
    clean_ip,
    clean_user,
    int_or_zero,
    stable_id,
)
from ..functions.timefn import iso_utc, parse_utc
from ..schema import EVENT_COLUMNS, EVENT_FIELDS

# All raw values are read as text and cast here, so one odd value rejects a row, not a file.
RAW_FIELDS = {
    "auth": ["ts", "event", "user", "ip", "method", "reason", "host", "app"],
    "network": [
        "ts", "event", "src_ip", "dst_ip", "dst_port", "proto", "bytes", "action", "sensor",
    ],
    "process": ["ts", "event", "user", "ip", "host", "command", "parent"],
}


def raw_schema(source: str) -> str:
    return ", ".join(f"`{c}` string" for c in RAW_FIELDS[source])


def _padded(raw: DataFrame, source: str) -> DataFrame:
    missing = [c for c in RAW_FIELDS[source] if c not in raw.columns]
    return raw.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])


def _finish(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    reason = F.when(F.col("ts").isNull(), "bad ts")
    for bad, text in checks:
        reason = reason.when(bad, text)
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
            for c, t in EVENT_FIELDS.items()
        ],
        reason.alias("reject_reason"),
        "raw_ts",
    )


def _id(source: str, *rest: Column) -> Column:
    return stable_id(F.lit(source), iso_utc(F.col("ts")), F.col("event_type"), *rest)


def _or_dash(name: str) -> Column:
    return F.coalesce(blank_to_null(F.col(name)), F.lit("-"))


def normalize_auth(raw: DataFrame) -> DataFrame:
    r = _padded(raw, "auth")
    shaped = r.select(
        F.col("ts").alias("raw_ts"),
        parse_utc(F.col("ts")).alias("ts"),
        F.lit("auth").alias("source"),
        F.coalesce("event", F.lit("auth_event")).alias("event_type"),
        clean_user(F.col("user")).alias("user_name"),
        clean_ip(F.col("ip")).alias("ip"),
        blank_to_null(F.col("host")).alias("host"),
        "method",
        "reason",
        "app",
    )
    ids = _id("auth", *[_or_dash(c) for c in ("user_name", "ip", "host", "app")])
    return _finish(shaped.withColumn("event_id", ids), [])


def normalize_network(raw: DataFrame) -> DataFrame:
    """The source address is the event's address; user and host are unknown at this layer."""
    r = _padded(raw, "network")
    shaped = r.select(
        F.col("ts").alias("raw_ts"),
        parse_utc(F.col("ts")).alias("ts"),
        F.lit("network").alias("source"),
        F.coalesce("event", F.lit("netflow")).alias("event_type"),
        clean_ip(F.col("src_ip")).alias("ip"),
        clean_ip(F.col("dst_ip")).alias("dst_ip"),
        int_or_zero(F.col("dst_port"), "int").alias("dst_port"),
        "proto",
        int_or_zero(F.col("bytes")).alias("bytes"),
        "action",
        "sensor",
    )
    ids = _id("network", *[_or_dash(c) for c in ("ip", "dst_ip")],
              F.col("dst_port"), _or_dash("proto"))
    return _finish(
        shaped.withColumn("event_id", ids),
        [(F.col("dst_port").isNull(), "bad dst_port"), (F.col("bytes").isNull(), "bad bytes")],
    )


def normalize_process(raw: DataFrame) -> DataFrame:
    r = _padded(raw, "process")
    shaped = r.select(
        F.col("ts").alias("raw_ts"),
        parse_utc(F.col("ts")).alias("ts"),
        F.lit("process").alias("source"),
        F.coalesce("event", F.lit("process_exec")).alias("event_type"),
        clean_user(F.col("user")).alias("user_name"),
        clean_ip(F.col("ip")).alias("ip"),
        blank_to_null(F.col("host")).alias("host"),
        "command",
        "parent",
    )
    ids = _id("process", *[_or_dash(c) for c in ("user_name", "ip", "host", "command")])
    return _finish(shaped.withColumn("event_id", ids), [])


# Source name -> normaliser; further sources register theirs here.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "auth": normalize_auth,
    "network": normalize_network,
    "process": normalize_process,
}


def normalize(source: str, raw: DataFrame) -> DataFrame:
    """Canonical columns plus reject_reason (null for a good row) and raw_ts."""
    if source not in NORMALIZERS:
        raise ValueError(f"unsupported source: {source}")
    return NORMALIZERS[source](raw)


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).select(*EVENT_COLUMNS)


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNotNull()).select(
        "source", "raw_ts", "event_type", "reject_reason"
    )


def ingest_summary(normalized: DataFrame) -> DataFrame:
    good = F.col("reject_reason").isNull()
    return normalized.groupBy("source").agg(
        F.count(F.when(good, 1)).alias("ingested"), F.count(F.when(~good, 1)).alias("rejected")
    )
