"""Feature windows and sessions over an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import present
from ..functions.timefn import from_instant, to_instant
from ..options import DEFAULTS, Options


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("at", to_instant(F.col("ts"))).withWatermark("at", watermark)


def windows_stream(
    events: DataFrame, opts: Options = DEFAULTS, watermark: str = "6 hours"
) -> DataFrame:
    """The features a stream can keep per window without the whole batch: counts, sums and
    approximate distinct counts (exact ones would keep every value in state). Rare commands
    and login profiles need the batch and come from detection over the recent events."""
    net = F.col("source") == "network"
    auth = F.col("source") == "auth"
    flows = _count_if(net)
    denies = _count_if(net & (F.col("action") == "deny"))
    return (
        _timed(events, watermark)
        .groupBy(F.window("at", f"{opts.window_minutes} minutes").alias("w"), "user_name", "ip")
        .agg(
            _count_if(auth & (F.col("event_type") == "login_failure")).alias("auth_failures"),
            _count_if(auth & (F.col("event_type") == "login_success")).alias("auth_successes"),
            F.approx_count_distinct(
                F.when(net & present(F.col("dst_ip")), F.col("dst_ip")), 0.01
            ).alias("distinct_dst_ips"),
            F.approx_count_distinct(
                F.when(net & (F.col("dst_port") != 0), F.col("dst_port")), 0.01
            ).alias("distinct_dst_ports"),
            F.coalesce(denies / F.nullif(flows, F.lit(0)), F.lit(0.0)).alias("deny_rate"),
            F.coalesce(F.sum(F.when(net, F.col("bytes"))), F.lit(0)).alias("bytes_sum"),
            _count_if(F.col("source") == "process").alias("process_exec_count"),
            F.count(F.lit(1)).alias("event_sequence_len"),
            F.max(F.when(present(F.col("user_name")), 1).otherwise(0))
            .cast("bigint")
            .alias("distinct_users_in_window"),
            sum(
                (F.max(F.when(F.col("source") == s, 1).otherwise(0))
                 for s in ("auth", "network", "process")),
                F.lit(0),
            ).cast("bigint").alias("sources_count"),
        )
        .select(
            "user_name",
            "ip",
            from_instant(F.col("w.start")).alias("start_ts"),
            from_instant(F.col("w.end")).alias("end_ts"),
            "auth_failures",
            "auth_successes",
            "distinct_dst_ips",
            "distinct_dst_ports",
            "deny_rate",
            "bytes_sum",
            "process_exec_count",
            "event_sequence_len",
            "distinct_users_in_window",
            "sources_count",
        )
    )


def sessions_stream(
    events: DataFrame, opts: Options = DEFAULTS, watermark: str = "6 hours"
) -> DataFrame:
    """Sessions closed by the watermark; end_ts is the last event, as in the batch form."""
    gap = f"{opts.session_gap_minutes} minutes"
    return (
        _timed(events, watermark)
        .groupBy(F.session_window("at", gap).alias("w"), "user_name", "ip")
        .agg(F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_events"))
        .select(
            "user_name", "ip", from_instant(F.col("w.start")).alias("start_ts"), "end_ts", "n_events"
        )
    )
