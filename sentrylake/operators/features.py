"""Five-minute feature windows per (user, address) and the statistics behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import is_external, is_service_account, present
from ..functions.timefn import floor_minutes, minutes
from ..options import DEFAULTS, Options
from ..schema import FEATURES
from .skew import spread_join

WINDOW_KEYS = ["user_name", "ip", "start_ts"]
# Remote administration ports and the ports counted as rare.
ADMIN_PORTS = (22, 3389, 5985, 5986, 445, 135)


def window_bounds(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    start = floor_minutes(F.col("ts"), opts.window_minutes)
    return events.withColumn("start_ts", start).withColumn(
        "end_ts", F.col("start_ts") + minutes(opts.window_minutes)
    )


def command_frequency(events: DataFrame) -> DataFrame:
    return (
        events.filter((F.col("source") == "process") & present(F.col("command")))
        .groupBy("command")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def rare_commands(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Process events whose command occurs at most rare_command_max times, with freq.

    No join with the frequencies: one row more than the limit per command is kept (the rank
    limit already applies before the shuffle), so a command that fills a third of the table
    leaves four rows per task, and the surviving rank tells rare from common exactly.
    """
    limit = opts.rare_command_max
    runs = events.filter((F.col("source") == "process") & present(F.col("command"))).select(
        "event_id", "ts", "user_name", "ip", "command"
    )
    by_command = Window.partitionBy("command")
    return (
        runs.withColumn("rn", F.row_number().over(by_command.orderBy("ts", "event_id")))
        .filter(F.col("rn") <= limit + 1)
        .withColumn("freq", F.max("rn").over(by_command).cast("bigint"))
        .filter(F.col("freq") <= limit)
        .drop("rn")
    )


def user_hour_profile(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Mean and population deviation of the login hour per user with enough logins."""
    logins = events.filter(
        (F.col("source") == "auth")
        & (F.col("event_type") == "login_success")
        & present(F.col("user_name"))
    )
    hour = F.hour("ts")
    return (
        logins.groupBy("user_name")
        .agg(
            F.count(F.lit(1)).alias("logins"),
            F.avg(hour).alias("mean_hour"),
            (F.stddev_pop(hour) + F.lit(1e-6)).alias("std_hour"),
        )
        .filter(F.col("logins") >= opts.profile_min_logins)
    )


def login_deviation(
    events: DataFrame, profile: DataFrame | None = None, opts: Options = DEFAULTS
) -> DataFrame:
    """Successful logins of profiled users with |hour - mean| / std."""
    if profile is None:
        profile = user_hour_profile(events, opts)
    logins = events.filter(
        (F.col("source") == "auth")
        & (F.col("event_type") == "login_success")
        & present(F.col("user_name"))
    )
    z = F.abs((F.hour("ts") - F.col("mean_hour")) / F.col("std_hour"))
    return spread_join(logins, profile, ["user_name"], ["event_id"]).select(
        "event_id", "ts", "user_name", "ip", z.alias("hour_z")
    )


def _is(source: str) -> Column:
    return F.col("source") == source


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _any(cond: Column) -> Column:
    return F.coalesce(F.max(cond), F.lit(False))


def evidence_aggregates(opts: Options = DEFAULTS) -> list[Column]:
    """Flags the classifier and the technique mapping read, over one group of events.

    Counts of distinct hosts and addresses are not among them: they do not add up over
    overlapping groups and come from evidence_entities instead.
    """
    net = _is("network")
    cmd = F.when(_is("process"), F.col("command"))
    return [
        _any(is_service_account(F.col("user_name"))).alias("service_account"),
        _any(net & F.col("dst_port").isin(*ADMIN_PORTS)).alias("admin_port"),
        _any(net & is_external(F.col("dst_ip"), opts.rfc1918)).alias("external_dst"),
        _any(net).alias("has_network"),
        _any(_is("auth")).alias("has_auth"),
        _any(_is("process")).alias("has_process"),
        _count_if(
            _is("auth") & F.col("event_type").isin("login_success", "login_failure")
        ).alias("login_events"),
        _any(cmd.contains("useradd") | cmd.contains("chpasswd")).alias("makes_accounts"),
        _any(cmd.startswith("ssh ") | cmd.contains("ssh -o")).alias("runs_ssh"),
        _any(cmd.contains("curl ") | cmd.contains("wget ")).alias("downloads"),
    ]


EVIDENCE_FLAGS = [
    "service_account",
    "admin_port",
    "external_dst",
    "has_network",
    "has_auth",
    "has_process",
    "login_events",
    "makes_accounts",
    "runs_ssh",
    "downloads",
]


def window_features(
    events: DataFrame,
    opts: Options = DEFAULTS,
    with_evidence: bool = False,
    freq_events: DataFrame | None = None,
) -> DataFrame:
    """The 13 features per (user_name, ip, window), optionally with the evidence flags.

    One distinct-aware aggregation over the events. Rare commands join it as marker rows of
    the same union, so no null-safe join on (user, address, window) is needed. The hour is
    the same for all of a window, so the login profile joins the finished windows.
    """
    cols = ["event_id", "ts", "source", "event_type", "user_name", "ip", "host",
            "dst_ip", "dst_port", "bytes", "action", "command"]
    if not with_evidence:
        cols = [c for c in cols if c not in ("host", "event_id")]
    base = events.select(*cols).withColumn("is_event", F.lit(1))
    rare = rare_commands(events if freq_events is None else freq_events, opts).select(
        "ts", "user_name", "ip", (F.lit(1.0) / F.col("freq")).alias("rare_score")
    )
    rows = window_bounds(base.unionByName(rare, allowMissingColumns=True), opts)
    net = _is("network")
    denies = _count_if(net & (F.col("action") == "deny"))
    flows = _count_if(net)
    aggs = [
        _count_if(_is("auth") & (F.col("event_type") == "login_failure")).alias("auth_failures"),
        _count_if(_is("auth") & (F.col("event_type") == "login_success")).alias("auth_successes"),
        F.max(F.when(present(F.col("user_name")), 1).otherwise(0))
        .cast("bigint")
        .alias("distinct_users_in_window"),
        F.count_distinct(F.when(net & present(F.col("dst_ip")), F.col("dst_ip"))).alias(
            "distinct_dst_ips"
        ),
        F.count_distinct(F.when(net & (F.col("dst_port") != 0), F.col("dst_port"))).alias(
            "distinct_dst_ports"
        ),
        F.coalesce(denies / F.nullif(flows, F.lit(0)), F.lit(0.0)).alias("deny_rate"),
        F.coalesce(F.sum(F.when(net, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes_sum"),
        _count_if(_is("process")).alias("process_exec_count"),
        F.count("rare_score").alias("rare_command_count"),
        F.coalesce(F.max("rare_score"), F.lit(0.0)).alias("max_rare_command_score"),
        F.count("is_event").alias("event_sequence_len"),
        # The set of sources is fixed, so three flags count them without a distinct.
        sum(
            (F.max(F.when(_is(s), 1).otherwise(0)) for s in ("auth", "network", "process")),
            F.lit(0),
        ).cast("bigint").alias("sources_count"),
    ]
    if with_evidence:
        aggs += evidence_aggregates(opts)
        aggs.append(F.count_distinct(F.when(present(F.col("host")), F.col("host"))).alias("n_hosts"))
    windows = rows.groupBy("user_name", "ip", "start_ts").agg(*aggs)

    profile = user_hour_profile(events, opts).select("user_name", "mean_hour", "std_hour")
    z = F.abs((F.hour("start_ts") - F.col("mean_hour")) / F.col("std_hour"))
    # Windows without a user are spread over all tasks.
    joined = spread_join(windows, profile, ["user_name"], ["ip", "start_ts"], "left").withColumn(
        "login_hour_deviation_z",
        F.when(F.col("auth_successes") > 0, F.coalesce(z, F.lit(0.0))).otherwise(F.lit(0.0)),
    )
    extra = [*EVIDENCE_FLAGS, "n_hosts"] if with_evidence else []
    end = (F.col("start_ts") + minutes(opts.window_minutes)).alias("end_ts")
    return joined.select("user_name", "ip", "start_ts", end, *FEATURES, *extra)


def entity_flags(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Evidence flags and distinct hosts per window."""
    rows = window_bounds(events, opts)
    return rows.groupBy("user_name", "ip", "start_ts").agg(
        *evidence_aggregates(opts),
        F.count_distinct(F.when(present(F.col("host")), F.col("host"))).alias("n_hosts"),
    )
