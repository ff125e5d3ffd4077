"""All 13 window features over a stream, exact, from sums that a batch only adds to.

A batch is reduced to partial sums of the windows, command counts and login hours that it touches,
and these are appended as its own partition; no earlier event or sum is read for it. What the
features need from the whole table (how rare a command is, a user's usual login hours) follows from
sums too, so a window's features always are those of all events so far, also when a late event
changes an old window or makes a once rare command common.

Folders below a root, each with a partition batch=n that running batch n again replaces:
windows (counts per window), values (different addresses and ports per window), commands (runs per
command and window) and hours (logins per user and hour). A batch counts once its last folder is
written: `done` holds one row per finished batch, and readers take only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import present
from ..functions.timefn import minutes
from ..operators.features import window_bounds
from ..operators.skew import spread_join
from ..operators.staging import run_scope, stage
from ..operators.tables import read_table
from ..options import DEFAULTS, Options
from ..schema import FEATURES

_KEY = ["user_name", "ip", "start_ts"]
_SUMS = ["auth_failures", "auth_successes", "flows", "denies", "bytes_sum", "process_exec_count",
         "event_sequence_len"]
_SEEN = ["has_user", "has_auth", "has_network", "has_process"]


def _source(name: str) -> Column:
    return F.col("source") == name


def partial_sums(events: DataFrame, opts: Options = DEFAULTS) -> dict[str, DataFrame]:
    """The four tables of one batch."""
    rows = window_bounds(events, opts)
    net, auth = _source("network"), _source("auth")

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    def seen(cond: Column) -> Column:
        return F.max(F.when(cond, 1).otherwise(0))

    windows = rows.groupBy(*_KEY).agg(
        count(auth & (F.col("event_type") == "login_failure")).alias("auth_failures"),
        count(auth & (F.col("event_type") == "login_success")).alias("auth_successes"),
        count(net).alias("flows"),
        count(net & (F.col("action") == "deny")).alias("denies"),
        F.coalesce(F.sum(F.when(net, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes_sum"),
        count(_source("process")).alias("process_exec_count"),
        F.count(F.lit(1)).alias("event_sequence_len"),
        seen(present(F.col("user_name"))).alias("has_user"),
        *[seen(_source(s)).alias(f"has_{s}") for s in ("auth", "network", "process")],
    )
    values = (
        rows.filter(net)
        .select(*_KEY, F.explode(F.array(
            F.struct(F.lit("ip").alias("kind"),
                     F.when(present(F.col("dst_ip")), F.col("dst_ip")).alias("value")),
            F.struct(F.lit("port").alias("kind"),
                     F.when(F.col("dst_port") != 0, F.col("dst_port").cast("string"))
                     .alias("value")),
        )).alias("v"))
        .select(*_KEY, "v.*")
        .filter("value is not null")
        .distinct()
    )
    commands = (
        rows.filter(_source("process") & present(F.col("command")))
        .groupBy("command", *_KEY)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hours = (
        events.filter(auth & (F.col("event_type") == "login_success") & present(F.col("user_name")))
        .groupBy("user_name", F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return {"windows": windows, "values": values, "commands": commands, "hours": hours}


def add_batch(events: DataFrame, root: str, number: int, opts: Options = DEFAULTS) -> None:
    """Take in one batch; only its own rows are read. The same number again replaces it."""
    with run_scope(events.sparkSession):
        fixed = stage(events, "batch")
        for name, table in partial_sums(fixed, opts).items():
            table.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        done = fixed.agg(F.count(F.lit(1)).alias("events"))
        done.write.mode("overwrite").parquet(f"{root}/done/batch={number}")


def _finished(spark: SparkSession, root: str, name: str, done: DataFrame) -> DataFrame:
    # one row per batch
    return read_table(spark, f"{root}/{name}").join(F.broadcast(done), "batch", "left_semi")


def feature_windows(spark: SparkSession, root: str, opts: Options = DEFAULTS) -> DataFrame | None:
    """The features of every window over all finished batches, as features.window_features has
    them; None before the first batch."""
    done = read_table(spark, f"{root}/done")
    if done is None:
        return None
    done = done.select("batch").distinct()
    windows, values, commands, hours = (
        _finished(spark, root, n, done) for n in ("windows", "values", "commands", "hours")
    )
    frequency = commands.groupBy("command").agg(F.sum("n").alias("freq")).filter(
        F.col("freq") <= opts.rare_command_max
    )
    # A rare command has a few rows; the frequent ones find no partner.
    rare = commands.join(frequency, "command").select(
        *_KEY, F.col("n").alias("rare"), (F.lit(1.0) / F.col("freq")).alias("rare_score")
    )
    different = values.select(*_KEY, "kind", "value").distinct().select(
        *_KEY, F.when(F.col("kind") == "ip", 1).alias("ips"),
        F.when(F.col("kind") == "port", 1).alias("ports"),
    )
    rows = windows.unionByName(rare, allowMissingColumns=True).unionByName(
        different, allowMissingColumns=True
    )
    merged = rows.groupBy(*_KEY).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.max(c).alias(c) for c in _SEEN],
        F.count("ips").alias("distinct_dst_ips"),
        F.count("ports").alias("distinct_dst_ports"),
        F.coalesce(F.sum("rare"), F.lit(0)).alias("rare_command_count"),
        F.coalesce(F.max("rare_score"), F.lit(0.0)).alias("max_rare_command_score"),
    )
    profile = (
        hours.groupBy("user_name", "hour").agg(F.sum("n").alias("n"))
        .groupBy("user_name")
        .agg(
            F.sum("n").alias("logins"),
            (F.sum(F.col("n") * F.col("hour")) / F.sum("n")).alias("mean_hour"),
            # 24 hours at most
            F.collect_list(F.struct("hour", "n")).alias("by_hour"),
        )
        .filter(F.col("logins") >= opts.profile_min_logins)
        .withColumn("std_hour", F.expr(
            "sqrt(aggregate(by_hour, 0D, (a, x) -> a + x.n * pow(x.hour - mean_hour, 2)) / logins)"
        ) + F.lit(1e-6))
        .select("user_name", "mean_hour", "std_hour")
    )
    z = F.abs((F.hour("start_ts") - F.col("mean_hour")) / F.col("std_hour"))
    found = (
        spread_join(merged, profile, ["user_name"], ["ip", "start_ts"], "left")
        .withColumn("login_hour_deviation_z", F.when(
            F.col("auth_successes") > 0, F.coalesce(z, F.lit(0.0))).otherwise(F.lit(0.0)))
        .withColumn("deny_rate", F.coalesce(
            F.col("denies") / F.nullif(F.col("flows"), F.lit(0)), F.lit(0.0)))
        .withColumn("distinct_users_in_window", F.col("has_user").cast("bigint"))
        .withColumn("sources_count", F.expr("cast(has_auth + has_network + has_process as bigint)"))
    )
    end = (F.col("start_ts") + minutes(opts.window_minutes)).alias("end_ts")
    return found.select("user_name", "ip", "start_ts", end, *FEATURES)


def start_features(
    events: DataFrame, root: str, checkpoint: str, opts: Options = DEFAULTS,
    interval: str | None = None,
) -> StreamingQuery:
    """Keep the sums of an event stream. A batch that is run again after a failure replaces what
    it had written, so nothing counts twice. Without an interval everything present is read and
    the query ends."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: add_batch(batch, root, number, opts)
    )
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(
        availableNow=True
    )
    return writer.start()
