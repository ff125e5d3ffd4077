"""Sessions per (user, address) separated by inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import present, stable_id
from ..functions.timefn import iso_utc, time_slot
from ..options import DEFAULTS, Options
from .features import EVIDENCE_FLAGS, evidence_aggregates
from .ordered import gap_groups, with_group_start

KEYS = ["user_name", "ip"]


def session_id(start: Column) -> Column:
    return F.concat(
        F.lit("sess_"), stable_id(F.col("user_name"), F.col("ip"), iso_utc(start))
    )


def session_slots(events: DataFrame, opts: Options = DEFAULTS, aggs: list[Column] = ()) -> DataFrame:
    return gap_groups(events, KEYS, "ts", "ts", opts.session_gap_minutes, aggs)


def evidence_slots(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """session_slots with the evidence flags, worth storing when several steps need slots."""
    return session_slots(events, opts, evidence_aggregates(opts))


def sessions(
    events: DataFrame,
    opts: Options = DEFAULTS,
    with_evidence: bool = False,
    slots: DataFrame | None = None,
) -> DataFrame:
    """session_id, user_name, ip, start_ts, end_ts, n_events; optionally the evidence flags.

    Events are aggregated per gap-wide slot before anything is ordered, so a session of any
    size costs one small row per half hour."""
    if slots is None:
        slots = evidence_slots(events, opts) if with_evidence else session_slots(events, opts)
    flags = EVIDENCE_FLAGS if with_evidence else []
    grouped = slots.groupBy(*KEYS, "group_start").agg(
        F.max("slot_end").alias("end_ts"),
        F.sum("slot_rows").alias("n_events"),
        *[(F.sum(f) if f == "login_events" else F.max(f)).alias(f) for f in flags],
    )
    return grouped.select(
        session_id(F.col("group_start")).alias("session_id"),
        *KEYS,
        F.col("group_start").alias("start_ts"),
        "end_ts",
        "n_events",
        *flags,
    )


def session_events(
    events: DataFrame, opts: Options = DEFAULTS, slots: DataFrame | None = None
) -> DataFrame:
    """The events with the session_id and session_start each belongs to."""
    if slots is None:
        slots = session_slots(events.select(*KEYS, "ts"), opts)
    tagged = with_group_start(events, slots, KEYS, "ts", opts.session_gap_minutes)
    return tagged.withColumnRenamed("group_start", "session_start").withColumn(
        "session_id", session_id(F.col("session_start"))
    )


def session_hosts(
    events: DataFrame, opts: Options = DEFAULTS, slots: DataFrame | None = None
) -> DataFrame:
    """Distinct (session_id, host). Hosts are made distinct per slot before the join."""
    if slots is None:
        slots = session_slots(events.select(*KEYS, "ts"), opts)
    seen = (
        events.filter(present(F.col("host")))
        .select(*KEYS, "host", time_slot(F.col("ts"), opts.session_gap_minutes * 60).alias("slot"))
        .distinct()
    )
    tagged = with_group_start(seen, slots, KEYS, "ts", opts.session_gap_minutes)
    return tagged.select(session_id(F.col("group_start")).alias("session_id"), "host").distinct()


def sessions_by_key(found: DataFrame) -> DataFrame:
    """Each session with its place (from 1) in time order among those of its user and address."""
    in_time = Window.partitionBy(*KEYS).orderBy("start_ts", "session_id")
    return found.select(*KEYS, F.row_number().over(in_time).alias("position"), "session_id")
