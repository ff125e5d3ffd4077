"""The three rules over an event stream, with what they have to remember kept as state.

Each rule is one streaming query. Rows are first added up per key and instant by a windowed or
instant-wise aggregate, which runs map-side and hands on an instant once the watermark has passed
it: the keyed state behind it sees every instant once, complete and, over the batches, in order.
That state is small and does not follow the number of events: the first few failures of an address
and the counts of its one alert, the last login of a user. An event later than the watermark is
dropped, as everywhere in Structured Streaming; an alert comes out when the watermark has passed the
time up to which its events count.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from numbers import Integral

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timefn import from_epoch_micros, from_instant, to_instant
from ..operators import rules as ru

WATERMARK = "6 hours"
_MINUTE = 60_000_000


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("at", to_instant(F.col("ts"))).withWatermark("at", watermark)


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """The instants of a key in one batch, the first column being the time."""
    every = pd.concat([r[columns] for r in rows])
    for micros, *rest in every.sort_values(columns[0]).itertuples(index=False):
        yield int(micros), *(int(x) if isinstance(x, Integral) else x for x in rest)


@contextlib.contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in as many partitions as there are cores, if
    spark.sql.shuffle.partitions asks for more. Each partition costs every batch its own commit and
    worker, also an empty one, nothing merges small ones, and the number holds for the life of a
    checkpoint."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries with state of their own need the RocksDB state store; it is set while they run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(
        name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        yield
    finally:
        spark.conf.set(name, before)


def brute_force_stream(
    events: DataFrame, window_minutes: int = 5, threshold: int = 5, watermark: str = WATERMARK
) -> DataFrame:
    """One alert per address, as rules.brute_force has it. State of an address: its first
    `threshold` failures, then the span of its alert and the failures counted in it."""
    width = window_minutes * _MINUTE
    counts = (
        _timed(ru.auth_failures(events), watermark)
        .groupBy("at", "ip")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("at", "ip", F.unix_micros("at").alias("micros"), "n")
    )
    names = ["ip", "first", "last", "n_events"]

    class Follow(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState(
                "burst", "head array<bigint>, upto bigint, n bigint, last bigint, told boolean"
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            head, upto, n, last, told = self._read()
            decided = upto is not None
            for micros, times in _in_order(rows, ["micros", "n"]) if not told else ():
                if upto is None:
                    head += [micros] * min(times, threshold - len(head))
                    n += times
                    if len(head) == threshold:
                        # the first failure with `threshold` of them up to its window's end
                        last = head[-1]
                        upto = min(t for t in head if t + width >= last) + width
                elif micros <= upto:
                    n, last = n + times, micros
            self.state.update((head, upto, n, last, told))
            if upto is None or told:
                return
            due = upto // 1000 + 1
            if due <= timerValues.getCurrentWatermarkInMs():
                yield from self._tell(key)
            elif not decided:
                self.handle.registerTimer(due)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self._tell(key)

        def _read(self):
            if not self.state.exists():
                return [], None, 0, 0, False
            head, *rest = self.state.get()
            return [int(t) for t in head], *rest

        def _tell(self, key) -> Iterator[pd.DataFrame]:
            head, upto, n, last, told = self._read()
            if not told:
                self.state.update((head[:1], upto, n, last, True))
                yield pd.DataFrame([(key[0], head[0], last, n)], columns=names)

        def close(self) -> None:
            pass

    alerts = counts.groupBy("ip").transformWithStateInPandas(
        Follow(), "ip string, first bigint, last bigint, n_events bigint", "append", "eventTime"
    )
    counted = alerts.select(
        "ip", F.lit(None).cast("string").alias("user_name"),
        from_epoch_micros(F.col("first")).alias("start_ts"),
        from_epoch_micros(F.col("last")).alias("end_ts"), "n_events",
    )
    return ru.burst_alerts(counted, window_minutes, threshold).select(*ru.RULE_COLUMNS)


def impossible_travel_stream(
    events: DataFrame, max_speed_kmh: float = 900.0, watermark: str = WATERMARK
) -> DataFrame:
    """As rules.impossible_travel. State of a user: time and address of the last login."""
    login = F.struct("event_id", "event_type", "ip", "host")
    moments = (
        _timed(ru.auth_successes(events), watermark)
        .groupBy("at", "user_name")
        .agg(F.min(login).alias("first"), F.max(login).alias("last"))
        .select("at", "user_name", F.unix_micros("at").alias("micros"),
                F.col("first.ip").alias("first_ip"), F.col("last.ip").alias("last_ip"))
    )
    names = ["user_name", "ip_from", "ip_to", "from_micros", "to_micros"]

    class Follow(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("login", "micros bigint, ip string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before, found = self.state.get() if self.state.exists() else None, []
            for micros, first_ip, last_ip in _in_order(rows, ["micros", "first_ip", "last_ip"]):
                if before and before[1] != first_ip:
                    found.append((key[0], before[1], first_ip, before[0], micros))
                before = (micros, last_ip)
            self.state.update(before)
            if found:
                yield pd.DataFrame(found, columns=names)

        def close(self) -> None:
            pass

    pairs = moments.groupBy("user_name").transformWithStateInPandas(
        Follow(),
        "user_name string, ip_from string, ip_to string, from_micros bigint, to_micros bigint",
        "append",
        "eventTime",
    )
    start, end = (from_epoch_micros(F.col(c)) for c in ("from_micros", "to_micros"))
    close = (F.col("to_micros") - F.col("from_micros")) <= F.lit(
        (int(ru.DISTANCE_KM / max_speed_kmh * 3600) + 1) * 1_000_000
    )
    hits = (
        pairs.filter(close)
        .withColumn("start_ts", start)
        .withColumn("end_ts", end)
        .withColumn("hours", (F.col("to_micros") - F.col("from_micros")) / F.lit(1e6) / F.lit(3600.0))
        .withColumn("speed", F.lit(ru.DISTANCE_KM) / F.col("hours"))
        .filter(F.col("speed") > max_speed_kmh)
        .withColumn("login_from", F.lit(None).cast("string"))
        .withColumn("login_to", F.lit(None).cast("string"))
    )
    return ru.travel_alerts(hits, max_speed_kmh).select(*ru.RULE_COLUMNS)


def lateral_movement_stream(
    events: DataFrame, window_minutes: int = 10, threshold: int = 3, bucket_minutes: int = 1,
    watermark: str = WATERMARK,
) -> DataFrame:
    """As rules.lateral_movement: hosts of an address and bucket first, then their number; two
    aggregates in a row, without state of our own."""
    bucket = f"{bucket_minutes} minutes"
    hosts = (
        _timed(ru.host_contacts(events, bucket_minutes), watermark)
        .groupBy(F.window("at", bucket).alias("w"), "ip", "host")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    found = (
        hosts.groupBy(F.window(F.window_time("w"), bucket).alias("b"), "ip")
        .agg(
            F.count(F.lit(1)).alias("n_hosts"),
            F.min("first").alias("start_ts"),
            F.max("last").alias("end_ts"),
            F.sum("n").alias("n_events"),
        )
        .filter(F.col("n_hosts") >= threshold)
        .withColumn("bucket_ts", from_instant(F.col("b.start")))
        .withColumn("user_name", F.lit(None).cast("string"))
    )
    return ru.movement_alerts(found, window_minutes, threshold).select(*ru.RULE_COLUMNS)


STREAMS = {
    "brute_force": brute_force_stream,
    "impossible_travel": impossible_travel_stream,
    "lateral_movement": lateral_movement_stream,
}
