"""Stream queries: the given events arrive as files and go through Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import present
from ..functions.timefn import micros_of, minutes
from ..operators import features as ft
from ..operators.staging import run_folder, stage
from ..sources.projection import security_events
from ..streaming import ingest, journal
from ..streaming.feature_store import feature_windows, start_features
from ..streaming.rules import STREAMS, keyed_state, state_partitions
from ..streaming.windows import sessions_stream, windows_stream
from .catalog_detect import flat_alerts
from .catalog_sources import ssh_lines, windows_rows, zeek_json_lines
from .detect import detect
from .registry import query, rounded


def arrivals(events: DataFrame, parts: int) -> list[DataFrame]:
    """The events cut by time into `parts` batches of files, and one of far later events, which
    move the watermark past all of them. Nothing for an empty table."""
    micros = micros_of(F.col("ts"))
    newest, cuts = events.agg(
        F.max("ts").cast("string"),
        F.percentile_approx(micros, [i / parts for i in range(1, parts)] or [1.0], 1000),
    ).first()
    if newest is None:
        return []
    edges = [None, *(cuts if parts > 1 else []), None]
    # One of each kind, so that every filtered stream gets one, as complete as there is.
    whole = F.struct(
        sum((present(F.col(c)).cast("int") for c in ("user_name", "ip", "host")), F.lit(0)),
        "event_id",
    )
    late = (
        events.groupBy("source", "event_type")
        .agg(F.max_by(F.struct(*events.columns), whole).alias("e"))
        .select("e.*")
        .withColumn("ts", F.lit(newest).cast("timestamp_ntz") + F.expr("interval '40' day"))
    )
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        after = F.lit(True) if low is None else micros >= low
        out.append(events.filter(after & (F.lit(True) if high is None else micros < high)))
    return [*out, late]


def streamed_together(
    spark: SparkSession, sf: str, builds: list[Callable[[DataFrame], DataFrame]], parts: int = 1,
    again: int = 0,
) -> list[DataFrame]:
    """What each of builds makes of the stream of all events, which arrive in `parts` batches of
    files. Each run of the queries, all at the same time, takes what is there and ends; the
    checkpoints let the next one, and `again` more at the end, add nothing twice."""
    folder = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = stage(security_events(spark, sf), "events")
    batches = arrivals(events, parts)
    if not batches:
        return [build(events) for build in builds]
    for arrived in [*batches, *[None] * again]:
        if arrived is not None:
            arrived.write.mode("append").parquet(f"{folder}/source")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/source")
        running = []
        try:
            with state_partitions(spark):
                for i, build in enumerate(builds):
                    running.append(
                        build(source).writeStream.outputMode("append").format("parquet")
                        .option("path", f"{folder}/out-{i}")
                        .option("checkpointLocation", f"{folder}/checkpoint-{i}")
                        .trigger(availableNow=True)
                        .start()
                    )
            for q in running:
                q.awaitTermination()
        finally:
            for q in running:
                q.stop()
    return [spark.read.parquet(f"{folder}/out-{i}") for i in range(len(builds))]


def streamed(
    spark: SparkSession, sf: str, build: Callable[[DataFrame], DataFrame], parts: int = 1,
    again: int = 0,
) -> DataFrame:
    """streamed_together of one query."""
    return streamed_together(spark, sf, [build], parts, again)[0]


@query
def stream_windows(spark, sf):
    return rounded(streamed(spark, sf, windows_stream))


@query
def stream_sessions(spark, sf):
    """With one run more than there are arrivals, which must change nothing."""
    return streamed(spark, sf, sessions_stream, again=1)


@query
def stream_rules(spark, sf):
    """The three rules over a stream of three batches, with state carried from one to the next."""
    with keyed_state(spark):
        found = streamed_together(spark, sf, list(STREAMS.values()), parts=3)
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]))


@query
def stream_features(spark, sf):
    """All 13 features from a stream of three batches, kept as sums that each batch adds to. The
    first batch is taken in twice, as after a failure before its commit."""
    folder = f"{run_folder(spark)}/features-{uuid.uuid4().hex}"
    events = stage(security_events(spark, sf), "events")
    batches = arrivals(events, 3)[:-1]
    if not batches:
        return ft.window_features(events)
    for arrived, checkpoint in zip([batches[0], None, *batches[1:]], ["a", "b", "b", "b"],
                                   strict=True):
        if arrived is not None:
            arrived.write.mode("append").parquet(f"{folder}/source")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/source")
        start_features(source, f"{folder}/sums", f"{folder}/{checkpoint}").awaitTermination()
    return rounded(feature_windows(spark, f"{folder}/sums"))


@query
def stream_ingest(spark, sf):
    """Log files of three formats, one of them unknown, arrive in a watched folder in three
    batches, each made of every third event. Every batch is handed over twice, as after a failure
    before the checkpoint, and the first two are merged in the end. Returns the committed events."""
    folder = f"{run_folder(spark)}/ingest-{uuid.uuid4().hex}"
    logs, root = f"{folder}/logs", f"{folder}/tables"

    def callback(parsed: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            ingest.store_batch(parsed, root, f"files-{batch_id}", stream="files")

    for third in range(3):
        part = F.col("no") % 3 == third

        def put(df: DataFrame, name: str):
            # Formats are told by file name; Spark starts the names of its files with this word.
            return df.write.mode("append").option("mapreduce.output.basename", name)

        put(zeek_json_lines(spark, sf, part), "zeek").text(logs)
        put(ssh_lines(spark, sf, part), "auth.log").text(logs)
        put(windows_rows(spark, sf, part), "windows").option("header", True).csv(logs)
        put(spark.range(1).select(F.lit("nothing").alias("value")), "readme").text(logs)
        ingest.start_ingestion(
            spark, logs, f"{folder}/checkpoint", callback, 2024, max_files=10_000
        ).awaitTermination()
    newest = [m.last_ts for m in journal.live_batches(spark, root) if m.last_ts]
    if newest:
        journal.merge_old(spark, root, max(newest) + "~")  # behind every time
    return journal.read_events(spark, root).select(
        "event_id", "ts", "source", "event_type", "user_name", "ip", "host", "dst_ip", "dst_port",
        "bytes",
    )


@query
def stream_alerts(spark, sf):
    """The events arrive in two batches, the second holding the last three hours. Each is
    appended, the last six hours are detected anew, and alerts not yet stored are inserted."""
    folder = f"{run_folder(spark)}/alerts-{uuid.uuid4().hex}"
    source, root = f"{folder}/source", f"{folder}/tables"
    events = security_events(spark, sf).withColumn("reject_reason", F.lit(None).cast("string"))
    newest = events.agg(F.max("ts").cast("string")).first()[0]
    if newest is None:
        return flat_alerts(detect(events).alerts)
    late = F.col("ts") > F.lit(newest).cast("timestamp_ntz") - minutes(180)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        ingest.ingest_batch(batch, root, f"events-{batch_id}", stream="events")

    for arrived in (~late, late):
        events.filter(arrived).write.mode("append").parquet(source)
        (
            spark.readStream.schema(events.schema).parquet(source)
            .writeStream.option("checkpointLocation", f"{folder}/checkpoint")
            .foreachBatch(on_batch).trigger(availableNow=True).start().awaitTermination()
        )
    return flat_alerts(spark.read.parquet(f"{root}/alerts").drop("day"))
