"""Batch-by-batch ingestion into tables, and the file stream that feeds it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timefn import minutes
from ..operators.staging import run_scope, stage_observed
from ..operators.tables import upsert_alerts
from ..options import DEFAULTS, Options
from ..plans.detect import Models, detect
from ..schema import EVENT_COLUMNS
from ..sources.foreign import read_logs
from . import journal


class RejectedBatch(ValueError):
    """A strict batch held a row that cannot be read."""


@dataclass(frozen=True)
class Ingested:
    ingested: int
    rejected: int
    new_alerts: int


def ingest_batch(
    parsed: DataFrame,
    root: str,
    batch_id: str,
    models: Models = Models(),
    opts: Options = DEFAULTS,
    strict: bool = False,
    stream: str = "",
) -> Ingested:
    """parsed: canonical columns plus reject_reason. Good rows go to root/events, the others to
    root/rejects (a strict batch with any is refused as a whole). Detection then runs over the
    last recent_minutes before the newest event of the batch, and new alerts and incidents are
    inserted. Ids follow from content, so overlapping runs do not repeat alerts. The batch is
    parsed once, into a folder that holds all tables of the run and is deleted at its end.

    The marker of the batch comes last (journal): after a failure the batch is simply handed over
    again, and one that has its marker is not taken in twice, nor are its alerts."""

    def alerts_of(until: str) -> int:
        # As text: a datetime literal would pass through the session time zone.
        newest = F.lit(until).cast("timestamp_ntz")
        since = spark.range(1).select(
            (newest - minutes(opts.recent_minutes)).cast("string")
        ).first()[0]
        recent = journal.read_events(spark, root, since, until, also=batch_id)
        found = detect(recent, models, opts, created_ts=newest)
        return upsert_alerts(found.alerts, found.incidents, root)

    spark = parsed.sparkSession
    return _taken_in(parsed, root, batch_id, strict, stream, alerts_of)


def store_batch(
    parsed: DataFrame, root: str, batch_id: str, strict: bool = False, stream: str = ""
) -> Ingested:
    """ingest_batch without the detection: events and rejects only."""
    return _taken_in(parsed, root, batch_id, strict, stream, lambda until: 0)


def _taken_in(
    parsed: DataFrame, root: str, batch_id: str, strict: bool, stream: str,
    alerts_of: Callable[[str], int],
) -> Ingested:
    spark = parsed.sparkSession
    known = journal.find(spark, root, batch_id)
    if known is not None:
        return Ingested(known.ingested, known.rejected, 0)
    good = F.col("reject_reason").isNull()
    with run_scope(spark):
        parsed, counts = stage_observed(
            parsed,
            "batch",
            F.count(F.when(good, 1)).alias("good"),
            F.count(F.when(~good, 1)).alias("bad"),
            F.min(F.when(good, F.col("ts").cast("string"))).alias("oldest"),
            F.max(F.when(good, F.col("ts").cast("string"))).alias("newest"),
        )
        if strict and counts["bad"]:
            raise RejectedBatch(f"{counts['bad']} bad rows in batch {batch_id}")
        if counts["bad"]:
            journal.write_batch(parsed.filter(~good), root, "rejects", batch_id)
        created = 0
        if counts["good"]:
            journal.write_batch(parsed.filter(good).select(*EVENT_COLUMNS), root, "events", batch_id)
            created = alerts_of(counts["newest"]) if counts["newest"] else 0
        journal.commit(
            spark, root, batch_id, counts["good"], counts["bad"], created,
            counts["oldest"], counts["newest"], stream,
        )
    return Ingested(counts["good"], counts["bad"], created)


def ingest_path(
    spark: SparkSession,
    path: str | list[str],
    root: str,
    batch_id: str,
    year: int,
    models: Models = Models(),
    opts: Options = DEFAULTS,
    strict: bool = False,
) -> Ingested:
    """Ingest files in any known format."""
    return ingest_batch(read_logs(spark, path, year, strict), root, batch_id, models, opts, strict)


def file_stream(spark: SparkSession, log_dir: str, max_files: int = 100) -> DataFrame:
    """New files of a folder as lines (value, file)."""
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files)
        .load(log_dir)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )


def stream_name(checkpoint: str) -> str:
    """Batches are numbered per checkpoint: streams with different ones may share their tables."""
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"


def start_ingestion(
    spark: SparkSession,
    log_dir: str,
    checkpoint: str,
    callback: Callable[[DataFrame, int], None],
    year: int,
    max_files: int = 100,
    interval: str | None = None,
) -> StreamingQuery:
    """Watch a folder and hand each batch of new files, parsed, to callback(parsed, batch_id).
    Files are tracked in the checkpoint: each is read once, also across restarts. Without an
    interval everything present is read and the query ends."""

    def on_batch(lines: DataFrame, batch_id: int) -> None:
        # At most max_files names; formats and headers are then read per file.
        files = [r["file"] for r in lines.select("file").distinct().toLocalIterator()]
        if files:
            callback(read_logs(spark, files, year, strict=False), batch_id)

    writer = (
        file_stream(spark, log_dir, max_files)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(on_batch)
    )
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(
        availableNow=True
    )
    return writer.start()


def start_detection(
    spark: SparkSession,
    log_dir: str,
    root: str,
    checkpoint: str,
    year: int,
    models: Models = Models(),
    opts: Options = DEFAULTS,
    max_files: int = 100,
    interval: str | None = None,
) -> StreamingQuery:
    """Files in, alert and incident tables out."""
    name = stream_name(checkpoint)

    def run(parsed: DataFrame, batch_id: int) -> None:
        ingest_batch(parsed, root, f"{name}-{batch_id}", models, opts, stream=name)

    return start_ingestion(spark, log_dir, checkpoint, run, year, max_files, interval)
