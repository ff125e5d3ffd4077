"""Batches of events as folders that count only once a marker names them.

A batch writes root/events/batch=<id>/day=<day>/ and, when everything that follows from it is
stored, one marker of a single row in root/batches/batch=<id>. Readers open the folders of the
markers only, and of these the ones whose time span meets theirs: a batch that was lost half-way
is never seen and is written anew, and no read lists the whole of root/events. Old batches are
merged, so the number of markers stays small.
"""

from __future__ import annotations

import operator
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import delete_folder, path_exists
from ..schema import EVENT_COLUMNS, EVENT_FIELDS

_MARKER = (
    "ingested bigint, rejected bigint, new_alerts bigint, first_ts timestamp_ntz, "
    "last_ts timestamp_ntz, stream string, committed_at timestamp, replaces array<string>"
)
_EVENTS = ", ".join(f"`{c}` {t}" for c, t in EVENT_FIELDS.items()) + ", day string, batch string"


@dataclass(frozen=True)
class Marker:
    """What one batch held. The times are text, in UTC without a zone."""

    batch: str
    ingested: int
    rejected: int
    new_alerts: int
    first_ts: str | None
    last_ts: str | None
    stream: str
    committed_at: str


def batch_folder(root: str, table: str, batch: str) -> str:
    """Where a batch lies; its name becomes part of a path."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    return f"{root}/{table}/batch={batch}"


def write_batch(df: DataFrame, root: str, table: str, batch: str) -> None:
    """Write the rows of a batch by day, replacing what an earlier attempt left."""
    day = F.coalesce(F.to_date("ts").cast("string"), F.lit("unknown"))
    out = df.withColumn("day", day).write.mode("overwrite").partitionBy("day")
    out.parquet(batch_folder(root, table, batch))


def commit(
    spark: SparkSession,
    root: str,
    batch: str,
    ingested: int,
    rejected: int,
    new_alerts: int = 0,
    first_ts: str | None = None,
    last_ts: str | None = None,
    stream: str = "",
    replaces: tuple[str, ...] = (),
) -> None:
    """Write the marker: one row in one file, which appears whole or not at all."""
    row = spark.range(1).select(
        F.lit(ingested).cast("bigint").alias("ingested"),
        F.lit(rejected).cast("bigint").alias("rejected"),
        F.lit(new_alerts).cast("bigint").alias("new_alerts"),
        F.lit(first_ts).cast("timestamp_ntz").alias("first_ts"),
        F.lit(last_ts).cast("timestamp_ntz").alias("last_ts"),
        F.lit(stream).alias("stream"),
        F.current_timestamp().alias("committed_at"),
        F.array(*[F.lit(b) for b in replaces]).cast("array<string>").alias("replaces"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(batch_folder(root, "batches", batch))


def _all_markers(spark: SparkSession, root: str) -> DataFrame:
    if not path_exists(spark, f"{root}/batches"):
        return spark.createDataFrame([], f"{_MARKER}, batch string")
    return spark.read.schema(f"{_MARKER}, batch string").parquet(f"{root}/batches")


def markers(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch that counts. A merged batch replaces its parts from its marker on,
    whether or not they are deleted yet."""
    held = _all_markers(spark, root)
    gone = held.select(F.explode("replaces").alias("batch"))
    return held.join(gone, "batch", "left_anti").drop("replaces")


def live_batches(
    spark: SparkSession, root: str, since: str | None = None, until: str | None = None
) -> list[Marker]:
    """The markers, or those whose span meets since..until; at most one per batch that is not
    merged yet, in the order of their names."""
    held = markers(spark, root)
    if since is not None:
        held = held.filter(F.col("last_ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        held = held.filter(F.col("first_ts") <= F.lit(until).cast("timestamp_ntz"))
    texts = {c: F.col(c).cast("string") for c in ("first_ts", "last_ts", "committed_at")}
    return [Marker(**r.asDict()) for r in held.withColumns(texts).orderBy("batch").collect()]


def find(spark: SparkSession, root: str, batch: str) -> Marker | None:
    """The marker of a batch, if it has been committed and not been merged."""
    return next((m for m in live_batches(spark, root) if m.batch == batch), None)


def read_events(
    spark: SparkSession,
    root: str,
    since: str | None = None,
    until: str | None = None,
    also: str | None = None,
) -> DataFrame:
    """The committed events between since and until, both included; of the batch `also` as well,
    which has no marker yet. Folders outside the span are not opened."""
    names = {m.batch for m in live_batches(spark, root, since, until) if m.ingested}
    if also is not None:
        names.add(also)
    if not names:
        return spark.createDataFrame([], _EVENTS).select(*EVENT_COLUMNS)
    folders = [batch_folder(root, "events", b) for b in sorted(names)]
    events = spark.read.schema(_EVENTS).option("basePath", f"{root}/events").parquet(*folders)
    # The day prunes partitions, the time cuts the rest.
    for bound, keeps in ((since, operator.ge), (until, operator.le)):
        if bound is not None:
            at = F.lit(bound).cast("timestamp_ntz")
            events = events.filter(keeps(F.col("day"), F.to_date(at).cast("string")))
            events = events.filter(keeps(F.col("ts"), at))
    return events.select(*EVENT_COLUMNS)


def _drop_batch(spark: SparkSession, root: str, batch: str) -> None:
    """The marker goes first, so that no reader meets a folder that is half deleted."""
    for table in ("batches", "events"):
        delete_folder(spark, batch_folder(root, table, batch))


def merge_old(spark: SparkSession, root: str, before: str) -> int:
    """Merge the batches that end before `before` into one; returns how many there were.

    The latest batch of each stream stays: it is the one that a restart may hand over again.
    A loss at any point leaves either the parts or the merged batch, and calling this again
    deletes what is left over."""
    held = live_batches(spark, root)
    latest: dict[str, str] = {}
    for m in sorted(held, key=lambda m: (m.committed_at, m.batch)):
        latest[m.stream] = m.batch
    old = [
        m for m in held
        if m.last_ts is not None and m.last_ts < before and m.batch not in latest.values()
    ]
    _drop_replaced(spark, root)
    if len(old) < 2:
        return 0
    name = f"merged-{uuid.uuid4().hex}"
    folders = [batch_folder(root, "events", m.batch) for m in old]
    parts = spark.read.schema(_EVENTS).option("basePath", f"{root}/events").parquet(*folders)
    write_batch(parts.select(*EVENT_COLUMNS), root, "events", name)
    commit(
        spark, root, name,
        sum(m.ingested for m in old), sum(m.rejected for m in old),
        sum(m.new_alerts for m in old),
        min(m.first_ts for m in old), max(m.last_ts for m in old),
        stream=name, replaces=tuple(m.batch for m in old),
    )
    _drop_replaced(spark, root)
    return len(old)


def _drop_replaced(spark: SparkSession, root: str) -> None:
    """Delete what merged batches stand for. Their lists are as short as what one merging took."""
    replaced = _all_markers(spark, root).select(F.explode("replaces").alias("batch")).distinct()
    for row in replaced.collect():
        _drop_batch(spark, root, row["batch"])


def drop_before(spark: SparkSession, root: str, before: str) -> int:
    """Retention: delete the batches that end before `before`; returns how many. Rows of a batch
    that reaches beyond it stay until the whole batch is older."""
    old = [m for m in live_batches(spark, root) if m.last_ts is not None and m.last_ts < before]
    _drop_replaced(spark, root)
    for m in old:
        _drop_batch(spark, root, m.batch)
    return len(old)
