"""Event, alert and incident tables kept as parquet: insert-if-absent, updates, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.fields import present
from ..schema import INCIDENT_STATUSES, SOURCES
from .staging import path_exists, stage_observed


def validate_events(raw: DataFrame) -> DataFrame:
    """Add reject_reason: null for a row that may be ingested."""
    return raw.withColumn(
        "reject_reason",
        F.when(F.col("source").isNull() | ~F.col("source").isin(*SOURCES), "unsupported source")
        .when(~F.coalesce(present(F.col("ts").cast("string")), F.lit(False)), "missing ts"),
    )


def absent_rows(
    new: DataFrame, existing: DataFrame | None, key: str, order: tuple[str, ...] = ("start_ts",)
) -> DataFrame:
    """Rows of `new` whose key the table does not hold, each key once: the first by `order`."""
    first = Window.partitionBy(key).orderBy(*order)
    once = new.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")
    return once if existing is None else once.join(existing.select(key), key, "left_anti")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first write."""
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        # the first write has made the folder and not yet its files
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def insert_absent(new: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table lacks; returns how many. The table is partitioned by
    the day of start_ts, and only the days that the new rows touch are read: ids are derived from
    the content, start_ts included, so repeating a batch adds nothing."""
    dated = new.withColumn("day", F.coalesce(F.to_date("start_ts").cast("string"), F.lit("none")))
    staged, days = stage_observed(
        dated, "new-rows", F.min("day").alias("first"), F.max("day").alias("last")
    )
    if days["first"] is None:
        return 0
    held = read_table(new.sparkSession, path)
    if held is not None:
        held = held.filter(F.col("day").cast("string").between(days["first"], days["last"]))
    counted = Observation()
    (
        absent_rows(staged, held, key)
        .observe(counted, F.count(F.lit(1)).alias("n"))
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )
    return counted.get["n"]


def upsert_alerts(alerts: DataFrame, incidents: DataFrame, root: str) -> int:
    """Incidents first, then alerts; returns the number of new alerts."""
    insert_absent(incidents, f"{root}/incidents", "incident_id")
    return insert_absent(alerts, f"{root}/alerts", "alert_id")


def incident_updates(
    incidents: DataFrame, updates: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply partial updates (incident_id, status, analyst_notes, resolution_reason; null means
    unchanged). Returns the new table and the rejected updates: unknown status or incident.

    A blank status leaves it unchanged; blank notes and reasons are written. Several updates of
    one incident apply per column, the latest by `order` winning."""
    status = F.col("status")
    known = incidents.select("incident_id")
    valid = updates.filter(~F.coalesce(present(status), F.lit(False)) | status.isin(*INCIDENT_STATUSES))
    bad_status = updates.filter(present(status) & ~status.isin(*INCIDENT_STATUSES)).withColumn(
        "reject_reason", F.lit("unknown status")
    )
    bad_id = valid.join(known, "incident_id", "left_anti").withColumn(
        "reject_reason", F.lit("unknown incident")
    )
    seq = F.lit(0) if order is None else F.col(order)
    fields = {
        "status": F.nullif("status", F.lit("")),
        "analyst_notes": F.col("analyst_notes"),
        "resolution_reason": F.col("resolution_reason"),
    }
    changes = valid.groupBy("incident_id").agg(
        *[F.max_by(v, F.when(v.isNotNull(), seq)).alias(f"new_{c}") for c, v in fields.items()]
    )
    out = incidents.join(changes, "incident_id", "left").select(
        *[
            F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c)
            for c in incidents.columns
        ]
    )
    return out, bad_status.unionByName(bad_id)


def retain_latest(events: DataFrame, n: int = 250_000, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest n events; the bound is the feature."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)
