"""Merging of incidents batch by batch.

A stored incident keeps for ever the component that it was given when it came in; components that
grow together later are one row each in a small table of relabellings. A batch therefore costs the
incidents near it in time, the components that its edges touch and the relabellings, not a new run
over all incidents: the batch and the stored incidents within the window of it are put into groups
(merge.with_group), edges are made among the groups and from a group to the components known so far
that it touches, and only that contracted graph is solved.

Folders below a root: incidents/batch=n (written once) and relabel/batch=n (all relabellings up to
batch n). Batches are numbered; running one again replaces what it wrote, and a batch sees only smaller
numbers, so a restart after a failure between the two writes repeats the batch with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import minutes
from ..options import DEFAULTS, Options
from .components import component_links
from .merge import GROUP, group_edges, group_measures, with_group
from .skew import spread_join, weighted_join
from .staging import stage
from .tables import read_table

_COLUMNS = "incident_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, primary_ip string, primary_user string"
_RELABEL = "component string, now string"


def _stored(spark: SparkSession, root: str, before: int | None) -> DataFrame:
    table = read_table(spark, f"{root}/incidents")
    if table is None:
        return spark.createDataFrame([], f"{_COLUMNS}, component string")
    kept = table if before is None else table.filter(F.col("batch") < before)
    return kept.drop("batch")


def _relabelled(spark: SparkSession, root: str, before: int | None) -> DataFrame:
    """The relabellings of the last batch (below `before`)."""
    table = read_table(spark, f"{root}/relabel")
    if table is None:
        return spark.createDataFrame([], _RELABEL)
    kept = table if before is None else table.filter(F.col("batch") < before)
    # A batch carries on all earlier relabellings, so one without any has none before it either.
    last = kept.agg(F.max("batch")).first()[0]
    return kept.filter(F.col("batch") == F.lit(last)).drop("batch")


def merge_batch(batch: DataFrame, root: str, number: int, opts: Options = DEFAULTS) -> int:
    """Take in the incidents of one batch (incident_id, start_ts, end_ts, primary_ip,
    primary_user); ids that are stored already are left out. Gives the number of stored incidents
    that were looked at."""
    spark = batch.sparkSession
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    stored, relabel = _stored(spark, root, number), _relabelled(spark, root, number)
    new = stage(
        batch.select(*names).filter(F.col("incident_id").isNotNull())
        .dropDuplicates(["incident_id"])
        .join(stored.select("incident_id"), "incident_id", "left_anti"),
        "new-incidents",
    )
    # As text: a datetime literal would pass through the session time zone.
    low, high = new.agg(F.min("start_ts").cast("string"), F.max("end_ts").cast("string")).first()
    window = minutes(opts.correlation_window_minutes)
    near = stage(
        stored.filter(
            (F.col("end_ts") >= F.lit(low).cast("timestamp_ntz") - window)
            & (F.col("start_ts") <= F.lit(high).cast("timestamp_ntz") + window)
        ),
        "near-incidents",
    )
    now = F.coalesce("now", "component").alias("component")
    known = with_group(near.join(relabel, "component", "left").select(*names, now), opts)
    added = with_group(new, opts)
    # Grouped before they are linked: a group counts once, and so does a component that it touches.
    groups = stage(
        known.unionByName(added.withColumn("component", F.col("incident_id")))
        .groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("n"), *group_measures(F.col("component"))),
        "groups",
    )
    touched = stage(known.select(*GROUP, "component").distinct(), "touched")
    to_stored = touched.join(groups.select(*GROUP, "rep"), GROUP).select(
        F.col("rep").alias("u"), F.col("component").alias("v")
    )
    links = stage(
        component_links(group_edges(groups, opts).unionByName(to_stored)).select(
            F.col("u").alias("component"), F.col("v").alias("now")
        ),
        "links",
    )
    # A relabelling that led to a component which is now part of another one is carried on.
    carried = relabel.join(
        links.select(F.col("component").alias("now"), F.col("now").alias("newer")), "now", "left"
    ).select("component", F.coalesce("newer", "now").alias("now"))
    # The other ends of links are ids of this batch, which nothing is stored under yet.
    older = links.join(touched.select("component").distinct(), "component", "left_semi")
    carried.unionByName(older).write.mode("overwrite").parquet(f"{root}/relabel/batch={number}")
    of_group = stage(
        groups.select(*GROUP, "n", "rep")
        .join(links.withColumnRenamed("component", "rep"), "rep", "left")
        .select(*GROUP, "n", F.coalesce("now", "rep").alias("component")),
        "group-components",
    )
    labelled = weighted_join(added, of_group, GROUP, "n", ["incident_id"]).select(
        *names, "component"
    )
    labelled.write.mode("overwrite").parquet(f"{root}/incidents/batch={number}")
    return near.count()


def merged_members(spark: SparkSession, root: str) -> DataFrame:
    """incident_id -> merged_id of everything taken in, as merge_incidents names it: after the
    earliest member of the component."""
    now = F.coalesce("now", "component").alias("component")
    members = _stored(spark, root, None).join(
        _relabelled(spark, root, None), "component", "left"
    ).select("incident_id", "start_ts", now)
    heads = members.groupBy("component").agg(
        F.min_by("incident_id", F.struct("start_ts", "incident_id")).alias("merged_id")
    )
    return spread_join(members, heads, ["component"], ["incident_id"]).select(
        "incident_id", "merged_id"
    )
