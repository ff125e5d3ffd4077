"""Merging of incidents that share an address or user and follow each other closely."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import present
from ..functions.scores import severity_of_rank, severity_rank
from ..functions.timefn import micros_of
from ..options import DEFAULTS, Options
from .components import connected_components
from .skew import weighted_join
from .staging import stage, stage_observed



# What the incidents of a group have in common; no part of it is null.
GROUP = ["group_ip", "group_user", "group_slot", "group_one"]


def _slot(micros: Column, opts: Options) -> Column:
    return F.floor(micros / F.lit(opts.correlation_window_minutes * 60_000_000))


def with_group(incidents: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Add GROUP, s and e (microseconds). Times are cut into slots as long as the window. All
    incidents of an address that start and end in one slot are linked with each other, and so are
    those of a user: such incidents with the same address, user and slot are one group. Any other
    incident is a group of its own."""
    s, e = micros_of(F.col("start_ts")), micros_of(F.col("end_ts"))
    ip, user = (
        F.when(present(F.col(c)), F.col(c)).otherwise("") for c in ("primary_ip", "primary_user")
    )
    named = (ip != "") | (user != "")
    short = F.coalesce(named & (_slot(s, opts) == _slot(e, opts)), F.lit(False))
    return incidents.withColumns({
        "s": s, "e": e, "group_ip": ip, "group_user": user,
        "group_slot": F.when(short, _slot(s, opts)).otherwise(F.lit(-1)),
        "group_one": F.when(short, F.lit("")).otherwise(F.concat(F.lit("="), "incident_id")),
    })


def group_measures(label: Column) -> list[Column]:
    """What group_edges needs to know of the incidents of a group; rep is the least label."""
    at = F.struct(F.col("s").alias("m"), F.col("incident_id").alias("tie"))
    return [
        F.min(label).alias("rep"), F.min(at).alias("low"), F.max(at).alias("high"),
        F.max("e").alias("e"),
    ]


def group_edges(groups: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Edges (u, v) between the reps of groups (group_ip, group_user, rep, low, high, e) with the
    same connected components as "same address or user, and the later one starts less than the
    window away from the end of the earlier one" has between their incidents.

    The pairs themselves may be quadratic in a busy address, so they are never listed. For an
    earlier incident A ending in slot s + d and a later B starting in slot s (d = -1, 0, 1; other
    slots are too far apart) the condition reduces to one comparison, bound(A) < place(B): linking
    every group to the group with the lowest bound and to the one with the highest place keeps the
    components with at most two edges per group, entity and d.
    """
    width = F.lit(opts.correlation_window_minutes * 60_000_000)
    named = groups.select(
        "rep", "low", "high", "e",
        F.explode(
            F.array(
                F.when(present(F.col("group_ip")), F.concat(F.lit("ip:"), "group_ip")),
                F.when(present(F.col("group_user")), F.concat(F.lit("user:"), "group_user")),
            )
        ).alias("entity"),
    ).filter(F.col("entity").isNotNull())
    cells = named.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))

    def place(micros: Column, after: int, tie: Column) -> Column:
        return F.struct(micros.alias("m"), F.lit(after).alias("after"), tie.alias("tie"))

    e, d, none = F.col("e"), F.col("d"), F.lit("")
    low, high = (place(F.col(f"{c}.m"), 0, F.col(f"{c}.tie")) for c in ("low", "high"))
    # In a group of several, every start is later than every end less the window.
    bound = F.when(d == -1, place(-(e + width), 0, none)).when(d == 0, low).otherwise(
        F.greatest(low, place(e - width, 1, none))
    )
    spot = F.when(d == -1, place(-F.col("low.m"), 0, none)).otherwise(high)
    earlier = cells.select(
        "entity", "d", (_slot(e, opts) - d).alias("slot"), F.col("rep").alias("a"),
        bound.alias("bound"),
    )
    later = cells.select(
        "entity", "d", _slot(F.col("low.m"), opts).alias("slot"), F.col("rep").alias("b"),
        spot.alias("spot"),
    )
    cell = ["entity", "d", "slot"]
    lowest = earlier.groupBy(*cell).agg(F.min(F.struct("bound", "a")).alias("low"))
    highest = later.groupBy(*cell).agg(F.max(F.struct("spot", "b")).alias("high"))
    to_high = (
        earlier.join(highest, cell)
        .filter(F.col("bound") < F.col("high.spot"))
        .select(F.col("a").alias("u"), F.col("high.b").alias("v"))
    )
    to_low = (
        later.join(lowest, cell)
        .filter(F.col("low.bound") < F.col("spot"))
        .select(F.col("low.a").alias("u"), F.col("b").alias("v"))
    )
    return to_high.unionByName(to_low).filter(F.col("u") != F.col("v")).distinct()


def merge_edges(incidents: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """group_edges with every incident as a group of its own: edges (u, v) of incident ids."""
    at = F.struct(F.col("s").alias("m"), F.col("incident_id").alias("tie"))
    alone = with_group(incidents, opts).select(
        "group_ip", "group_user", F.col("incident_id").alias("rep"), at.alias("low"),
        at.alias("high"), "e",
    )
    return group_edges(alone, opts)


@dataclass(frozen=True)
class Merged:
    incidents: DataFrame
    # incident_id -> merged_id, for every incident
    members: DataFrame


def merge_incidents(incidents: DataFrame, opts: Options = DEFAULTS) -> Merged:
    """One incident per component, named after its earliest member: latest end, summed alerts
    and categories, highest severity. Each member and its own summary stay in `members`."""
    fixed = stage(incidents.filter(F.col("incident_id").isNotNull()), "incidents")
    rows = with_group(fixed, opts)
    groups = stage(
        rows.groupBy(*GROUP).agg(
            F.count(F.lit(1)).alias("n"), *group_measures(F.col("incident_id"))
        ),
        "groups",
    )
    edges = group_edges(groups, opts)
    ids = rows.groupBy("incident_id").agg(F.count(F.lit(1)).alias("copies"))
    repeated, seen = stage_observed(
        ids.filter(F.col("copies") > 1), "repeated", F.count(F.lit(1)).alias("n")
    )
    if seen["n"]:
        # An id in several groups links them, and each of its rows comes out once per such row.
        several = rows.join(repeated, "incident_id").join(groups.select(*GROUP, "rep"), GROUP)
        edges = edges.unionByName(
            several.select(F.col("incident_id").alias("u"), F.col("rep").alias("v")).distinct()
        )
        rows = rows.join(repeated, "incident_id", "left").withColumn(
            "copies", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int")))
        )
    parts = connected_components(groups.select("rep").distinct(), edges, "rep")
    of_group = stage(
        groups.select(*GROUP, "n", "rep", "low").join(parts, "rep").drop("rep"), "group-components"
    )
    # The earliest of a component is the earliest of one of its groups.
    named = of_group.groupBy("component").agg(F.min("low").alias("first")).select(
        "component", F.col("first.tie").alias("merged_id")
    )
    heads = stage(of_group.drop("low").join(named, "component"), "group-heads")
    grouped = weighted_join(rows, heads, GROUP, "n", ["incident_id"]).select(
        *fixed.columns, "component", "merged_id"
    )
    order = F.struct("start_ts", "incident_id")
    kept = ["incident_id", "primary_ip", "primary_user", "status", "analyst_notes",
            "resolution_reason", "summary"]
    head = grouped.groupBy("component").agg(
        F.min_by(F.struct(*kept), order).alias("head"),
        F.count(F.lit(1)).alias("n_members"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.sum("total_alerts").alias("total_alerts"),
        F.max(severity_rank(F.col("max_severity"))).alias("rank"),
    )
    # Categories come from a fixed list, so the map stays small.
    categories = (
        grouped.select("component", F.explode("categories").alias("category", "n"))
        .groupBy("component", "category")
        .agg(F.sum("n").alias("n"))
        .groupBy("component")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias(
                "categories"
            )
        )
    )
    # One fixed text whatever the size; the text of every member is in `members`.
    text = F.when(F.col("n_members") == 1, F.col("head.summary")).otherwise(
        F.format_string("Merged %d incidents, first: %s", "n_members", "head.summary")
    )
    merged = (
        head.join(categories, "component", "left")
        .select(
            "head.incident_id",
            "start_ts",
            "end_ts",
            "head.primary_ip",
            "head.primary_user",
            "total_alerts",
            severity_of_rank(F.col("rank")).alias("max_severity"),
            "categories",
            text.alias("summary"),
            "head.status",
            "head.analyst_notes",
            "head.resolution_reason",
        )
    )
    members = grouped.select("incident_id", "merged_id", "start_ts", "end_ts", "summary")
    return Merged(merged, members)


def remap_incident(df: DataFrame, members: DataFrame) -> DataFrame:
    """Replace incident_id by the id of the incident it was merged into."""
    return (
        df.join(members.select("incident_id", "merged_id"), "incident_id", "left")
        .withColumn("incident_id", F.coalesce("merged_id", "incident_id"))
        .drop("merged_id")
    )
