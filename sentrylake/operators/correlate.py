"""Correlation of signals into incidents and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import present, stable_id
from ..functions.scores import (
    clip01,
    logistic_risk,
    severity,
    severity_between,
    severity_rank,
)
from ..functions.fields import title_case
from ..functions.timefn import iso_utc, utc_now
from ..options import DEFAULTS, Options
from ..schema import FEATURES, MITRE, MITRE_ALIASES
from .classify import classified, mitre_for, sorted_keys, title
from .features import EVIDENCE_FLAGS
from .ordered import gap_groups, with_group_start
from .quantiles import exact_quantiles
from .scoring import with_top_features
from .staging import stage

# Order of signals that start together.
KIND_ORDER = ("window_anomaly", "sequence_anomaly")


def entity_key() -> Column:
    return F.when(
        present(F.col("user_name")), F.concat(F.lit("user:"), F.col("user_name"))
    ).when(present(F.col("ip")), F.concat(F.lit("ip:"), F.col("ip")))


def signal_clusters(
    signals: DataFrame, opts: Options = DEFAULTS, latest_only: bool = False
) -> DataFrame:
    """Signals with entity, cluster_start and cluster_id; signals of clusters below the
    minimum size and signals without user and address are left out."""
    gap = opts.correlation_window_minutes
    keyed = signals.withColumn("entity", entity_key()).filter(F.col("entity").isNotNull())
    slots = gap_groups(keyed.select("entity", "start_ts", "end_ts"), ["entity"], "start_ts",
                       "end_ts", gap)
    # Slots per entity are bounded by the calendar, whatever the number of signals.
    size = F.sum("slot_rows").over(Window.partitionBy("entity", "group_start"))
    kept = slots.withColumn("cluster_size", size).filter(
        F.col("cluster_size") >= opts.incident_min_signals
    )
    if latest_only:
        newest = F.max("group_start").over(Window.partitionBy("entity"))
        kept = slots.withColumn("newest", newest).withColumn("cluster_size", size).filter(
            (F.col("group_start") == F.col("newest"))
            & (F.col("cluster_size") >= opts.incident_min_signals)
        )
    tagged = with_group_start(keyed, kept, ["entity"], "start_ts", gap)
    return tagged.withColumnRenamed("group_start", "cluster_start").withColumn(
        "cluster_id", stable_id(F.col("entity"), iso_utc(F.col("cluster_start")))
    )


def _first_order() -> Column:
    kind = F.col("kind")
    rank = F.when(kind == KIND_ORDER[0], 0).when(kind == KIND_ORDER[1], 1).otherwise(2)
    return F.struct(F.col("start_ts"), rank.alias("k"), F.col("signal_id"))


def cluster_summary(
    clustered: DataFrame,
    hosts: DataFrame,
    ips: DataFrame,
    opts: Options = DEFAULTS,
) -> DataFrame:
    """One row per cluster: interval, primary entity, averaged scores, raw risk, first feature
    vector, evidence flags, technique keys and the detection type."""
    order = _first_order()
    positive = {s: F.avg(F.when(F.col(s) > 0, F.col(s))) for s in ("window_score", "sequence_score")}
    known_keys = [d[0] for d in MITRE] + [a for a, _ in MITRE_ALIASES]
    has_vector = F.col(FEATURES[0]).isNotNull()
    base = clustered.groupBy("cluster_id", "entity", "cluster_start").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        positive["window_score"].alias("avg_window"),
        positive["sequence_score"].alias("avg_sequence"),
        F.max(clip01(F.col("score"))).alias("top_score"),
        F.avg(clip01(F.col("score"))).alias("mean_score"),
        F.min_by(F.struct("user_name", "ip"), order).alias("primary"),
        F.min_by(F.struct(*FEATURES), F.when(has_vector, order)).alias("vector"),
        # Kinds and keys come from short fixed lists, so the sets stay small.
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        *[F.max(F.array_contains("mitre_keys", k)).alias(f"key_{k}") for k in known_keys],
        *[
            (F.sum(f) if f == "login_events" else F.max(f)).alias(f)
            for f in EVIDENCE_FLAGS
        ],
    )
    member = clustered.select("signal_id", "cluster_id")

    def distinct_count(of: DataFrame, column: str, name: str) -> DataFrame:
        return (
            member.join(of, "signal_id")
            .groupBy("cluster_id")
            .agg(F.count_distinct(column).alias(name))
        )

    joined = base.join(distinct_count(hosts, "host", "n_hosts"), "cluster_id", "left").join(
        distinct_count(ips, "ip", "n_ips"), "cluster_id", "left"
    )
    any_positive = F.col("avg_window").isNotNull() | F.col("avg_sequence").isNotNull()
    avg_w, avg_s = (F.coalesce(c, F.lit(0.0)) for c in ("avg_window", "avg_sequence"))
    keys = F.filter(
        F.array(*[F.when(F.col(f"key_{k}"), F.lit(k)) for k in known_keys]),
        lambda k: k.isNotNull(),
    )
    shaped = joined.select(
        "cluster_id",
        "entity",
        F.concat(F.lit("inc_"), F.substring("cluster_id", 1, 12)).alias("incident_id"),
        F.concat(F.lit("al_"), F.substring("cluster_id", 1, 12)).alias("alert_id"),
        "n_signals",
        "start_ts",
        "end_ts",
        F.nullif("primary.user_name", F.lit("")).alias("primary_user"),
        F.nullif("primary.ip", F.lit("")).alias("primary_ip"),
        avg_w.alias("window_score"),
        avg_s.alias("sequence_score"),
        F.when(any_positive, F.lit(0.6) * avg_w + F.lit(0.4) * avg_s)
        .otherwise(F.lit(0.5) * F.col("top_score") + F.lit(0.5) * F.col("mean_score"))
        .alias("raw_risk"),
        "kinds",
        keys.alias("signal_keys"),
        *EVIDENCE_FLAGS,
        F.coalesce("n_hosts", F.lit(0)).alias("n_hosts"),
        F.coalesce("n_ips", F.lit(0)).alias("n_ips"),
        *[F.col(f"vector.{f}").alias(f) for f in FEATURES],
    )
    typed = classified(shaped)
    return typed.withColumn(
        "mitre_keys", sorted_keys(F.col("signal_keys"), F.col("class_keys"))
    )


def normalized_risk(summary: DataFrame, stored: bool = False) -> DataFrame:
    """Add final_risk: with three or more rows min-max between the 5 % and 95 % quantiles and
    a logistic curve; with fewer the curve alone, capped."""
    q = exact_quantiles(
        summary, ["raw_risk"], (0.05, 0.95), extra=("max(x) as largest",), stored=stored
    ).select("n", "largest", "p5", "p95")
    x = F.col("raw_risk")
    span = F.col("p95") - F.col("p5")
    scaled = (
        F.when(span > 0, clip01((x - F.col("p5")) / F.nullif(span, F.lit(0.0))))
        .when(F.col("largest") > 0, x / (F.col("largest") + F.lit(1e-6)))
        .otherwise(x)
    )
    return (
        summary.crossJoin(F.broadcast(q))
        .withColumn(
            "final_risk",
            F.when(F.col("n") >= 3, logistic_risk(scaled)).otherwise(
                F.least(F.lit(0.95), logistic_risk(x))
            ),
        )
        .drop("n", "largest", "p5", "p95")
    )


def quantile_severity(df: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Add severity: high from the 90 % quantile of final_risk, medium from the 60 % one; fixed
    limits below three rows."""
    q = exact_quantiles(df, ["final_risk"], (0.6, 0.9)).select("n", "p60", "p90")
    few = F.col("n") < 3
    return (
        df.crossJoin(F.broadcast(q))
        .withColumn(
            "severity",
            severity_between(
                F.col("final_risk"),
                F.when(few, F.lit(opts.severity_medium)).otherwise(F.col("p60")),
                F.when(few, F.lit(opts.severity_high)).otherwise(F.col("p90")),
            ),
        )
        .drop("n", "p60", "p90")
    )


def incident_top_features(
    clustered: DataFrame, stats: DataFrame | None = None, keep: int = 5
) -> DataFrame:
    """The strongest features per cluster: cluster_id, rank, feature, value, z_score, percentile.

    Three features per signal come from inside the row, then one row per (cluster, feature)
    remains, 13 at most."""
    rows = clustered.filter(F.col(FEATURES[0]).isNotNull()).withColumn(
        "signal_order", _first_order()
    )
    listed = with_top_features(
        rows.select("cluster_id", "signal_order", *FEATURES), stats, 3
    ).select("cluster_id", "signal_order", F.posexplode("top").alias("i", "t"))
    z = F.round(-F.col("t.order_z"), 2)
    best = listed.select(
        "cluster_id",
        F.col("t.feature").alias("feature"),
        F.struct((-z).alias("neg"), F.col("signal_order").alias("s"), F.col("i")).alias("o"),
        F.struct(
            F.col("t.value").alias("value"),
            z.alias("z_score"),
            F.col("t.percentile").alias("percentile"),
        ).alias("t"),
    ).groupBy("cluster_id", "feature").agg(F.min("o").alias("o"), F.min_by("t", "o").alias("t"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("o"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= keep).select(
        "cluster_id", "rank", "feature", "t.*"
    )


def _explanation() -> Column:
    lines = F.array_join(
        F.transform(
            F.slice("mitre", 1, 3),
            lambda m: F.concat(
                F.lit("- "), m["technique_id"], F.lit(" "), m["technique"], F.lit(" ("),
                m["tactic"], F.lit(")"),
            ),
        ),
        "\n",
    )
    return F.format_string(
        "Correlated %d anomalous signals into a %s incident (score=%.2f).\n"
        "Top contributing signals:\n- %s\nMapped to MITRE ATT&CK:\n%s",
        F.col("n_signals"),
        F.upper("severity"),
        F.col("final_risk"),
        F.array_join(F.slice("kinds", 1, 3), ", "),
        lines,
    )


def build_alerts(
    rated: DataFrame, features: DataFrame, created_ts: Column | None = None
) -> DataFrame:
    """Alert rows from rated cluster summaries and their top features."""
    nested = features.groupBy("cluster_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "feature", "value", "z_score", "percentile"))
        ).alias("top_features")
    )
    with_mitre = rated.withColumn("mitre", mitre_for(F.col("mitre_keys")))
    first = F.get("mitre", F.lit(0))
    return with_mitre.join(nested, "cluster_id", "left").select(
        "alert_id",
        (utc_now() if created_ts is None else created_ts).alias("created_ts"),
        "start_ts",
        "end_ts",
        F.col("primary_user").alias("user_name"),
        F.col("primary_ip").alias("ip"),
        "severity",
        F.col("raw_risk").alias("score"),
        "window_score",
        "sequence_score",
        "final_risk",
        "detection_type",
        "category",
        "mitre",
        first["technique_id"].alias("mitre_technique_id"),
        first["tactic"].alias("mitre_tactic"),
        title(
            F.col("detection_type"), F.col("severity"), F.col("primary_user"), F.col("primary_ip")
        ).alias("title"),
        _explanation().alias("explanation"),
        "top_features",
        "incident_id",
    )


def cluster_categories(clustered: DataFrame) -> DataFrame:
    """cluster_id, category, n."""
    return clustered.groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("n"))


def cluster_entities(clustered: DataFrame) -> DataFrame:
    """Distinct addresses and users per cluster: cluster_id, entity_type, entity. Kept as rows,
    since a busy cluster may touch any number of them."""
    pairs = F.array(
        F.struct(F.lit("ip").alias("entity_type"), F.col("ip").alias("entity")),
        F.struct(F.lit("user").alias("entity_type"), F.col("user_name").alias("entity")),
    )
    return (
        clustered.select("cluster_id", F.explode(pairs).alias("p"))
        .select("cluster_id", "p.*")
        .filter(present(F.col("entity")))
        .distinct()
    )


def build_incidents(rated: DataFrame, categories: DataFrame) -> DataFrame:
    """Incident rows; max_severity is the severity of the incident's alert. Categories come
    from a fixed list, so the map stays small."""
    nested = categories.groupBy("cluster_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias(
            "categories"
        )
    )
    affected = F.coalesce("primary_ip", "primary_user", F.lit("unknown entity"))
    return rated.join(nested, "cluster_id").select(
        "incident_id",
        "start_ts",
        "end_ts",
        "primary_ip",
        "primary_user",
        F.col("n_signals").alias("total_alerts"),
        F.col("severity").alias("max_severity"),
        "categories",
        F.concat(
            title_case(F.col("detection_type")), F.lit(" incident affecting "), affected
        ).alias("summary"),
        F.lit("open").alias("status"),
        F.lit("").alias("analyst_notes"),
        F.lit("").alias("resolution_reason"),
    )


def incident_severity(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """Incidents with max_severity taken from their alerts."""
    rank = alerts.groupBy("incident_id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    from ..functions.scores import severity_of_rank

    return (
        incidents.join(rank, "incident_id", "left")
        .withColumn(
            "max_severity",
            F.when(F.col("rank").isNull(), F.col("max_severity")).otherwise(
                severity_of_rank(F.col("rank"))
            ),
        )
        .drop("rank")
    )


@dataclass(frozen=True)
class Correlation:
    clustered: DataFrame
    rated: DataFrame
    alerts: DataFrame
    incidents: DataFrame
    entities: DataFrame


def correlate(
    signals: DataFrame,
    hosts: DataFrame,
    ips: DataFrame,
    stats: DataFrame | None = None,
    opts: Options = DEFAULTS,
    created_ts: Column | None = None,
    latest_only: bool = False,
) -> Correlation:
    """Signals -> clusters -> rated summaries -> alerts and incidents, before merging."""
    clustered = stage(signal_clusters(signals, opts, latest_only), "clustered")
    summary = stage(cluster_summary(clustered, hosts, ips, opts), "summary")
    # Both only add columns: the quantiles behind them are known when they return.
    rated = quantile_severity(normalized_risk(summary, stored=True), opts)
    alerts = build_alerts(rated, incident_top_features(clustered, stats), created_ts)
    incidents = build_incidents(rated, cluster_categories(clustered))
    entities = cluster_entities(clustered).join(
        rated.select("cluster_id", "incident_id"), "cluster_id"
    ).select("incident_id", "entity_type", "entity")
    return Correlation(clustered, rated, alerts, incidents, entities)
