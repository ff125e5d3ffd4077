"""Detection quality against a table of labels (alert_id, is_attack)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import running_totals

# Detection types the heuristic labels count as attacks.
ATTACK_TYPES = (
    "brute_force_login",
    "credential_stuffing",
    "lateral_movement_attempt",
    "exfil_spike",
    "bruteforce",
    "impossible_travel",
    "lateral_movement",
)


def labelled(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """alert_id, final_risk, is_attack; alerts without a label count as benign."""
    truth = labels.select("alert_id", "is_attack")
    return (
        alerts.select("alert_id", F.coalesce("final_risk", F.lit(0.0)).alias("final_risk"))
        .join(truth, "alert_id", "left")
        .withColumn("is_attack", F.coalesce("is_attack", F.lit(False)))
    )


def detection_metrics(alerts: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: precision, recall, f1, support. Empty ratios are 0."""
    hit, real = F.col("final_risk") >= threshold, F.col("is_attack")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1))).cast("double")

    counts = labelled(alerts, labels).agg(
        n(hit & real).alias("tp"), n(hit & ~real).alias("fp"), n(~hit & real).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(0.0))

    return counts.select(
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).cast("bigint").alias("support"),
    )


def _per_score(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    attack = F.when(F.col("is_attack"), 1).otherwise(0)
    return (
        labelled(alerts, labels)
        .groupBy("final_risk")
        .agg(F.sum(attack).alias("tp"), F.sum(1 - attack).alias("fp"))
    )


def _totals(per: DataFrame) -> DataFrame:
    return per.agg(F.sum("tp").alias("positives"), F.sum("fp").alias("negatives"))


def roc_curve(
    alerts: DataFrame, labels: DataFrame, drop_intermediate: bool = True, chunks: int = 128
) -> DataFrame:
    """fpr, tpr, threshold, starting at (0, 0, infinity); empty with only one class.

    drop_intermediate leaves out points on the straight line between their neighbours. The
    cumulative counts come in chunks of the score range, so no task orders all scores."""
    per = _per_score(alerts, labels)
    run = running_totals(per, "final_risk", ["tp", "fp"], True, chunks, keep_chunk=True)
    if drop_intermediate:
        # The step after a point: the next lower score, inside the chunk or the first one of
        # the next chunk that has any.
        step = F.struct("tp", "fp")
        heads = run.groupBy("chunk").agg(F.max_by(step, "final_risk").alias("head"))
        following = heads.select(
            "chunk", F.lead("head").over(Window.orderBy(F.desc("chunk"))).alias("next_head")
        )
        inside = F.lead(step).over(Window.partitionBy("chunk").orderBy(F.desc("final_risk")))
        run = (
            run.withColumn("next_step", inside)
            .join(F.broadcast(following), "chunk")  # chunks + 1 rows at most
            .withColumn("next_step", F.coalesce("next_step", "next_head"))
            .filter(F.col("next_step").isNull() | (F.col("next_step") != step))
        )
    points = run.select(F.col("final_risk").alias("threshold"), "run_tp", "run_fp")
    origin = _totals(per).select(
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("bigint").alias("run_tp"),
        F.lit(0).cast("bigint").alias("run_fp"),
    )
    return (
        points.unionByName(origin)
        .crossJoin(F.broadcast(_totals(per)))
        .filter((F.col("positives") > 0) & (F.col("negatives") > 0))
        .select(
            (F.col("run_fp") / F.col("negatives")).alias("fpr"),
            (F.col("run_tp") / F.col("positives")).alias("tpr"),
            "threshold",
        )
    )


def auc_score(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: auc by trapezoids over distinct scores; 0 with only one class."""
    run = running_totals(_per_score(alerts, labels), "final_risk", ["tp"], descending=True)
    doubled = F.sum(F.col("fp") * (2 * F.col("run_tp") - F.col("tp"))).cast("double")
    sums = run.agg(
        doubled.alias("area"),
        F.sum("tp").cast("double").alias("p"),
        F.sum("fp").cast("double").alias("n"),
    )
    both = 2 * F.col("p") * F.col("n")
    return sums.select(
        F.when(both > 0, F.col("area") / F.nullif(both, F.lit(0.0)))
        .otherwise(F.lit(0.0))
        .alias("auc")
    )


def synthetic_labels(alerts: DataFrame) -> DataFrame:
    """Heuristic truth: high risk, a known attack type, or high severity."""
    return alerts.select(
        "alert_id",
        F.coalesce(
            (F.col("final_risk") > 0.7)
            | F.col("detection_type").isin(*ATTACK_TYPES)
            | (F.col("severity") == "high"),
            F.lit(False),
        ).alias("is_attack"),
    )
