from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.operators import features as ft
from sentrylake.operators import sessions as se
from sentrylake.operators.iforest import forest_scores, train_forest, tree_samples
from sentrylake.operators.reconstruction import fit_reconstruction, reconstruction_errors
from sentrylake.operators.staging import shared_root, stage
from sentrylake.plans.detect import detect, detect_recent
from sentrylake.plans.train import fit, load_models
from sentrylake.schema import FEATURES, conform
from sentrylake.sources.projection import security_events
from sentrylake.streaming import ingest as ig
from sentrylake.streaming import windows as sw


def attack_log(start: datetime, n: int = 30) -> str:
    lines = []
    for i in range(n):
        t = start + timedelta(seconds=15 * i)
        lines.append(
            f"{t:%b %d %H:%M:%S} vpn0{i % 4} sshd[1]: Failed password for alice from 198.51.100.10 port 22 ssh2"
        )
    return "\n".join(lines) + "\n"


def test_stream_of_files_fills_the_tables_once(spark, tmp_path):
    logs, root, mark = tmp_path / "logs", str(tmp_path / "t"), str(tmp_path / "cp")
    logs.mkdir()
    (logs / "auth.log.1").write_text(attack_log(datetime(2024, 1, 15, 8)))
    (logs / "readme.txt").write_text("nothing\n")
    ig.start_detection(spark, str(logs), root, mark, 2024).awaitTermination()
    events = spark.read.parquet(f"{root}/events")
    alerts = spark.read.parquet(f"{root}/alerts")
    assert events.count() == 30
    assert spark.read.parquet(f"{root}/rejects").count() == 1
    found = alerts.count()
    assert found >= 1
    # A restart without new files reads nothing again.
    ig.start_detection(spark, str(logs), root, mark, 2024).awaitTermination()
    assert spark.read.parquet(f"{root}/events").count() == 30
    # A new file is picked up; the batch before it stays.
    (logs / "auth.log.2").write_text(attack_log(datetime(2024, 1, 15, 12), 5))
    ig.start_detection(spark, str(logs), root, mark, 2024).awaitTermination()
    assert spark.read.parquet(f"{root}/events").count() == 35


def test_repeating_a_batch_adds_nothing(spark, sf, tmp_path):
    parsed = security_events(spark, sf).withColumn("reject_reason", F.lit(None).cast("string"))
    parsed = stage(parsed, "batch")
    root = str(tmp_path / "t")
    first = ig.ingest_batch(parsed, root, "b1")
    again = ig.ingest_batch(parsed, root, "b1")
    assert first.ingested == again.ingested == parsed.count()
    assert first.new_alerts > 0 and again.new_alerts == 0
    assert spark.read.parquet(f"{root}/events").count() == parsed.count()


def test_files_are_ingested_once_and_leave_no_tables_behind(spark, tmp_path):
    (tmp_path / "auth.log").write_text(attack_log(datetime(2024, 1, 15, 8)))
    root, path = str(tmp_path / "t"), str(tmp_path / "auth.log")
    first = ig.ingest_path(spark, path, root, "b1", 2024)
    assert (first.ingested, first.rejected) == (30, 0) and first.new_alerts > 0
    again = ig.ingest_path(spark, path, root, "b2", 2024)
    assert again.ingested == 30
    alerts = spark.read.parquet(f"{root}/alerts")
    assert alerts.count() == alerts.select("alert_id").distinct().count()
    assert {str(r.day) for r in alerts.select("day").collect()} == {"2024-01-15"}
    left = Path(shared_root(spark).removeprefix("file:"))
    assert not list(left.glob("sentrylake-run-*"))


def test_detection_of_the_newest_hours(spark, sf):
    e = stage(security_events(spark, sf), "events")
    newest = e.agg(F.max("ts").cast("string")).first()[0]
    recent = stage(e.filter(F.col("ts") >= F.lit(newest).cast("timestamp_ntz") - F.expr(
        "interval '360' minute")), "recent")
    assert 0 < recent.count() < e.count()
    shape = lambda a: sorted((r.alert_id, round(r.final_risk, 9)) for r in a.collect())
    assert shape(detect_recent(e).alerts) == shape(detect(recent).alerts)


def test_strict_batch_is_refused(spark, tmp_path):
    bad = conform(spark.range(1).select(F.lit(None).alias("ts"))).withColumn(
        "reject_reason", F.lit("bad ts"))
    with pytest.raises(ig.RejectedBatch):
        ig.ingest_batch(bad, str(tmp_path / "t"), "b", strict=True)
    assert ig.ingest_batch(bad, str(tmp_path / "t"), "b").ingested == 0


def run_stream(spark, build, events, tmp_path, name):
    """Feed the events as files in time order, then a far later one to move the watermark."""
    src = str(tmp_path / f"{name}-src")
    late = events.limit(1).withColumn("ts", F.col("ts") + F.expr("interval '40' day"))
    events.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)

    def start():
        q = (build(stream).writeStream.outputMode("append").format("parquet")
             .option("path", str(tmp_path / f"{name}-out"))
             .option("checkpointLocation", str(tmp_path / f"{name}-cp"))
             .trigger(availableNow=True).start())
        q.awaitTermination()

    start()
    late.coalesce(1).write.mode("append").parquet(src)
    start()
    return spark.read.parquet(str(tmp_path / f"{name}-out")).collect()


def test_streamed_sessions_equal_batch(spark, sf, tmp_path):
    e = stage(security_events(spark, sf), "events")
    got = run_stream(spark, sw.sessions_stream, e, tmp_path, "s")
    batch = se.sessions(e).collect()
    shape = lambda rows: sorted(map(str, ((r.user_name, r.ip, r.start_ts, r.end_ts, r.n_events) for r in rows)))
    assert shape(got) == shape(batch)


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    e = stage(security_events(spark, sf), "events")
    got = run_stream(spark, sw.windows_stream, e, tmp_path, "w")
    cols = ["user_name", "ip", "start_ts", "end_ts", "auth_failures", "auth_successes",
            "distinct_dst_ips", "distinct_dst_ports", "deny_rate", "bytes_sum",
            "process_exec_count", "event_sequence_len"]
    batch = ft.window_features(e).select(*cols).collect()
    shape = lambda rows: sorted(str([r[c] for c in cols]) for r in rows)
    assert shape(got) == shape(batch)


def planted(spark, n=600):
    rng = np.random.default_rng(2)
    rows = [
        (f"u{i}", "ip", datetime(2024, 1, 1), *[float(x) for x in rng.normal(size=len(FEATURES))])
        for i in range(n)
    ]
    rows.append(("odd", "ip", datetime(2024, 1, 1), *[9.0 * (-1) ** i for i in range(len(FEATURES))]))
    schema = "user_name string, ip string, start_ts timestamp_ntz, " + ", ".join(
        f"{f} double" for f in FEATURES)
    return stage(spark.createDataFrame(rows, schema), "planted")


def test_forest_finds_the_planted_row_and_repeats_itself(spark):
    w = planted(spark)
    nodes = [stage(train_forest(w, trees=50, sample=64), "trees") for _ in range(2)]
    assert nodes[0].exceptAll(nodes[1]).count() == 0
    top = forest_scores(w, nodes[0]).orderBy(F.desc("forest_raw")).first()
    assert top.user_name == "odd" and 0.5 < top.forest_raw <= 1.0
    sizes = [r["count"] for r in tree_samples(w, 50, 64).groupBy("tree_id").count().collect()]
    assert len(sizes) == 50 and min(sizes) > 32 and max(sizes) == 64


def test_small_table_goes_to_every_tree(spark):
    w = planted(spark, 40)
    sizes = [r["count"] for r in tree_samples(w, 50, 64).groupBy("tree_id").count().collect()]
    assert sizes == [41] * 50


def test_reconstruction_matches_numpy(spark):
    w = planted(spark, 200)
    model = fit_reconstruction(w, 4)
    x = np.array([[r[f] for f in FEATURES] for r in w.orderBy("user_name").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    v = vectors[:, np.argsort(values)[-4:]]
    expected = ((z - z @ v @ v.T) ** 2).mean(axis=1)
    got = [r.reconstruction_raw for r in reconstruction_errors(w, model).orderBy("user_name").collect()]
    assert np.allclose(got, expected)


def test_fit_load_detect(spark, sf, tmp_path):
    e = stage(security_events(spark, sf), "events")
    fit(e, str(tmp_path / "m"), trees=20, sample=64)
    models = load_models(spark, str(tmp_path / "m"), frozen_quantiles=True)
    found = detect(e, models)
    scores = found.signals.agg(F.min("score"), F.max("score")).first()
    assert 0.25 <= scores[0] and scores[1] <= 1.0
    assert found.alerts.count() > 0


def test_detect_on_nothing(spark, sf):
    empty = security_events(spark, sf).filter(F.col("event_id") == "none")
    found = detect(empty)
    assert found.signals.count() == found.alerts.count() == found.incidents.count() == 0
