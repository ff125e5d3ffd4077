"""State carried from batch to batch: stream rules and incident merging against one whole run."""

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import merge as mg
from sentrylake.operators import rules as ru
from sentrylake.operators.merge_state import merge_batch, merged_members
from sentrylake.plans import catalog_stream
from sentrylake.plans.catalog_stream import arrivals
from sentrylake.streaming.rules import STREAMS, keyed_state

BATCH_RULES = {
    "brute_force": ru.brute_force,
    "impossible_travel": ru.impossible_travel,
    "lateral_movement": ru.lateral_movement,
}


def busy_events(make_events):
    """Failures in bursts and slowly, logins from changing addresses, contacts; times that repeat,
    in no order."""
    r = random.Random(8)
    rows = []
    for i in range(700):
        second = r.choice([r.randint(0, 86_399), 40_000 + r.randint(0, 400), 28_800, 57_600])
        kind = r.choice(["login_failure", "login_failure", "login_success", "flow"])
        rows.append({
            "event_id": f"e{i:04d}", "source": "network" if kind == "flow" else "auth",
            "event_type": kind, "user_name": r.choice(["ann", "bob", None, ""]),
            "ip": f"10.0.0.{r.randint(1, 12)}" if r.random() < 0.95 else None,
            "host": f"h{r.randint(1, 5)}",
            "ts": f"2024-03-10 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}",
        })
    return make_events(*r.sample(rows, len(rows)))


@pytest.mark.parametrize("rule", list(STREAMS))
def test_stream_rules_equal_the_batch(spark, make_events, tmp_path, rule):
    events = busy_events(make_events)
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("src", "out", "check"))

    def run():
        stream = spark.readStream.schema(events.schema).parquet(src)
        with keyed_state(spark):
            q = (STREAMS[rule](stream).writeStream.outputMode("append").format("parquet")
                 .option("path", out).option("checkpointLocation", check)
                 .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(want.schema).parquet(out)

    want = BATCH_RULES[rule](events).select(*ru.RULE_COLUMNS)
    sizes = []
    for batch in arrivals(events, 3):
        batch.write.mode("append").parquet(src)
        sizes.append(run().count())
    assert sizes[0] < sizes[-1]
    expected = sorted(map(str, want.collect()))
    assert len(expected) > 3
    assert sorted(map(str, run().collect())) == expected
    # a restart adds nothing
    assert sorted(map(str, run().collect())) == expected


def incidents(spark, seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.randint(0, 5 * 86_400)
        rows.append((f"i{seed}-{i:03d}", start, start + r.randint(0, 900),
                     r.choice([None, "", *[f"10.0.0.{x}" for x in range(9)]]),
                     r.choice([None, *[f"u{x}" for x in range(9)]])))
    df = spark.createDataFrame(
        rows, "incident_id string, s bigint, e bigint, primary_ip string, primary_user string"
    )
    at = lambda c: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {c})")
    return df.withColumn("start_ts", at("s")).withColumn("end_ts", at("e"))


def test_merging_by_batches_equals_one_run(spark, tmp_path):
    root = f"file://{tmp_path}/merging"
    batches = [incidents(spark, seed, 150) for seed in (1, 2, 3)]
    batches.append(incidents(spark, 4, 0))
    so_far = None
    for number, batch in enumerate(batches):
        so_far = batch if so_far is None else so_far.unionByName(batch)
        merge_batch(batch, root, number)
        full = so_far.selectExpr(
            "*", "1 as total_alerts", "'low' as max_severity", "map('x', 1L) as categories",
            "'open' as status", "'' as analyst_notes", "'' as resolution_reason", "'' as summary",
        )
        want = mg.merge_incidents(full).members.select("incident_id", "merged_id").collect()
        got = merged_members(spark, root).collect()
        assert sorted(got) == sorted(want)
    assert len({m.merged_id for m in got}) < len(got) == 450
    # taking a batch in again, under its own number or a new one, changes nothing
    for number in (2, 9):
        merge_batch(batches[2], root, number)
        again = merged_members(spark, root)
        assert sorted(again.collect()) == sorted(got)


def test_merging_looks_at_near_incidents_only(spark, tmp_path):
    root = f"file://{tmp_path}/merging"
    old = incidents(spark, 1, 300)
    assert merge_batch(old, root, 0) == 0
    late = incidents(spark, 2, 20).filter("s > 4 * 86400")
    low, high = late.agg(F.min("start_ts").cast("string"), F.max("end_ts").cast("string")).first()
    window = F.expr("interval 20 minutes")
    near = old.filter(
        (F.col("end_ts") >= F.lit(low).cast("timestamp_ntz") - window)
        & (F.col("start_ts") <= F.lit(high).cast("timestamp_ntz") + window)
    ).count()
    assert 0 < merge_batch(late, root, 1) == near < 120


def test_streams_run_together_with_state_by_cores(spark, make_events, monkeypatch):
    events = busy_events(make_events)
    monkeypatch.setattr(catalog_stream, "security_events", lambda *_: events)
    cores, name = spark.sparkContext.defaultParallelism, "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(name), []

    def build(source):
        seen.append(int(spark.conf.get(name)))
        return source.select("event_id")

    spark.conf.set(name, "200")
    try:
        found = catalog_stream.streamed_together(spark, "", [build, build])
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
    assert seen == [cores] * 4
    assert found[0].count() == found[1].count() > events.count()


def same_times(spark, n, addresses=1):
    """Incidents of few addresses that all start and end within ten minutes."""
    at = "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id % 600)"
    return spark.range(n).selectExpr(
        "'i' || lpad(id, 6, '0') as incident_id", f"{at} as start_ts", f"{at} as end_ts",
        f"'a' || id % {addresses} as primary_ip", "cast(null as string) as primary_user",
        "1 as total_alerts", "'low' as max_severity", "map('x', 1L) as categories",
        "'open' as status", "'' as analyst_notes", "'' as resolution_reason", "'' as summary",
    )


def test_merging_links_groups_not_incidents(spark, monkeypatch):
    sizes = []
    solve = mg.connected_components

    def counted(vertices, edges, vertex):
        sizes.append(edges.count())
        return solve(vertices, edges, vertex)

    monkeypatch.setattr(mg, "connected_components", counted)
    members = mg.merge_incidents(same_times(spark, 3000, 3)).members
    assert members.count() == 3000
    assert members.select("merged_id").distinct().count() == 3
    assert sizes[0] <= 20


def test_batches_link_groups_not_incidents(spark, tmp_path, monkeypatch):
    from sentrylake.operators import merge_state

    sizes, solve = [], merge_state.component_links

    def counted(edges):
        sizes.append(edges.count())
        return solve(edges)

    monkeypatch.setattr(merge_state, "component_links", counted)
    root, every = f"file://{tmp_path}/merging", same_times(spark, 3000, 3)
    for number in range(2):
        merge_batch(every.filter(F.pmod(F.xxhash64("incident_id"), F.lit(2)) == number), root, number)
    members = merged_members(spark, root)
    assert members.count() == 3000
    assert members.select("merged_id").distinct().count() == 3
    assert max(sizes) <= 20


def test_an_id_with_several_rows_links_their_groups(spark):
    rows = same_times(spark, 4, 4)
    later = rows.filter("incident_id = 'i000000'").withColumn("primary_ip", F.lit("a1"))
    members = mg.merge_incidents(rows.unionByName(later)).members
    got = {r.incident_id: (r.merged_id, r["count"]) for r in
           members.groupBy("incident_id", "merged_id").count().collect()}
    assert got == {"i000000": ("i000000", 4), "i000001": ("i000000", 1),
                   "i000002": ("i000002", 1), "i000003": ("i000003", 1)}


def test_the_json_of_an_event_is_parsed_once(spark, sf):
    from sentrylake.sources.projection import security_events

    plan = security_events(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1
