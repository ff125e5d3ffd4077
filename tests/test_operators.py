"""Hand-written rows at the boundaries of each operator."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.operators import correlate as co
from sentrylake.operators import evaluation as ev
from sentrylake.operators import features as ft
from sentrylake.operators import merge as mg
from sentrylake.operators import ordered as od
from sentrylake.operators import rules as ru
from sentrylake.operators import sequences as sq
from sentrylake.operators import sessions as se
from sentrylake.operators import tables as tb
from sentrylake.operators.components import connected_components
from sentrylake.operators.quantiles import exact_quantiles
from sentrylake.sources.projection import security_alerts, security_events


def fail(ts, ip="1.1.1.1", user="u", **k):
    return dict(ts=ts, source="auth", event_type="login_failure", ip=ip, user_name=user, **k)


def win(ts, ip, user="u", **k):
    return dict(ts=ts, source="auth", event_type="login_success", ip=ip, user_name=user, **k)


def test_session_gap_boundary(make_events):
    at = "2024-01-01 "
    df = make_events(
        win(at + "00:00:00", "a"), win(at + "00:30:00", "a"), win(at + "01:00:00.000001", "a")
    )
    got = sorted((r.start_ts, r.n_events) for r in se.sessions(df).collect())
    assert got == [(datetime(2024, 1, 1), 2), (datetime(2024, 1, 1, 1, 0, 0, 1), 1)]


def test_sessions_partition_events_with_null_keys(make_events):
    at = "2024-01-01 0"
    rows = [dict(ts=at + "0:00:00", source="network", event_type="netflow"),
            dict(ts=at + "0:10:00", source="network", event_type="netflow", ip="a"),
            dict(ts=at + "2:00:00", source="network", event_type="netflow")]
    df = make_events(*rows)
    assert se.sessions(df).count() == 3
    assert se.session_events(df).select("event_id").distinct().count() == 3


def test_window_edge_and_rare_commands(make_events):
    run = lambda ts, c: dict(ts=ts, source="process", event_type="process_exec", ip="a",
                             user_name="u", command=c)
    at = "2024-01-01 00:0"
    df = make_events(*[run(at + f"{i}:00", "ls") for i in range(4)], run(at + "5:00", "nc"))
    got = {r.start_ts.minute: r for r in ft.window_features(df).collect()}
    assert got[0].rare_command_count == 0 and got[0].max_rare_command_score == 0
    assert got[5].rare_command_count == 1 and got[5].max_rare_command_score == 1.0
    assert sum(r.event_sequence_len for r in got.values()) == 5


def test_brute_force_is_cumulative_and_sliding_is_not(make_events):
    spread = [fail(f"2024-01-01 {h:02d}:00:00") for h in range(5)]
    df = make_events(*spread)
    (alert,) = ru.brute_force(df).collect()
    assert alert.n_events == 5 and alert.confidence == 0.5
    assert ru.brute_force(df, sliding=True).count() == 0
    tight = [fail(f"2024-01-02 00:0{m}:00", ip="2.2.2.2") for m in range(0, 6)]
    (alert,) = ru.brute_force(make_events(*tight, *spread), sliding=True).collect()
    assert (alert.ip, alert.n_events) == ("2.2.2.2", 6)


def test_brute_force_against_a_plain_loop(make_events):
    rng = random.Random(3)
    rows, t0 = [], datetime(2024, 1, 1)
    for ip in "abcdef":
        for _ in range(rng.randint(2, 30)):
            rows.append(fail(str(t0 + timedelta(seconds=rng.randint(0, 6000))), ip=ip))
    df = make_events(*rows)
    for sliding in (False, True):
        expected = {}
        for ip in "abcdef":
            ts = sorted(datetime.fromisoformat(r["ts"]) for r in rows if r["ip"] == ip)
            for t in ts:
                end = t + timedelta(minutes=5)
                inside = [x for x in ts if x <= end and (not sliding or x >= t)]
                if len(inside) >= 5:
                    expected[ip] = (len(inside), inside[0], inside[-1])
                    break
        got = {r.ip: (r.n_events, r.start_ts, r.end_ts)
               for r in ru.brute_force(df, sliding=sliding).collect()}
        assert got == expected


def test_impossible_travel_boundary(make_events):
    df = make_events(
        win("2024-01-01 00:00:00", "a"), win("2024-01-01 00:06:39", "b"),
        win("2024-01-01 00:13:19", "c"), win("2024-01-01 00:13:19", "d"),
    )
    got = [(r.ip_from, r.ip_to) for r in ru.impossible_travel(df).collect()]
    # 399 s fires, 400 s does not, equal times do not.
    assert got == [("a", "b")]


def test_lateral_movement_counts_hosts_per_minute(make_events):
    rows = [win(f"2024-01-01 00:00:{i}0", "a", host=f"h{i}") for i in range(3)]
    (alert,) = ru.lateral_movement(make_events(*rows)).collect()
    assert alert.n_hosts == 3 and alert.confidence == 0.5
    late = [*rows[:2], win("2024-01-01 00:01:00", "a", host="h9")]
    assert ru.lateral_movement(make_events(*late)).count() == 0


def test_previous_row_equals_lag(spark):
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), t0 + timedelta(seconds=rng.randint(0, 4000)), f"e{i:03d}")
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id string")
    got, fine = (
        {r.id: r.prev_id
         for r in od.previous_row(df, ["k"], "ts", ["ts", "id"], ["id"], width).collect()}
        for width in (600, 1)
    )
    assert got == fine
    expected = {}
    for k in "ab":
        before = None
        for _, t, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            expected[i], before = before, i
    assert got == expected


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    values = list(range(1000))
    df = spark.createDataFrame([(float(v), v % 7) for v in values], "x double, n int")
    got = {r.x: r.run_n for r in od.running_totals(df, "x", ["n"], descending, 16).collect()}
    total, expected = 0, {}
    for v in sorted(values, reverse=descending):
        total += v % 7
        expected[float(v)] = total
    assert got == expected


@pytest.mark.parametrize("half", [1, 7, 300, 5_000, 60_000])
def test_exact_quantiles(spark, half):
    import sentrylake.operators.quantiles as qt

    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(half), rng.exponential(size=half)])
    df = spark.range(len(x)).select("id").join(
        spark.createDataFrame(
            __import__("pandas").DataFrame({"id": np.arange(len(x)), "x": x, "y": -x})
        ), "id",
    )
    qs = (0.05, 0.25, 0.5, 0.6, 0.9, 0.99)
    rows = {r["name"]: r for r in exact_quantiles(df, ["x", "y"], qs).collect()}
    for name, data in (("x", x), ("y", -x)):
        for q in qs:
            assert rows[name][qt.quantile_name(q)] == pytest.approx(np.quantile(data, q), abs=1e-12)


@pytest.mark.parametrize("leaf", [0, 3, 4096])
def test_quantiles_in_several_rounds(spark, leaf, monkeypatch):
    """Heavy ties, 26 orders of magnitude and a lattice, down to slots that are never listed."""
    import pandas as pd

    import sentrylake.operators.quantiles as qt

    monkeypatch.setattr(qt, "LEAF", leaf)
    rng = np.random.default_rng(11)
    n = 20_000
    data = pd.DataFrame({
        "wide": np.exp(rng.normal(size=n) * 30),
        "three": rng.integers(0, 3, n) * 1.0,
        "mostly_zero": np.where(rng.random(n) < 0.9, 0.0, rng.normal(size=n)),
    })
    qs = (0.0, 0.05, 0.5, 0.9, 0.99, 1.0)
    rows = {r["name"]: r for r in exact_quantiles(spark.createDataFrame(data), list(data), qs).collect()}
    for name in data:
        for q in qs:
            want = np.quantile(data[name].to_numpy(), q)
            assert rows[name][qt.quantile_name(q)] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_quantile_that_a_cut_misses(spark, monkeypatch):
    """Cuts on the wrong side of their rank cost a round and change nothing."""
    import sentrylake.operators.quantiles as qt

    learn, wrong = qt._Search.learn, []

    def misled(self, slots):
        if not wrong:
            wrong.append(1)
            slots = {s: type(r)(**{**r.asDict(), "marks": [1.0] * (qt.MARKS + 1)}) for s, r in slots.items()}
        learn(self, slots)

    monkeypatch.setattr(qt._Search, "learn", misled)
    row = exact_quantiles(spark.range(30_001).selectExpr("double(id) as x"), ["x"], (0.5,)).first()
    assert wrong and row.p50 == 15_000.0


def test_quantiles_of_special_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(nan, -inf, None), (1.0, inf, None), (2.0, inf, None), (None, 0.0, None)],
        "some_nan double, endless double, nothing double",
    )
    rows = {r["name"]: r for r in exact_quantiles(df, df.columns, (0.0, 0.5, 1.0)).collect()}
    assert rows.keys() == {"some_nan", "endless"}
    assert (rows["some_nan"].n, rows["some_nan"].p0, rows["some_nan"].p50) == (3, 1.0, 2.0)
    assert np.isnan(rows["some_nan"].p100)
    assert (rows["endless"].p0, rows["endless"].p100) == (-inf, inf)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, ["x"], (0.1, 0.9)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    n = 60
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(n)]
    star = [("s000", f"s{i:03d}") for i in range(1, n)]
    names = sorted({x for e in chain + star for x in e} | {"alone"})
    v = spark.createDataFrame([(x,) for x in names], "id string")
    e = spark.createDataFrame(chain + star, "u string, v string")
    got = {r.id: r.component for r in connected_components(v, e, "id").collect()}
    assert {got[x] for x in names if x[0] == "c"} == {"c000"}
    assert {got[x] for x in names if x[0] == "s"} == {"s000"}
    assert got["alone"] == "alone"


def test_merge_edges_keep_the_components_of_all_pairs(spark):
    rng = random.Random(11)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(150):
        start = t0 + timedelta(seconds=rng.randint(0, 40_000))
        end = start + timedelta(seconds=rng.choice([0, 60, 1199, 1200, 5000]))
        rows.append((f"i{i:03d}", start, end, rng.choice(["a", "b", None]), rng.choice(["u", "v", "w", None])))
    df = spark.createDataFrame(
        rows, "incident_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, "
        "primary_ip string, primary_user string")
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            same = (a[3] and a[3] == b[3]) or (a[4] and a[4] == b[4])
            if same and abs((b[1] - a[2]).total_seconds()) < 1200:
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    edges = mg.merge_edges(df)
    assert edges.count() <= 12 * len(rows)
    got = connected_components(df.select("incident_id"), edges, "incident_id").collect()
    assert {r.incident_id: r.component for r in got} == {r[0]: root(r[0]) for r in rows}
    assert len({root(r[0]) for r in rows}) > 1


def signal_rows(spark, rows):
    """(id, start, end, user, ip) -> minimal signals."""
    return spark.createDataFrame(
        [(i, datetime.fromisoformat(s), datetime.fromisoformat(e), u, ip) for i, s, e, u, ip in rows],
        "signal_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, user_name string, ip string")


def test_clusters(spark):
    d = "2024-01-01 "
    df = signal_rows(spark, [
        ("long", d + "00:00:00", d + "02:00:00", "u", None),
        ("inside", d + "00:10:00", d + "00:15:00", "u", "x"),
        ("edge", d + "02:20:00", d + "02:21:00", "u", None),
        ("after", d + "02:41:00.000001", d + "02:50:00", "u", None),
        ("next", d + "02:45:00", d + "02:46:00", "u", None),
        ("single", d + "00:00:00", d + "00:01:00", None, "9"),
        ("nobody", d + "00:00:00", d + "00:01:00", None, None),
        ("blank", d + "00:00:30", d + "00:01:00", "", "9"),
    ])
    got = {}
    for r in co.signal_clusters(df).collect():
        got.setdefault(r.cluster_id, set()).add(r.signal_id)
    assert sorted(map(sorted, got.values())) == [
        ["after", "next"], ["blank", "single"], ["edge", "inside", "long"]]
    latest = {r.signal_id for r in co.signal_clusters(df, latest_only=True).collect()}
    assert latest == {"after", "next", "blank", "single"}


def test_risk_of_two_and_of_equal_scores(spark):
    def run(xs):
        df = spark.createDataFrame([(f"a{i}", x) for i, x in enumerate(xs)], "id string, raw_risk double")
        rows = co.quantile_severity(co.normalized_risk(df)).collect()
        return {r.id: (r.final_risk, r.severity) for r in rows}

    curve = lambda x: 0.4 + 0.55 / (1 + np.exp(-4 * (x - 0.5)))
    two = run([0.9, 0.1])
    assert two["a0"][0] == pytest.approx(min(0.95, curve(0.9)))
    assert two["a0"][1] == "high" and two["a1"][1] == "medium"
    same = run([0.5, 0.5, 0.5])
    assert same["a0"][0] == pytest.approx(curve(0.5 / (0.5 + 1e-6)))
    assert {v[1] for v in same.values()} == {"high"}


def test_vocabulary_and_tail(make_events):
    rows = [win(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "a") for i in range(70)]
    rows.append(fail("2024-01-01 00:02:00", ip="a"))
    df = make_events(*rows)
    vocab = sq.token_vocab(df)
    assert [(r.token, r.n, r.token_id) for r in vocab.collect()] == [("auth:login_success", 70, 2)]
    (seq,) = sq.token_sequences(df, vocab).collect()
    assert seq.length == 64 and seq.token_ids[-1] == 1 and set(seq.token_ids[:-1]) == {2}


def test_one_class_labels(spark):
    alerts = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "alert_id string, final_risk double")
    none = spark.createDataFrame([("a", False)], "alert_id string, is_attack boolean")
    assert ev.auc_score(alerts, none).first().auc == 0.0
    assert ev.roc_curve(alerts, none).count() == 0
    m = ev.detection_metrics(alerts, none).first()
    assert (m.precision, m.recall, m.f1, m.support) == (0.0, 0.0, 0.0, 0)


def test_roc_chunks_do_not_matter(spark, sf):
    alerts = security_alerts(spark, sf)
    labels = alerts.select("alert_id", "is_attack")
    runs = [
        sorted((r.threshold, r.fpr, r.tpr)
               for r in ev.roc_curve(alerts, labels, chunks=c).collect())
        for c in (2, 64)
    ]
    assert runs[0] == runs[1] and runs[0][-1][0] == float("inf")


def test_incident_updates(spark):
    i = spark.createDataFrame(
        [("i1", "open", "", ""), ("i2", "open", "", "")],
        "incident_id string, status string, analyst_notes string, resolution_reason string")
    u = spark.createDataFrame(
        [("i1", "resolved", None, "done"), ("i2", "closed", "x", None), ("i9", "open", None, None)],
        i.schema)
    out, bad = tb.incident_updates(i, u)
    got = {r.incident_id: tuple(r)[1:] for r in out.collect()}
    assert got == {"i1": ("resolved", "", "done"), "i2": ("open", "", "")}
    assert {(r.incident_id, r.reject_reason) for r in bad.collect()} == {
        ("i2", "unknown status"), ("i9", "unknown incident")}


def test_insert_absent_twice(spark, sf, tmp_path):
    a = security_alerts(spark, sf)
    n = a.count()
    assert tb.insert_absent(a, str(tmp_path / "t"), "alert_id") == n
    assert tb.insert_absent(a, str(tmp_path / "t"), "alert_id") == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == n


def test_window_lengths_add_up(spark, sf):
    e = security_events(spark, sf)
    total = ft.window_features(e).agg(F.sum("event_sequence_len")).first()[0]
    assert total == e.count()


def test_hot_key_reaches_the_window_as_slots(spark):
    """One user holding every row: what is ordered per key is one row per slot."""
    df = spark.range(200_000).select(
        F.lit("u").alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") / 5000).cast("decimal(18,6)"))
         ).alias("ts"),
    )
    slots = od.gap_groups(df, ["k"], "ts", "ts", 30)
    assert slots.count() == 1 and slots.first().slot_rows == 200_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limits_apply_before_the_shuffle(spark, sf):
    e = security_events(spark, sf)
    for df in (ft.rare_commands(e), ru.brute_force(e), sq.session_tail(e, sq.token_vocab(e))):
        assert "Partial" in plan_of(df) and "WindowGroupLimit" in plan_of(df)


def test_no_plan_pairs_rows_without_a_key(spark, sf):
    e, a = security_events(spark, sf), security_alerts(spark, sf)
    from sentrylake.operators import reports as rp

    for df in (ft.window_features(e), se.session_events(e), ru.all_rules(e), rp.related_alerts(a),
               ev.detection_metrics(a, a)):
        assert "CartesianProduct" not in plan_of(df)
        assert "NestedLoop" not in plan_of(df)


def test_previous_row_over_slots_and_days(spark):
    """Rows of one second, one slot, one day and many days, and a key that pauses for a month."""
    import datetime as dt

    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 2, 27)
    rows = []
    for key, spread in (("a", 40), ("b", 86_400), ("c", 30 * 86_400), (None, 5 * 86_400)):
        for s in sorted(set(rng.integers(0, spread, 60).tolist())):
            rows.append((key, start + dt.timedelta(seconds=s), len(rows)))
    rows.append(("b", start + dt.timedelta(days=40), len(rows)))
    rows.append(("b", start + dt.timedelta(days=40, microseconds=1), len(rows)))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v int")
    got = {r.v: r.prev_v for r in od.previous_row(df, ["k"], "ts", ["ts", "v"], ["v"], 10).collect()}
    want, last = {}, {}
    for key, _, v in sorted(rows, key=lambda r: r[1]):
        want[v] = last.get(key)
        last[key] = v
    assert got == want


def test_weighted_join_cuts_heavy_keys_only(spark, monkeypatch):
    """Half of the rows under one key go to half of the pieces; other keys keep one row."""
    from collections import Counter

    from sentrylake.operators import skew

    monkeypatch.setattr(skew, "PIECES", 16)
    rows = spark.range(8_000).selectExpr(
        "id", "case when id % 2 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 1000) end as k"
    )
    small = rows.filter("k is not null and k != 'k1'").groupBy("k").agg(F.count("*").alias("n"))
    small = small.withColumn("name", F.upper("k"))
    heavy = {r.k: r["__salts"] for r in skew.heavy_keys(small, ["k"], "n").collect()}
    assert heavy.keys() == {"hot"} and heavy["hot"] in range(8, 11)
    for how in ("inner", "left"):
        joined = skew.weighted_join(rows, small, ["k"], "n", ["id"], how)
        plain = rows.join(small.drop("n"), "k", how)
        assert set(joined.columns) == set(plain.columns)
        assert Counter(joined.select("id", "k", "name").collect()) == Counter(
            plain.select("id", "k", "name").collect()
        )
    assert skew.weighted_join(rows, small.limit(0), ["k"], "n", ["id"], "left").count() == 8_000


def test_intermediate_tables_never_go_to_one_machine_of_a_cluster(spark, monkeypatch):
    from sentrylake.operators import staging

    assert staging.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert staging.warehouse_root(spark).endswith("/warehouse/_runs")
    monkeypatch.setattr(staging, "_one_machine", lambda _: False)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.warehouse_root(spark)
