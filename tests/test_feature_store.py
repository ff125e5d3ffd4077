"""Window features kept as sums: equal to the batch features after every batch."""

import random

from pyspark.sql import functions as F

from sentrylake.operators.features import window_features
from sentrylake.streaming.feature_store import add_batch, feature_windows, partial_sums


def busy(make_events, seed):
    r = random.Random(seed)
    rows = []
    for i in range(250):
        kind = r.choice(["auth", "network", "process"])
        second = r.randint(0, 7199)
        rows.append({
            "event_id": f"e{seed}-{i}", "source": kind,
            "event_type": r.choice(["login_failure", "login_success"]) if kind == "auth" else kind,
            "user_name": r.choice(["ann", "bob", "", None]), "ip": r.choice(["10.0.0.1", None]),
            "dst_ip": r.choice(["1.1.1.1", "2.2.2.2", "", None]), "dst_port": r.choice([0, 22, 80, None]),
            "bytes": r.choice([None, 5, 100]), "action": r.choice(["deny", "allow", None]),
            "command": r.choice(["ls", f"once{r.randint(0, 60)}", "", None]),
            "ts": f"2024-03-10 {r.choice([1, 2, 9])}:{second // 120:02d}:{second % 60:02d}",
        })
    return make_events(*rows)


def lines(df):
    rounded = [F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]
    return sorted(map(str, df.select(*rounded).collect()))


def test_features_after_every_batch(spark, make_events, tmp_path):
    root, so_far = f"file://{tmp_path}/sums", None
    assert feature_windows(spark, root) is None
    for number in range(3):
        batch = busy(make_events, number)
        so_far = batch if so_far is None else so_far.unionByName(batch)
        add_batch(batch, root, number)
        assert lines(feature_windows(spark, root)) == lines(window_features(so_far))
    # run again, as after a failure before the commit
    add_batch(busy(make_events, 1), root, 1)
    assert lines(feature_windows(spark, root)) == lines(window_features(so_far))
    # a batch that has not been written to the end does not count
    for name, table in partial_sums(busy(make_events, 7)).items():
        table.write.parquet(f"{root}/{name}/batch=7")
    assert lines(feature_windows(spark, root)) == lines(window_features(so_far))
    # an empty batch changes nothing
    add_batch(batch.limit(0), root, 8)
    assert lines(feature_windows(spark, root)) == lines(window_features(so_far))


def test_a_batch_reads_only_itself(spark, make_events, tmp_path):
    root = f"file://{tmp_path}/sums"
    add_batch(busy(make_events, 0), root, 0)
    batch = busy(make_events, 1)
    for table in partial_sums(batch).values():
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "sums" not in plan and "Relation" not in plan
        assert table.count() <= 4 * batch.count()
