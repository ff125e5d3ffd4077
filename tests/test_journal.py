"""Batches count only with their marker; merging and retention keep the events right."""

import pytest
from pyspark.sql import functions as F

from sentrylake.sources import ndjson as nd
from sentrylake.streaming import ingest as ig
from sentrylake.streaming import journal


@pytest.fixture
def hours(make_events):
    """Events of three hours, with a rejected one."""

    def build(*wanted):
        rows = [
            {"event_id": f"h{h}e{i}", "ts": f"2024-01-0{1 + h // 24} {h % 24:02d}:{i:02d}:00", "source": "auth",
             "event_type": "login_success", "user_name": "u", "ip": "10.0.0.1"}
            for h in wanted for i in range(3)
        ]
        return make_events(*rows).withColumn(
            "reject_reason", F.when(F.col("event_id") == "h1e2", "planted"))

    return build


def ids(spark, root, *span):
    return sorted(r.event_id for r in journal.read_events(spark, root, *span).collect())


def test_a_batch_lost_before_its_marker_is_not_seen(spark, hours, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert ids(spark, root) == []
    assert ig.store_batch(hours(0), root, "s-0", stream="s").ingested == 3

    def lost(*args, **kwargs):
        raise ConnectionError("lost")

    with monkeypatch.context() as m:
        m.setattr(journal, "commit", lost)
        with pytest.raises(ConnectionError):
            ig.store_batch(hours(1), root, "s-1", stream="s")
    assert (tmp_path / "t/events/batch=s-1").exists()
    assert ids(spark, root) == ["h0e0", "h0e1", "h0e2"]
    for _ in range(2):  # the second time it is known
        done = ig.store_batch(hours(1), root, "s-1", stream="s")
        assert (done.ingested, done.rejected) == (2, 1)
    assert ids(spark, root) == ["h0e0", "h0e1", "h0e2", "h1e0", "h1e1"]
    assert spark.read.parquet(f"{root}/rejects").count() == 1


def test_reads_open_only_the_batches_of_their_span(spark, hours, tmp_path):
    root = str(tmp_path / "t")
    for h in (0, 5, 30):
        ig.store_batch(hours(h), root, f"s-{h}")
    some = journal.read_events(spark, root, "2024-01-01 05:01:00", "2024-01-01 09:00:00")
    assert sorted(r.event_id for r in some.collect()) == ["h5e1", "h5e2"]
    assert {f.split("batch=")[1].split("/")[0] for f in some.inputFiles()} == {"s-5"}


def test_merging_survives_a_loss_at_any_point(spark, hours, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    for h in (0, 1, 2, 30):
        ig.store_batch(hours(h), root, f"s-{h}", stream="s")
    everything = ids(spark, root)
    with monkeypatch.context() as m:  # lost before the parts are deleted
        m.setattr(journal, "_drop_replaced", lambda *a: None)
        assert journal.merge_old(spark, root, "2024-01-03") == 3
    assert (tmp_path / "t/events/batch=s-0").exists()
    assert ids(spark, root) == everything
    # The latest batch is never merged, the rest has been; what was left over goes.
    assert journal.merge_old(spark, root, "2024-01-03") == 0
    assert not (tmp_path / "t/events/batch=s-0").exists()
    assert ids(spark, root) == everything
    held = journal.live_batches(spark, root)
    assert sorted(m.ingested for m in held) == [3, 8] and sum(m.rejected for m in held) == 1
    # A restart hands over the last batch again: nothing is added.
    assert ig.store_batch(hours(30), root, "s-30", stream="s").ingested == 3
    assert ids(spark, root) == everything
    assert journal.drop_before(spark, root, "2024-01-02") == 1
    assert ids(spark, root) == ["h30e0", "h30e1", "h30e2"]


def test_a_batch_name_cannot_leave_its_folder():
    with pytest.raises(ValueError):
        journal.batch_folder("/r", "events", "../x")


def test_streams_with_different_checkpoints_do_not_share_batches():
    assert ig.stream_name("/a") != ig.stream_name("/b")
    assert ig.stream_name("/a") == ig.stream_name("/a")


def test_ordered_load_is_in_the_order_of_time(spark, tmp_path):
    raw = spark.createDataFrame(
        [(f"2024-01-01T00:{i * 7 % 60:02d}:00Z", "login_success", f"u{i}") for i in range(60)],
        "ts string, event string, user string")
    assert nd.write_ndjson(raw.repartition(4), f"{tmp_path}/raw", "auth.ndjson") == 60
    rows = nd.load_events(spark, f"{tmp_path}/raw", ordered=True).collect()
    assert len(rows) == 60
    assert [(r.ts, r.event_id) for r in rows] == sorted((r.ts, r.event_id) for r in rows)
