from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import fields as fl
from sentrylake.functions import timefn as tf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-10T02:37:10.5Z", datetime(2024, 3, 10, 2, 37, 10, 500000)),
        ("2024-03-10T02:37:10", datetime(2024, 3, 10, 2, 37, 10)),
        ("2024-03-10 02:37:10", datetime(2024, 3, 10, 2, 37, 10)),
        ("2024-03-10T02:37:10+02:00", datetime(2024, 3, 10, 0, 37, 10)),
        ("2024-03-10T02:37:10+0200", datetime(2024, 3, 10, 0, 37, 10)),
        ("20240310T023710Z", datetime(2024, 3, 10, 2, 37, 10)),
        ("20240310T023710", datetime(2024, 3, 10, 2, 37, 10)),
        ("2024-03-10", datetime(2024, 3, 10)),
        ("now", None),
        ("", None),
        ("not a time", None),
    ],
)
def test_parse_utc(spark, text, expected):
    assert one(spark, tf.parse_utc(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-10 02:37:10", "2024-03-10T02:37:10Z"),
        ("2024-03-10 02:37:10.5", "2024-03-10T02:37:10.500000Z"),
        ("2024-03-10 02:37:10.000001", "2024-03-10T02:37:10.000001Z"),
    ],
)
def test_iso_utc(spark, text, expected):
    assert one(spark, tf.iso_utc(F.lit(text).cast("timestamp_ntz"))) == expected


def test_floor_is_within_the_hour(spark):
    ts = F.lit("2024-03-10 02:59:59.9").cast("timestamp_ntz")
    assert one(spark, tf.floor_minutes(ts, 5)) == datetime(2024, 3, 10, 2, 55)
    # 7 does not divide the hour: the last slot starts at 56.
    assert one(spark, tf.floor_minutes(ts, 7)) == datetime(2024, 3, 10, 2, 56)


def test_seconds_and_slots_ignore_clock_changes(spark):
    a = F.lit("2024-03-10 01:00:00").cast("timestamp_ntz")
    b = F.lit("2024-03-10 03:00:00.25").cast("timestamp_ntz")
    assert one(spark, tf.seconds_between(a, b)) == 7200.25
    assert one(spark, tf.micros_of(b) - tf.micros_of(a)) == 7200250000
    assert one(spark, tf.time_slot(b, 1800) - tf.time_slot(a, 1800)) == 4


def test_stable_id(spark):
    import hashlib

    expected = hashlib.sha256(b"auth|x|-|").hexdigest()[:16]
    assert one(spark, fl.stable_id(F.lit("auth"), F.lit("x"), F.lit(None).cast("string"))) == expected


def test_users_and_addresses(spark):
    assert one(spark, fl.clean_user(F.lit(" \tBob\n"))) == "bob"
    assert one(spark, fl.clean_user(F.lit("  "))) is None
    assert one(spark, fl.clean_ip(F.lit(" 10.0.0.1 "))) == "10.0.0.1"


@pytest.mark.parametrize(
    "ip, default, strict",
    [("10.1.1.1", False, False), ("172.50.0.1", False, True), ("172.16.0.1", False, False),
     ("8.8.8.8", True, True), ("192.168.1.1", False, False)],
)
def test_external(spark, ip, default, strict):
    assert one(spark, fl.is_external(F.lit(ip))) is default
    assert one(spark, fl.is_external(F.lit(ip), True)) is strict


def test_service_accounts(spark):
    for name, expected in (("svc_db", True), ("SVC_db", False), ("MyBackup", True), ("bob", False)):
        assert one(spark, fl.is_service_account(F.lit(name))) is expected
