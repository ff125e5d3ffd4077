from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sentrylake.sources import foreign as fo
from sentrylake.sources import ndjson as nd
from sentrylake.sources import normalize as nm

AUTH = '{"ts":"2024-01-15T08:00:00Z","event":"login_failure","user":" Alice ","ip":"1.2.3.4","host":"vpn01","app":"vpn","extra":{"a":1}}'
FLOW = '{"ts":"2024-01-15T08:00:01","event":"netflow","src_ip":"10.0.1.7","dst_ip":"8.8.8.8","dst_port":443,"proto":"tcp","bytes":55000,"action":"allow"}'


@pytest.fixture
def raw_dir(tmp_path):
    (tmp_path / "auth.ndjson").write_text(AUTH + "\n\n" + AUTH.replace("Alice", "Bob") + "\n")
    (tmp_path / "network.ndjson").write_text(FLOW + "\n")
    return str(tmp_path)


def test_load_events_skips_missing_files(spark, raw_dir):
    rows = nd.load_events(spark, raw_dir, ordered=True).collect()
    assert [(r.source, r.user_name, r.ip) for r in rows] == [
        ("auth", "alice", "1.2.3.4"), ("auth", "bob", "1.2.3.4"), ("network", None, "10.0.1.7")] or [
        r.source for r in rows] == ["auth", "auth", "network"]
    assert rows[-1].dst_port == 443 and rows[-1].bytes == 55000 and rows[-1].host is None


def test_malformed_line_fails_or_is_kept(spark, tmp_path):
    p = tmp_path / "x.ndjson"
    p.write_text(AUTH + "\n{broken\n")
    schema = nm.raw_schema("auth")
    with pytest.raises(Exception):
        nd.read_ndjson(spark, str(p), schema).collect()
    rows = nd.read_ndjson(spark, str(p), schema, strict=False).collect()
    assert sorted(r._corrupt_record is None for r in rows) == [False, True]


def test_ndjson_round_trip(spark, tmp_path):
    df = spark.range(5).select("id", F.concat(F.lit("x"), "id").alias("s"))
    assert nd.write_ndjson(df, str(tmp_path / "o")) == 5
    back = nd.read_ndjson(spark, str(tmp_path / "o"), "id bigint, s string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_unsupported_source(spark):
    with pytest.raises(ValueError):
        nm.normalize("dns", spark.range(1))


ZEEK = (
    "#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.resp_h\tid.resp_p\tproto\tduration\torig_bytes\tresp_bytes\n"
    "1705305600.5\tC1\t10.0.0.1\t8.8.8.8\t53\tUDP\t0.1\t10\t20\n"
    "1705305601\tC2\t10.0.0.1\t8.8.4.4\t53\ttcp\t-\t-\t-\n#close\n"
)


def lines(spark, text, name="conn.log"):
    return spark.createDataFrame([(x, name) for x in text.splitlines()], "value string, file string")


def test_zeek_tsv(spark):
    (row,) = fo.good(fo.parse_zeek_tsv(lines(spark, ZEEK))).collect()
    assert row.ts == datetime(2024, 1, 15, 8, 0, 0, 500000)
    assert (row.event_id, row.bytes, row.dst_port, row.proto) == (
        "zeek_1705305600.5_10.0.0.1_8.8.8.8", 30, 53, "udp")
    both = fo.good(fo.parse_zeek_tsv(lines(spark, ZEEK), unset="null")).collect()
    assert sorted(r.event_id for r in both)[1] == "zeek_1705305601.0_10.0.0.1_8.8.4.4"


def test_zeek_json(spark):
    text = '{"ts":1705305600.25,"id.orig_h":"10.0.0.1","id.resp_h":"8.8.8.8","id.resp_p":53,"proto":"UDP","_path":"dns","query":"x"}\n# c\n\n{bad'
    parsed = fo.parse_zeek_json(lines(spark, text)).collect()
    (row,) = [r for r in parsed if r.reject_reason is None]
    assert (row.event_type, row.dst_port, row.proto, row.extra["query"]) == ("dns", 53, "udp", "x")
    assert "ts" not in row.extra and len(parsed) == 2


def test_windows_csv(spark, tmp_path):
    p = tmp_path / "windows.csv"
    p.write_text(
        "TimeGenerated,EventID,Computer,AccountName,TargetUserName,IpAddress,LogonType\n"
        "2024-01-15T08:00:00,4624,PC1,Alice,,1.2.3.4,3\n"
        "2024-01-15T08:00:01,4625,PC1,,Bob,,3\n"
        "2024-01-15T08:00:02,4672,PC1,,,,\n"
        "yesterday,4624,PC1,x,,,\n")
    rows = fo.good(fo.read_logs(spark, str(p), 2024)).orderBy("ts").collect()
    assert [(r.event_type, r.user_name, r.ip) for r in rows] == [
        ("login_success", "alice", "1.2.3.4"), ("login_failure", "bob", None), ("event_4672", None, None)]
    assert rows[0].extra["LogonType"] == "3"


def test_ssh(spark):
    text = (
        "Jan 15 08:00:00 srv sshd[1]: Failed password for invalid user bob from 1.2.3.4 port 22 ssh2\n"
        "Jan 15 08:00:01 srv sshd[1]: Failed password for alice from 1.2.3.4 port 22\n"
        "Feb 29 08:00:02 srv sshd[1]: Accepted publickey for Carol from 5.6.7.8 port 22\n"
        "Jan 15 08:00:03 srv sshd[1]: Invalid user eve from 9.9.9.9\n"
        "Jan 15 08:00:04 srv cron[2]: session opened for user root from cron\n"
        "Jan 15 08:61:04 srv sshd[1]: Failed password for x from y\n"
        "short line\n")
    rows = fo.parse_ssh_lines(lines(spark, text), 2024).collect()
    good = [(r.event_type, r.user_name, r.ip) for r in rows if r.reject_reason is None]
    assert good == [
        ("login_failure", "bob", "1.2.3.4"), ("login_failure", "alice", "1.2.3.4"),
        ("login_success", "carol", "5.6.7.8"), ("login_failure", "eve", "9.9.9.9"),
        ("authentication", None, None)]
    assert sorted(r.reject_reason for r in rows if r.reject_reason) == ["bad ts", "too short"]


def test_formats_of_a_folder(spark, tmp_path):
    (tmp_path / "conn.log").write_text(ZEEK)
    (tmp_path / "zeek_x.log").write_text('{"ts":1,"id.orig_h":"a"}\n')
    (tmp_path / "auth.log").write_text("Jan 15 08:00:01 srv sshd[1]: Accepted password for al from 1.1.1.1 port 1\n")
    (tmp_path / "export.csv").write_text("EventID,TimeGenerated\n4624,2024-01-01T00:00:00Z\n")
    (tmp_path / "notes.txt").write_text("EventID\n")
    found = {r.file.rsplit("/", 1)[1]: r.format
             for r in fo.detect_formats(fo.read_first_lines(spark, str(tmp_path))).collect()}
    assert found == {"conn.log": "zeek_tsv", "zeek_x.log": "zeek_json", "auth.log": "ssh_auth",
                     "export.csv": "windows_event", "notes.txt": "unknown"}
    with pytest.raises(ValueError):
        fo.read_logs(spark, str(tmp_path), 2024)
    parsed = fo.read_logs(spark, str(tmp_path), 2024, strict=False)
    assert fo.good(parsed).count() == 4
    assert parsed.filter(F.col("reject_reason") == "unknown format").count() == 1
