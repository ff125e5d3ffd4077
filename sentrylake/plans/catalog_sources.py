"""Registered queries over the readers: raw lines are written out of the given events, then
parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import iso_utc, micros_of, minutes
from ..operators.staging import run_folder
from ..sources import foreign as fo
from ..sources import ndjson as nd
from ..sources import normalize as nm
from ..sources.projection import security_events
from .registry import query


def _numbered(spark, sf) -> DataFrame:
    return security_events(spark, sf).withColumn("no", F.col("event_id").cast("bigint"))


def _raw(spark, sf, source: str) -> DataFrame:
    """Raw records with the spellings a normaliser must cope with: three forms of timestamp,
    padded upper-case users, numbers as text, some of them unreadable."""
    e = _numbered(spark, sf).filter(F.col("source") == source)
    zulu = iso_utc(F.col("ts"))
    ahead = F.replace(iso_utc(F.col("ts") + minutes(120)), F.lit("Z"), F.lit("+02:00"))
    third = F.col("no") % 3
    ts = (
        F.when(F.col("no") % 50 == 7, "not a time")
        .when(third == 0, zulu)
        .when(third == 1, ahead)
        .otherwise(F.replace(zulu, F.lit("Z"), F.lit("")))
    )
    return e.select(
        ts.alias("ts"),
        F.col("event_type").alias("event"),
        F.concat(F.lit("  "), F.upper("user_name"), F.lit("\t")).alias("user"),
        F.concat(F.lit(" "), F.col("ip")).alias("ip"),
        F.concat(F.lit(" "), F.col("ip")).alias("src_ip"),
        "dst_ip",
        F.when(F.col("no") % 40 == 3, "http").otherwise(F.col("dst_port").cast("string")).alias("dst_port"),
        F.lit("tcp").alias("proto"),
        F.when(F.col("no") % 4 == 1, F.lit(None)).otherwise(F.col("bytes").cast("string")).alias("bytes"),
        "action",
        "host",
        F.lit("vpn").alias("app"),
        "command",
    )


def _canonical(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "ts", "source", "event_type", "user_name", "ip", "host", "app", "dst_ip",
        "dst_port", "bytes", "action", "command",
    )


@query
def normalize_auth(spark, sf):
    return _canonical(nm.accepted(nm.normalize("auth", _raw(spark, sf, "auth"))))


@query
def normalize_network(spark, sf):
    return _canonical(nm.accepted(nm.normalize("network", _raw(spark, sf, "network"))))


@query
def normalize_process(spark, sf):
    return _canonical(nm.accepted(nm.normalize("process", _raw(spark, sf, "process"))))


def _all(spark, sf) -> DataFrame:
    parts = [nm.normalize(s, _raw(spark, sf, s)) for s in nm.RAW_FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def load_events(spark, sf):
    return _canonical(nm.accepted(_all(spark, sf)))


@query
def rejects(spark, sf):
    return nm.rejected(_all(spark, sf))


@query
def ingest_summary(spark, sf):
    return nm.ingest_summary(_all(spark, sf))


@query
def src_ndjson(spark, sf):
    """The lines of all three sources, each parsed by its own fields."""
    wanted = ["ts", "event", "user", "ip", "src_ip", "dst_port", "bytes", "host", "command"]
    parts = []
    for source in nm.RAW_FIELDS:
        raw = _raw(spark, sf, source)
        lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
        parsed = nd.parse_ndjson_lines(lines, source)
        parts.append(parsed.select(*[c for c in wanted if c in parsed.columns]))
    out = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.unionByName(parts[2], allowMissingColumns=True).select(*wanted)


def _epoch(ts: Column) -> Column:
    us = micros_of(ts) - micros_of(F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.concat(
        F.floor(us / F.lit(1000000)).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((us % F.lit(1000000)).cast("string"), 6, "0"),
    )


def _flows(spark, sf) -> DataFrame:
    return _numbered(spark, sf).filter(F.col("source") == "network")


@query
def src_zeek_tsv(spark, sf):
    cols = "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes"
    rows = _flows(spark, sf).select(
        F.concat_ws(
            "\t", _epoch(F.col("ts")), F.concat(F.lit("C"), F.col("no").cast("string")), "ip",
            F.lit("50000"), "dst_ip", F.col("dst_port").cast("string"), F.lit("TCP"), F.lit("-"),
            F.lit("1.5"), F.when(F.col("no") % 10 == 0, "-").otherwise(F.col("bytes").cast("string")),
            F.lit("100"),
        ).alias("value"),
        F.lit("conn.log").alias("file"),
    )
    head = spark.range(1).select(
        F.lit("#fields\t" + "\t".join(cols.split())).alias("value"), F.lit("conn.log").alias("file")
    )
    return fo.good(fo.parse_zeek_tsv(head.unionByName(rows))).select(
        "event_id", "ts", "event_type", "ip", "dst_ip", "dst_port", "proto", "bytes"
    )


def zeek_json_lines(spark, sf, part: Column) -> DataFrame:
    """The network events as lines, each twentieth broken."""
    return _flows(spark, sf).filter(part).select(
        F.concat(
            F.lit('{"ts":'), _epoch(F.col("ts")), F.lit(',"id.orig_h":"'), "ip",
            F.lit('","id.resp_h":"'), "dst_ip", F.lit('","id.resp_p":'),
            F.col("dst_port").cast("string"), F.lit(',"proto":"UDP","_path":"'),
            F.when(F.col("no") % 3 == 0, "dns").otherwise("conn"), F.lit('","uid":"C'),
            F.col("no").cast("string"), F.when(F.col("no") % 20 == 1, "").otherwise('"}'),
        ).alias("value")
    )


@query
def src_zeek_json(spark, sf):
    lines = zeek_json_lines(spark, sf, F.lit(True))
    return fo.good(fo.parse_zeek_json(lines)).select(
        "event_id", "ts", "event_type", "ip", "dst_ip", "dst_port", "proto",
        F.col("extra")["uid"].alias("uid"),
    )


def _logins(spark, sf) -> DataFrame:
    return _numbered(spark, sf).filter(F.col("source") == "auth")


def windows_rows(spark, sf, part: Column) -> DataFrame:
    """The logins as rows of an event export, user and address in one column or the other."""
    odd = F.col("no") % 2 == 1
    return _logins(spark, sf).filter(part).select(
        F.when(F.col("no") % 30 == 0, "?").otherwise(iso_utc(F.col("ts"))).alias("TimeGenerated"),
        F.when(F.col("no") % 7 == 0, "4672")
        .when(F.col("event_type") == "login_success", "4624")
        .otherwise("4625")
        .alias("EventID"),
        F.col("host").alias("Computer"),
        F.when(odd, F.col("user_name")).otherwise("").alias("AccountName"),
        F.when(~odd, F.upper("user_name")).alias("TargetUserName"),
        F.when(odd, F.col("ip")).alias("SourceIPAddress"),
        F.when(F.col("no") % 4 == 0, F.col("ip")).otherwise("").alias("IpAddress"),
        F.lit("3").alias("LogonType"),
    )


@query
def src_windows_csv(spark, sf):
    rows = windows_rows(spark, sf, F.lit(True))
    return fo.good(fo.parse_windows_rows(rows)).select(
        "event_id", "ts", "event_type", "user_name", "ip", "host",
        F.col("extra")["LogonType"].alias("logon_type"),
    )


def ssh_lines(spark, sf, part: Column) -> DataFrame:
    """The logins as syslog lines, each eleventh of another kind."""
    stamp = F.format_string(
        "Jan %2d %02d:%02d:%02d", F.day("ts"), F.hour("ts"), F.minute("ts"), F.second("ts")
    )
    who = F.when(F.col("no") % 2 == 0, F.concat(F.lit("invalid user "), "user_name")).otherwise(
        F.col("user_name")
    )
    message = (
        F.when(F.col("no") % 11 == 0, "Server listening on 0.0.0.0 port 22.")
        .when(
            F.col("event_type") == "login_failure",
            F.concat(F.lit("Failed password for "), who, F.lit(" from "), "ip", F.lit(" port 22 ssh2")),
        )
        .otherwise(
            F.concat(F.lit("Accepted publickey for "), "user_name", F.lit(" from "), "ip", F.lit(" port 22"))
        )
    )
    return _logins(spark, sf).filter(part).select(
        F.concat_ws(" ", stamp, "host", F.lit("sshd[77]:"), message).alias("value")
    )


@query
def src_ssh_auth(spark, sf):
    lines = ssh_lines(spark, sf, F.lit(True))
    return fo.good(fo.parse_ssh_lines(lines, 2024)).select(
        "event_id", "ts", "event_type", "user_name", "ip", "host",
        F.col("extra")["process"].alias("process"),
    )


@query
def detect_format(spark, sf):
    """A few files made of all events: the first line and the name decide."""
    names = ["zeek_a.log", "conn.log", "windows.csv", "export.csv", "auth.log", "app.txt"]
    heads = ['{"ts":1}', "#separator", "TimeGenerated,EventID", "a,b", "Jan  1", "EventID"]
    pick = F.expr("cast(no % 6 as int)")
    e = _numbered(spark, sf)
    lines = e.select(
        F.concat(F.lit("/logs/"), F.get(F.array(*[F.lit(n) for n in names]), pick)).alias("file"),
        F.col("no").alias("line_no"),
        F.when(F.col("no") < 6, F.get(F.array(*[F.lit(h) for h in heads]), pick))
        .otherwise(F.coalesce("command", "ip"))
        .alias("value"),
    )
    return fo.detect_formats(fo.first_lines(lines)).select("file", "format")


@query
def sink_ndjson(spark, sf):
    """Raw records of all sources written as files, one folder of three names, and loaded."""
    return _canonical(_reread(spark, sf, ordered=False))


@query
def events_by_time(spark, sf):
    """The same, loaded in the order of time."""
    return _reread(spark, sf, ordered=True).select("event_id", "ts")


def _reread(spark, sf, ordered: bool) -> DataFrame:
    folder = f"{run_folder(spark)}/ndjson-{uuid.uuid4().hex}"
    for source in nm.RAW_FIELDS:
        nd.write_ndjson(_raw(spark, sf, source), f"{folder}/{source}", f"{source}.ndjson")
    return nd.load_events(spark, f"{folder}/*", ordered)
