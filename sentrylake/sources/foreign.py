"""Zeek, Windows event and SSH logs. Each format has a reader (files -> lines) and a parser
(lines -> canonical events plus reject_reason); parsers never fail on a bad row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import blank_to_null, clean_ip, clean_user, strip
from ..functions.timefn import from_epoch_seconds, iso_utc, parse_utc
from ..operators.skew import spread_join
from ..schema import EVENT_FIELDS

PARSED = [*EVENT_FIELDS, "reject_reason"]


def _parsed(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(EVENT_FIELDS.get(c, "string")).alias(c)
            for c in PARSED
        ]
    )


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with the file each comes from."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def _epoch_text(secs: Column) -> Column:
    """Epoch seconds without trailing zeros, at least one fraction digit."""
    text = F.regexp_replace(secs.cast("decimal(20,6)").cast("string"), "0+$", "")
    return F.regexp_replace(text, r"\.$", ".0")


def parse_zeek_tsv(lines: DataFrame, unset: str = "drop") -> DataFrame:
    """conn.log lines (value, file). Column names come from the #fields line of each file.

    unset='drop' rejects rows whose numbers are '-'; unset='null' reads those as missing."""
    marker = "#fields"
    names = (
        lines.filter(F.col("value").startswith(marker))
        .select("file", F.split(strip(F.substring("value", len(marker) + 1, 1 << 20)), r"\s+").alias("names"))
        .groupBy("file")
        .agg(F.min("names").alias("names"))
    )
    rows = lines.filter(~F.col("value").startswith("#") & (strip(F.col("value")) != ""))
    # One row of names per file, and a file may be most of the lines.
    cut = spread_join(rows, names, ["file"], ["value"], salts=64).withColumn("parts", F.split("value", "\t"))
    width = F.least(F.size("names"), F.size("parts"))
    named = cut.select(
        "file",
        F.map_from_arrays(F.slice("names", 1, width), F.slice("parts", 1, width)).alias("m"),
    )

    def text(key: str) -> Column:
        return F.try_element_at("m", F.lit(key))

    def number(key: str, kind: str) -> Column:
        """Absent column counts as 0, unreadable text as null."""
        raw = text(key)
        value = F.when(raw.isNull(), F.lit("0")).otherwise(raw).try_cast(kind)
        return F.when(raw == "-", F.lit(0).cast(kind)).otherwise(value) if unset == "null" else value

    ts = number("ts", "decimal(20,6)")
    got = named.select(
        ts.alias("epoch"),
        text("id.orig_h").alias("orig"),
        text("id.resp_h").alias("resp"),
        text("id.resp_p").alias("port"),
        F.lower(text("proto")).alias("proto"),
        number("duration", "double").alias("duration"),
        number("orig_bytes", "bigint").alias("sent"),
        number("resp_bytes", "bigint").alias("received"),
    )
    bad = F.col("epoch").isNull() | F.col("duration").isNull() | F.col("sent").isNull() | F.col(
        "received"
    ).isNull()
    return _parsed(
        got.select(
            F.concat_ws(
                "_", F.lit("zeek"), _epoch_text(F.col("epoch")), F.coalesce("orig", F.lit("")),
                F.coalesce("resp", F.lit("")),
            ).alias("event_id"),
            from_epoch_seconds(F.col("epoch")).alias("ts"),
            F.lit("network").alias("source"),
            F.lit("connection").alias("event_type"),
            clean_ip(F.col("orig")).alias("ip"),
            clean_ip(F.col("resp")).alias("dst_ip"),
            F.when(F.col("port").rlike(r"^\d+$"), F.col("port").try_cast("int")).alias("dst_port"),
            "proto",
            (F.col("sent") + F.col("received")).alias("bytes"),
            F.map_from_arrays(
                F.array(F.lit("duration"), F.lit("orig_bytes"), F.lit("resp_bytes")),
                F.array(
                    F.col("duration").cast("string"),
                    F.col("sent").cast("string"),
                    F.col("received").cast("string"),
                ),
            ).alias("extra"),
            F.when(bad, "bad number").alias("reject_reason"),
        )
    )


def parse_zeek_json(lines: DataFrame) -> DataFrame:
    """One object per line; keys hold dots, so they are looked up in a map."""
    body = strip(F.col("value"))
    m = (
        lines.filter((body != "") & ~F.col("value").startswith("#"))
        .withColumn("m", F.from_json("value", "map<string,string>"))
    )

    def text(key: str) -> Column:
        return F.try_element_at("m", F.lit(key))

    epoch = F.coalesce(text("ts"), F.lit("0")).try_cast("decimal(20,6)")
    kind = F.coalesce(text("_path"), F.lit("conn"))
    own = ("ts", "id.orig_h", "id.resp_h", "_path")
    bad = F.col("m").isNull() | F.col("epoch").isNull()
    return _parsed(
        m.withColumn("epoch", epoch).select(
            F.concat_ws(
                "_", F.lit("zeek"), _epoch_text(F.col("epoch")),
                F.coalesce(text("id.orig_h"), F.lit("")), F.coalesce(text("id.resp_h"), F.lit("")),
            ).alias("event_id"),
            from_epoch_seconds(F.col("epoch")).alias("ts"),
            F.lit("network").alias("source"),
            F.when(kind == "conn", "connection").otherwise(kind).alias("event_type"),
            clean_ip(text("id.orig_h")).alias("ip"),
            clean_ip(text("id.resp_h")).alias("dst_ip"),
            text("id.resp_p").try_cast("int").alias("dst_port"),
            F.lower(text("proto")).alias("proto"),
            text("bytes").try_cast("bigint").alias("bytes"),
            F.map_filter("m", lambda k, v: ~k.isin(*own)).alias("extra"),
            F.when(bad, "bad json or ts").alias("reject_reason"),
        )
    )


def read_windows_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Exported event CSV with a header row; every column as text."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("header", True).option("inferSchema", False).csv(paths)


def parse_windows_rows(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)

    def text(key: str) -> Column:
        return blank_to_null(F.col(f"`{key}`")) if key in have else F.lit(None).cast("string")

    account = F.coalesce(text("AccountName"), text("TargetUserName"))
    address = F.coalesce(text("SourceIPAddress"), text("IpAddress"))
    number = F.coalesce(text("EventID"), F.lit("0")).try_cast("int")
    own = ("TimeGenerated", "EventID", "Computer", "AccountName", "SourceIPAddress")
    others = [c for c in rows.columns if c not in own]
    got = rows.withColumn("_ts", parse_utc(text("TimeGenerated"))).withColumn("_no", number)
    no = F.col("_no")
    extra = F.map_filter(
        F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`"))]),
        lambda k, v: v.isNotNull(),
    ) if others else F.lit(None)
    return _parsed(
        got.select(
            F.concat_ws(
                "_", F.lit("win"), no.cast("string"), iso_utc(F.col("_ts")),
                F.coalesce(account, F.lit("")),
            ).alias("event_id"),
            F.col("_ts").alias("ts"),
            F.lit("auth").alias("source"),
            # Event numbers of successful and failed logons.
            F.when(no == 4624, "login_success")
            .when(no == 4625, "login_failure")
            .otherwise(F.concat(F.lit("event_"), no.cast("string")))
            .alias("event_type"),
            clean_user(account).alias("user_name"),
            clean_ip(address).alias("ip"),
            text("Computer").alias("host"),
            text("AuthenticationPackageName").alias("method"),
            extra.alias("extra"),
            F.when(F.col("_ts").isNull(), "bad ts")
            .when(no.isNull(), "bad EventID")
            .alias("reject_reason"),
        )
    )


# Syslog month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def parse_ssh_lines(lines: DataFrame, year: int) -> DataFrame:
    """`Mon DD HH:MM:SS host process: message` of the given year."""
    cut = lines.filter(strip(F.col("value")) != "").withColumn(
        "p", F.split(strip(F.col("value")), r"\s+")
    )
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get("p", F.lit(0)))
    clock = F.split(F.get("p", F.lit(2)), ":")

    def part(c: Column) -> Column:
        return c.try_cast("int")

    got = cut.select(
        # An unknown month name counts as January.
        F.try_make_timestamp_ntz(
            F.lit(year),
            F.greatest(month, F.lit(1)).cast("int"),
            part(F.get("p", F.lit(1))),
            part(F.get(clock, F.lit(0))),
            part(F.get(clock, F.lit(1))),
            part(F.get(clock, F.lit(2))).cast("decimal(16,6)"),
        ).alias("ts"),
        F.size("p").alias("n"),
        F.get("p", F.lit(3)).alias("host"),
        F.regexp_replace(F.get("p", F.lit(4)), ":+$", "").alias("process"),
        F.array_join(F.slice("p", 6, F.greatest(F.size("p") - 5, F.lit(0))), " ").alias("message"),
    )
    text = F.col("message")
    failed = text.contains("Failed password") | text.contains("Invalid user")
    passed = text.contains("Accepted password") | text.contains("Accepted publickey")
    told = failed | passed
    name = F.regexp_extract(text, r"(?:\bfor (?:invalid user )?|\bInvalid user )(\S+)", 1)
    source_ip = F.regexp_extract(text, r"\bfrom (\S+)", 1)
    typed = got.select(
        "ts",
        "n",
        "host",
        "process",
        "message",
        F.when(failed, "login_failure").when(passed, "login_success").otherwise("authentication").alias(
            "event_type"
        ),
        F.when(told, clean_user(name)).alias("user_name"),
        F.when(told, clean_ip(source_ip)).alias("ip"),
    )
    return _parsed(
        typed.select(
            F.concat_ws(
                "_", F.lit("ssh"), iso_utc(F.col("ts")), F.coalesce("user_name", F.lit("None")),
                F.coalesce("ip", F.lit("None")),
            ).alias("event_id"),
            "ts",
            F.lit("auth").alias("source"),
            "event_type",
            "user_name",
            "ip",
            "host",
            F.map_from_arrays(
                F.array(F.lit("process"), F.lit("message")), F.array("process", "message")
            ).alias("extra"),
            F.when(F.col("n") < 6, "too short")
            .when(F.col("ts").isNull(), "bad ts")
            .alias("reject_reason"),
        )
    )


def detect_formats(first_lines: DataFrame) -> DataFrame:
    """Add format to (file, value) holding the first line of each file."""
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    line = F.col("value")
    zeek = name.contains("zeek") | name.contains("conn.log")
    windows = (
        name.contains("windows") | name.contains("event") | name.endswith(".csv")
    ) & (line.contains("TimeGenerated") | line.contains("EventID"))
    ssh = name.contains("ssh") | name.contains("auth.log") | name.contains("secure")
    return first_lines.select(
        *first_lines.columns,
        F.when(zeek & strip(line).startswith("{"), "zeek_json")
        .when(zeek, "zeek_tsv")
        .when(windows, "windows_event")
        .when(ssh, "ssh_auth")
        .otherwise("unknown")
        .alias("format"),
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """file, value of the first line from (file, line_no, value)."""
    return lines.groupBy("file").agg(F.min_by("value", "line_no").alias("value"))


def read_first_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The first line of each file: the first row of the piece that starts at byte 0."""
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )
    return first_lines(rows.filter(F.col("block") == 0))


def read_logs(
    spark: SparkSession, path: str | Sequence[str], year: int, strict: bool = True
) -> DataFrame:
    """Parsed events (with reject_reason) of files in any of the four formats. A file of
    unknown format fails a strict read and otherwise becomes one rejected row.

    The list of files is driver metadata, as in any file scan; the lines are not."""
    found: dict[str, list[str]] = {}
    headers: dict[str, list[str]] = {}
    for row in detect_formats(read_first_lines(spark, path)).toLocalIterator():
        found.setdefault(row["format"], []).append(row["file"])
        if row["format"] == "windows_event":
            headers.setdefault(row["value"], []).append(row["file"])
    unknown = found.pop("unknown", [])
    if unknown and strict:
        raise ValueError(f"unknown log format: {unknown[:5]}")
    parts = []
    if "zeek_tsv" in found:
        parts.append(parse_zeek_tsv(read_lines(spark, found["zeek_tsv"])))
    if "zeek_json" in found:
        parts.append(parse_zeek_json(read_lines(spark, found["zeek_json"])))
    # Header rows differ between exports: files are read together by header.
    parts += [parse_windows_rows(read_windows_csv(spark, files)) for files in headers.values()]
    if "ssh_auth" in found:
        parts.append(parse_ssh_lines(read_lines(spark, found["ssh_auth"]), year))
    if unknown:
        bad = spark.createDataFrame([(f, "unknown format") for f in unknown],
                                    "event_id string, reject_reason string")
        parts.append(_parsed(bad))
    if not parts:
        return _parsed(spark.createDataFrame([], "event_id string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason")

