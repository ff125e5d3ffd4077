"""Newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import strip
from ..schema import EVENT_COLUMNS
from .normalize import RAW_FIELDS, accepted, normalize, raw_schema


def read_ndjson(
    spark: SparkSession, path: str, schema: str, strict: bool = True, name: str | None = None
) -> DataFrame:
    """One object per line, blank lines skipped. strict fails on a malformed line; otherwise
    it comes back in _corrupt_record. name restricts a folder to files of that name."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if name:
        reader = reader.option("pathGlobFilter", name)
    if not strict:
        schema += ", _corrupt_record string"
    return reader.schema(schema).json(path)


def parse_ndjson_lines(lines: DataFrame, source: str) -> DataFrame:
    """Lines (column value) to the raw columns of a source; malformed ones keep their text in
    _corrupt_record."""
    schema = raw_schema(source) + ", _corrupt_record string"
    parsed = lines.filter(strip(F.col("value")) != "").select(
        F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")
    )
    return parsed.select("r.*")


def write_ndjson(df: DataFrame, path: str, name: str = "part") -> int:
    """Overwrite path with one object per row; returns the number of rows. The names of its files
    start with `name`, so that load_events finds those of auth.ndjson and so on."""
    counted = Observation()
    out = df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    out.option("mapreduce.output.basename", name).json(path)
    return counted.get["n"]


def load_normalized(spark: SparkSession, raw_dir: str) -> DataFrame:
    """auth.ndjson, network.ndjson and process.ndjson of a folder, or the files whose names start
    so, whichever exist, normalised, with the rejected rows still in it."""
    parts = [
        normalize(s, read_ndjson(spark, raw_dir, raw_schema(s), name=f"{s}.ndjson*"))
        for s in RAW_FIELDS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_events(spark: SparkSession, raw_dir: str, ordered: bool = False) -> DataFrame:
    """Canonical events of a folder; ordered by time only on request."""
    events = accepted(load_normalized(spark, raw_dir)).select(*EVENT_COLUMNS)
    return events.orderBy("ts", "event_id") if ordered else events
