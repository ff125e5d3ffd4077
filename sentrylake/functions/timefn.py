"""Timestamp expressions on TIMESTAMP_NTZ holding UTC; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_ORIGIN = "timestamp_ntz'0001-01-01 00:00:00'"


def minutes(n: int) -> Column:
    return F.expr(f"interval '{int(n)}' minute")


def seconds(n: int) -> Column:
    return F.expr(f"interval '{int(n)}' second")


def _part(unit: str, value: Column) -> Column:
    return F.extract(F.lit(unit), value)


def floor_minutes(ts: Column, n: int) -> Column:
    """Floor to n minutes within the hour."""
    return ts - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts) % F.lit(n), _part("second", ts)
    )


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, microseconds kept (DOUBLE)."""
    i = b - a
    return (
        _part("day", i) * F.lit(86400)
        + _part("hour", i) * F.lit(3600)
        + _part("minute", i) * F.lit(60)
        + _part("second", i)
    ).cast("double")


def time_slot(ts: Column, width_seconds: int) -> Column:
    """Number of the fixed-width time slot ts falls in (BIGINT, counted from year 1)."""
    i = ts - F.expr(_ORIGIN)
    whole = (
        _part("day", i).cast("bigint") * F.lit(86400)
        + _part("hour", i) * F.lit(3600)
        + _part("minute", i) * F.lit(60)
        + F.floor(_part("second", i))
    )
    return F.floor(whole / F.lit(width_seconds)).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(
        F.lit(0),
        F.lit(0),
        F.lit(0),
        (micros.cast("decimal(20,0)") * F.expr("0.000001BD")).cast("decimal(18,6)"),
    )


def from_epoch_seconds(secs: Column) -> Column:
    """Epoch seconds given as DECIMAL(20,6)."""
    return F.expr(_EPOCH) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)")
    )


def parse_utc(text: Column) -> Column:
    """ISO-8601 text, extended or compact, to UTC; text without an offset is taken as UTC;
    null when unreadable."""
    # Words the parser knows, such as "now", are no timestamps here.
    digits = F.regexp_replace(text, r"(?s)^\D.*$", "")
    spaced = F.regexp_replace(
        digits, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6"
    )
    timed = F.regexp_replace(spaced, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    zoned = F.regexp_replace(timed, r"^(\d{4}-\d{2}-\d{2}[T ][^Z+-]*)$", "$1Z")
    return from_epoch_micros(F.unix_micros(zoned.try_cast("timestamp")))


def iso_utc(ts: Column) -> Column:
    """ISO text with Z; six fraction digits only when the fraction is not zero."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    padded = F.regexp_replace(text, r"(\.\d+)$", "$100000")
    return F.concat(F.regexp_replace(padded, r"(\.\d{6})\d+$", "$1"), F.lit("Z"))


def micros_of(ts: Column) -> Column:
    """Microseconds since year 1 (BIGINT)."""
    i = ts - F.expr(_ORIGIN)
    return (
        (
            _part("day", i).cast("bigint") * F.lit(86400)
            + _part("hour", i) * F.lit(3600)
            + _part("minute", i) * F.lit(60)
        )
        * F.lit(1000000)
        + (_part("second", i) * F.lit(1000000)).cast("bigint")
    )


def utc_now() -> Column:
    return from_instant(F.current_timestamp())


def to_instant(ts: Column) -> Column:
    """TIMESTAMP of a UTC value (watermarks need one)."""
    return F.timestamp_micros(micros_of(ts) - micros_of(F.expr(_EPOCH)))


def from_instant(instant: Column) -> Column:
    return from_epoch_micros(F.unix_micros(instant))
