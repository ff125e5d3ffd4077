"""Field normalisation and id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """True for a value that is neither null nor empty."""
    return c.isNotNull() & (c != F.lit(""))


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_user(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def clean_ip(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, each followed by a vertical bar."""
    pieces: list[Column] = []
    for p in parts:
        pieces += [F.coalesce(p.cast("string"), F.lit("-")), F.lit("|")]
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 16)


def int_or_zero(c: Column, kind: str = "bigint") -> Column:
    """Missing and empty count as 0, text that is no integer as null (a reject)."""
    return F.when(present(c), c.try_cast(kind)).otherwise(F.lit(0).cast(kind))


def is_external(ip: Column, rfc1918: bool = False) -> Column:
    """True for a destination outside the private ranges."""
    inside_172 = (
        ip.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\.") if rfc1918 else ip.startswith("172.")
    )
    return present(ip) & ~(ip.startswith("10.") | ip.startswith("192.168.") | inside_172)


def is_service_account(user: Column) -> Column:
    low = F.lower(user)
    return F.coalesce(
        user.startswith("svc_")
        | user.startswith("service_")
        | low.contains("backup")
        | low.contains("deploy"),
        F.lit(False),
    )


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
