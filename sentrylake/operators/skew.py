"""Joins whose keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8
# Rows whose key is null match nothing; they go to as many tasks as there are.
_NULL_SALTS = 1 << 20


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], spread_by: list[str | Column],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with small, which has one row per key: a key's rows go to `salts` tasks by a
    hash of spread_by, and small is copied once per salt. Rows with a null key are kept by an
    outer join only and are spread without bound. small may have several rows per key, if few."""
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    width = F.when(no_key, F.lit(_NULL_SALTS)).otherwise(F.lit(salts))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), width).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


# Shares of all rows that a task should get at most; keys above one share are cut.
PIECES = 1024


def heavy_keys(small: DataFrame, on: list[str], weight: str) -> DataFrame:
    """on, __salts: the keys that hold more than one of PIECES equal shares of the weight, with
    the number of pieces that brings them below one. Fewer than PIECES rows, whatever the data."""
    total = small.agg(F.sum(weight).alias("__total"))  # one row
    share = F.col(weight) * F.lit(PIECES) / F.col("__total")
    return (
        small.crossJoin(F.broadcast(total))
        .filter(share > 1)
        .select(*on, F.ceil(share).cast("int").alias("__salts"))
    )


def weighted_join(rows: DataFrame, small: DataFrame, on: list[str], weight: str,
                  spread_by: list[str | Column], how: str = "inner") -> DataFrame:
    """rows joined with small, whose one row per key tells in `weight` how many rows the key has
    (or a number in proportion). Only a key that holds more than a share of all rows is cut, into
    as many tasks as its weight asks for, and only its row of small is copied; every other key
    keeps one row. Rows with a null key are kept by an outer join only and are spread without
    bound. small is read three times and should be stored; the weight column does not come along."""
    heavy = F.broadcast(heavy_keys(small, on, weight))  # fewer than PIECES rows
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    width = F.when(no_key, F.lit(_NULL_SALTS)).otherwise(F.coalesce("__salts", F.lit(1)))
    salted = rows.join(heavy, on, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*spread_by), width).cast("int")
    ).drop("__salts")
    copies = small.join(heavy, on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    ).drop("__salts", weight)
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
