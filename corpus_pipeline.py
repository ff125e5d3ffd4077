"""Corpus cleaning: quality rules, near-dedup, decontamination, mixing and sharding in a row.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm.common import table
from sentrylake.llm.op2_mixing import in_mix_order
from sentrylake.llm.op3_templates import without_contaminated
from sentrylake.llm.op4_simhash import keep_one_of_each
from sentrylake.llm.op6_quality import keep_good
from sentrylake.llm.op7_sharding import deal_into_shards, order_in_shards
from sentrylake.operators.staging import stage as staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every rule."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash over four-word shingles, 4 of 64 bits."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


_KEY = ["doc_id", "text"]


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; surplus of over-supplied sources comes last. The
    order is that of the files written from it, by name, and of the rows in each."""
    return in_mix_order(docs, surplus=True, key=_KEY)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, dealt at random, and its slot there in the order in which
    docs were written, which is that of the mix: each shard is read at the target weights. docs
    have to be read from Parquet files; columns named shard or slot are replaced."""
    placed = docs.drop("shard", "slot").withColumns(
        {"mix_file": F.col("_metadata.file_name"), "mix_row": F.col("_metadata.row_index")}
    )
    dealt = deal_into_shards(placed, _KEY)
    ordered = order_in_shards(
        dealt, "struct(mix_file, mix_row div 4096)", ["mix_file", "mix_row"]
    )
    return ordered.drop("mix_file", "mix_row")


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# The fingerprints, the mix and the shards rest on XXH64, which DuckDB does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = staged(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
