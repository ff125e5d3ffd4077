"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Python operators take an Arrow batch apart into pieces of about this much text, so that what
# they hold does not follow the number of rows in a batch. A longer text is a piece of its own.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % divisor, F.lit(-1))


def text_pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about PIECE_BYTES of the string column each."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, batch.num_rows + 1, 4 * texts.offset)
    start = 0
    while start < batch.num_rows:
        limit = int(offsets[start]) + PIECE_BYTES
        end = max(int(np.searchsorted(offsets, limit, "right")) - 1, start + 1)
        yield batch.slice(start, min(end, batch.num_rows) - start)
        start = end
