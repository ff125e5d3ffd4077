"""SimHash near-duplicates found by covering locality-sensitive hashing (Pagh, 2016).

Every bit position i of a fingerprint gets a vector f(i) of r + 1 bits, r the radius. For each of
the 2**(r+1) - 1 nonzero vectors v there is a table whose key keeps the bits i with f(i) . v odd.
If two fingerprints differ in at most r bits, the vectors of those bits leave some v orthogonal to
all of them, so in that table the two keys are equal: no pair within the radius is missed.

Copies count once: tables hold distinct fingerprints. Fingerprints of one key are compared with
each other and only a spanning set of their links goes on. A key with more than BUCKET_LIMIT
fingerprints is not compared; its members are linked instead through all points within half the
radius of them, which two fingerprints share exactly if they are within the radius. That takes a
fixed number of rows per member, however many members there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import component_links
from ..operators.skew import spread_join
from ..operators.staging import stage
from .common import text_pieces

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET_LIMIT = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    """The unsigned SimHash of a UTF-8 text; zero without a word."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    stops = ends[width - 1 :].tolist()
    n, ones, digest = len(stops), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _HASHES_AT_ONCE):
        pairs = zip(starts[at : at + _HASHES_AT_ONCE], stops[at : at + _HASHES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as signed bigint) per row; null texts have fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                found = np.array([fingerprint(t or b"") for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(found.view(np.int64))], ["id", "fp"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The signed 64-bit masks of all tables. Positions take the nonzero vectors in turn."""
    vectors = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _runs(batches: Iterator[pa.RecordBatch], limit: int):
    """Batches sorted by (slot, key) -> (run numbers, members) of complete runs, and single
    members of runs longer than limit as (None, members)."""
    kept = [np.empty(0, np.int64)] * 3
    inside = None  # the long run that is passing
    for batch in batches:
        new = [np.asarray(batch.column(c)).astype(np.int64) for c in ("slot", "key", "fp")]
        slot, key, fp = (np.concatenate(p) for p in zip(kept, new, strict=True))
        if inside is not None:
            same = (slot == inside[0]) & (key == inside[1])
            if same.any():
                yield None, fp[same]
            slot, key, fp = slot[~same], key[~same], fp[~same]
            if not len(fp):
                kept = [slot, key, fp]
                continue
            inside = None
        first = np.concatenate([[True], (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])])
        start = int(np.flatnonzero(first)[-1])
        if start:
            yield np.cumsum(first[:start]), fp[:start]
        slot, key, fp = slot[start:], key[start:], fp[start:]
        if len(fp) > limit:
            inside = (slot[0], key[0])
            yield None, fp
            slot, key, fp = slot[:0], key[:0], fp[:0]
        kept = [slot, key, fp]
    if len(kept[2]):
        yield np.zeros(len(kept[2]), np.int64), kept[2]


def _spanning_links(run: np.ndarray, fp: np.ndarray, radius: int):
    """Links of each fingerprint with the smallest one of its component within its run."""
    lefts, rights, at = [], [], np.arange(len(fp))
    for lag in range(1, len(fp)):
        at = at[: np.searchsorted(at, len(fp) - lag)]
        at = at[run[at] == run[at + lag]]
        if not len(at):
            break
        # as unsigned: of a negative number, bitwise_count takes the absolute value
        near = at[np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64)) <= radius]
        lefts.append(near)
        rights.append(near + lag)
    if not lefts:
        return fp[:0], fp[:0]
    left, right = np.concatenate(lefts), np.concatenate(rights)
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _edges(u, v=None) -> pa.RecordBatch:
    v = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v], ["u", "v"])


def near_links(distinct: DataFrame, radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """distinct (fp) -> u, v: links that connect exactly the fingerprints which chains of pairs
    within the radius connect. Every link is itself such a pair or a chain of them."""
    masks = ", ".join(f"{m}L" for m in covering_masks(radius))
    keyed = distinct.selectExpr("fp", f"posexplode(array({masks})) as (slot, mask)").selectExpr(
        "slot", "fp & mask as key", "fp"
    )

    def compare(batches):
        for run, fp in _runs(batches, limit):
            if run is None:
                yield _edges(fp)
                continue
            # A run of up to `limit` members has all its pairs looked at here.
            yield _edges(*_spanning_links(run, fp, radius))

    sorted_keys = keyed.repartition("slot", "key").sortWithinPartitions("slot", "key", "fp")
    found = stage(sorted_keys.mapInArrow(compare, "u bigint, v bigint").distinct(), "links")
    crowded = found.filter("v is null").select(F.col("u").alias("fp"))
    return found.filter("v is not null").unionByName(_links_by_points(crowded, radius))


def _links_by_points(crowded: DataFrame, radius: int) -> DataFrame:
    """Links between distinct fingerprints that share a point within half the (even) radius."""
    flips = [0]
    for k in range(1, radius // 2 + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(BITS), k)]
    masks = np.array(flips, np.uint64).view(np.int64)

    def points(batches):
        for batch in batches:
            for fp in np.asarray(batch.column("fp")).astype(np.int64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(masks ^ fp), pa.array(np.full(len(masks), fp))], ["point", "fp"]
                )

    near = crowded.mapInArrow(points, "point bigint, fp bigint")
    least = near.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n"))
    return (
        spread_join(near, least.filter("n > 1"), ["point"], ["fp"])
        .select(F.col("fp").alias("u"), "v")
        .filter("u != v")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per input row: id, fingerprint (16 hexadecimal digits) and component_id, the
    smallest id that chains of links reach, its own included.

    Documents link if their fingerprints differ in at most radius bits. Null texts and texts
    without a word have fingerprint zero and link like any other. Null ids are null in the result,
    pass links on, and never name a component; a component of null ids only has a null id.
    Repeated rows come out as often as they go in. Other columns are not read. An empty table
    gives an empty result.
    """
    printed = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = printed.groupBy("fp").agg(F.min(id_col).alias("least"))
    heads = component_links(near_links(distinct.select("fp"), radius, limit))
    # head: the smallest fingerprint of the component
    headed = distinct.join(heads.select(F.col("u").alias("fp"), F.col("v").alias("head")), "fp",
                           "left").withColumn("head", F.coalesce("head", "fp"))
    named = headed.groupBy("head").agg(F.min("least").alias("component_id"))
    by_print = spread_join(headed, named, ["head"], ["fp"]).select("fp", "component_id")
    return spread_join(printed, by_print, ["fp"], [id_col]).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     radius: int = RADIUS) -> DataFrame:
    """docs without all but one document of each component: the one of the smallest id stays.
    Of repeated rows with that id one stays. Rows without an id stay."""
    return keep_heads(docs, near_duplicates(docs, id_col, text_col, radius), id_col)


def keep_heads(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """One row of docs for each component of found (id, component_id), and those without an id."""
    heads = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    same_id = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
    kept = (
        docs.join(heads, id_col, "left_semi")
        .withColumn("__nth", F.row_number().over(same_id))
        .filter("__nth = 1")
    )
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
