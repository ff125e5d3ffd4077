"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

Documents lie in blocks. A block's postings of the query terms are put in order by term once; then
each item's terms are worked off rarest first (by the number of documents in the whole table). A
document gets an accumulator the first time one of the item's terms is met in it, until the terms
still to come could not lift a new document to the k-th partial score: from then on only documents
that have an accumulator are updated, and those exactly. The bound of a term is the largest
contribution that it makes in the block. The k best of a task's earlier blocks raise the k-th score
of its later ones, and a task hands on k documents an item at most, so what meets in the end
follows the number of tasks and not that of documents.

Items are taken in groups of about GROUP_TERMS terms, whose vocabulary every task holds; each
group reads all documents.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stage, stage_observed
from .common import text_pieces

GROUP_TERMS = 200_000
BLOCK_POSTINGS = 2_000_000
# A longer text is taken apart into words in parts of about this many bytes.
PART_BYTES = 4 << 20
# Everything that is no digit, no letter A to Z or a to z and not beyond ASCII parts the terms;
# A to Z become a to z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: bytes):
    """The terms of a text in lists, part by part."""
    folded = text.translate(_FOLD)
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + PART_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (of the item), id, term and its number of occurrences; rows of null texts and of texts
    without a term are missing."""

    def count(batches):
        for batch in batches:
            rows, ids, terms, counts = [], [], [], []
            texts = batch.column("text").cast(pa.binary())
            for row, item, text in zip(batch.column("row").to_pylist(),
                                       batch.column("id").to_pylist(), texts, strict=True):
                seen: dict[bytes, int] = {}
                for part in terms_of(text.as_py() or b""):
                    for t in part:
                        seen[t] = seen.get(t, 0) + 1
                rows += [row] * len(seen)
                ids += [item] * len(seen)
                terms += seen.keys()
                counts += seen.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(terms, pa.binary()), pa.array(counts, pa.int64())],
                ["row", "id", "term", "n"],
            )

    numbered = items.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    return stage(
        numbered.mapInArrow(count, "row bigint, id bigint, term binary, n bigint"), "item-terms"
    )


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]):
    """doc_id, n (terms with repeats), terms (numbers in the vocabulary) and tfs of every document
    that has a term, whether or not it is in the vocabulary."""
    size = max(len(vocabulary), 1)

    def count(batches):
        find = vocabulary.get
        for whole in batches:
            for batch in text_pieces(whole, "text"):
                texts = batch.column("text").cast(pa.binary())
                found, lengths = [], np.zeros(batch.num_rows, np.int64)
                for i, text in enumerate(texts):
                    for part in terms_of(text.as_py() or b""):
                        lengths[i] += len(part)
                        known = np.fromiter(map(find, part, repeat(-1)), np.int64, len(part))
                        found.append(known[known >= 0] + i * size)
                keys, tfs = np.unique(
                    np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True
                )
                kept = np.flatnonzero(lengths)
                ends = np.searchsorted(keys, (kept + 1) * size)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(kept)),
                        pa.array(lengths[kept]),
                        pa.ListArray.from_arrays(offsets, pa.array(keys % size, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Block:
    """Contributions of each query term to each document of a block, ordered by term."""

    def __init__(self, n, counts, terms, tfs, weight, n_docs, n_terms):
        self.rows = len(n)
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(n)), counts)
        adds = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.adds = doc[order], adds[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        met = np.flatnonzero(np.diff(self.start))
        if len(met):
            self.most[met] = np.maximum.reduceat(self.adds, self.start[met])

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int):
        """Rows that can be among the k best, with their scores; all that reach `least`, the k-th
        score known from elsewhere. terms: rarest first."""
        bounds = self.most[terms] * repeats
        left = np.cumsum(bounds[::-1])[::-1]
        score = np.zeros(self.rows, np.int64)
        have = np.zeros(self.rows, bool)
        opened, kth = 0, least
        for term, times, rest in zip(terms, repeats, left, strict=True):
            at = slice(self.start[term], self.start[term + 1])
            doc, adds = self.doc[at], self.adds[at] * times
            if rest < kth:
                # no new document can reach the k-th score any more
                old = have[doc]
                score[doc[old]] += adds[old]
                continue
            score[doc] += adds
            have[doc] = True
            opened = np.count_nonzero(have)
            if opened >= k:
                kth = max(kth, int(np.partition(score[have], opened - k)[opened - k]))
        rows = np.flatnonzero(have & (score > 0) & (score >= least))
        return rows, score[rows]


def _best(ids, known, scores, k):
    """Positions of the k best: by score downwards, then by id, null ids last."""
    return np.lexsort((ids, ~known, -scores))[:k]


def _search_blocks(wanted, weight, n_docs, n_terms, k, block_postings):
    """wanted: (row, terms rarest first, repeats) of each item."""

    def search(batches):
        best = {}
        held, size = [], 0

        def work():
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            lists = [b.column("terms") for b in held]
            block = Block(
                np.concatenate([b.column("n").to_numpy() for b in held]),
                np.concatenate([x.value_lengths().to_numpy() for x in lists]),
                np.concatenate([x.flatten().to_numpy() for x in lists]),
                np.concatenate([b.column("tfs").flatten().to_numpy() for b in held]),
                weight, n_docs, n_terms,
            )
            for row, terms, repeats in wanted:
                old = best.get(row)
                least = int(old[2][-1]) if old and len(old[2]) == k else 0
                rows, scores = block.search(terms, repeats, k, least)
                if not len(rows):
                    continue
                new = ids[rows], known[rows], scores
                if old:
                    new = tuple(np.concatenate(p) for p in zip(old, new, strict=True))
                top = _best(*new, k)
                best[row] = tuple(p[top] for p in new)

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= block_postings:
                work()
                held, size = [], 0
        if size:
            work()
        for row, (ids, known, scores) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row, np.int64)), pa.array(ids, mask=~known),
                 pa.array(scores)],
                ["row", "doc_id", "score"],
            )

    return search


def _search_group(docs, items, id_col, text_col, k, block_postings) -> DataFrame:
    """items: row, term, n of one group of items, which fit a task."""
    asked = items.toArrow()
    vocabulary = {t: i for i, t in enumerate(sorted(set(asked.column("term").to_pylist())))}
    found, seen = stage_observed(
        postings(docs, id_col, text_col, vocabulary), "postings",
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"),
    )
    n_docs, n_terms = seen["docs"], seen["terms"] or 1
    df = np.zeros(len(vocabulary), np.int64)
    # one row for each term of the vocabulary at most
    counted = found.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df[counted.column("t").to_numpy()] = counted.column("count").to_numpy()
    weight = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()],
        np.int64,
    )
    terms = np.array([vocabulary[t] for t in asked.column("term").to_pylist()], np.int64)
    rows, repeats = asked.column("row").to_numpy(), asked.column("n").to_numpy()
    order = np.lexsort((terms, df[terms], rows))
    cuts = np.flatnonzero(np.diff(rows[order])) + 1
    wanted = [(int(rows[p[0]]), terms[p], repeats[p]) for p in np.split(order, cuts) if len(p)]
    return found.mapInArrow(
        _search_blocks(wanted, weight, n_docs, n_terms, k, block_postings),
        "row bigint, doc_id bigint, score bigint",
    )


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  group_terms: int = GROUP_TERMS,
                  block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The k best documents of every item: item id, rank (from 1), doc_id and score, scores above 0
    only, equal scores by ascending doc_id (null ids last).

    Ids are integers. Null texts and texts without a term match nothing and do not count as
    documents. Every row is an item or a document of its own, so repeated rows come out repeated;
    an item with a null id is searched like any other. Other columns are not read. Empty tables
    give an empty result. A text of any length is read as a whole.
    """
    terms = item_terms(items, item_col, item_text)
    groups = max(math.ceil(terms.count() / group_terms), 1)
    group = F.pmod(F.xxhash64("row"), F.lit(groups))
    scored = [
        _search_group(docs, terms.filter(group == g).select("row", "term", "n"), id_col, text_col,
                      k, block_postings)
        for g in range(groups)
    ]
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ids = terms.select("row", F.col("id").alias(item_col)).distinct()
    return (
        every.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .join(ids, "row")
        .select(item_col, "rank", "doc_id", "score")
    )
