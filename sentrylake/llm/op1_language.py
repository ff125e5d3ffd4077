"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes with the bytes that followed them,
counted once and then frozen. The code length of a text under a language is exact: a byte is coded
in the longest context known; a context in which it was never seen gives an escape (method C: as
many escapes as different bytes seen) and coding goes on in the next shorter context without the
bytes that the longer one has ruled out; below the empty context all bytes left are equally
likely. The language with the shortest code is the prediction, and the score is its share of
2**-length over all languages.

The bytes seen in a context were all seen in its suffix, so what is ruled out follows from two
neighbouring contexts, and a byte's cost depends on nothing but the ORDER + 1 bytes up to it. Costs
are therefore computed once per different run of bytes and looked up for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_pieces

ORDER = 4
# The bound of the sample that a language's tree is counted on: whole texts, chosen by a hash.
SAMPLE_ROWS = 256
# Runs of bytes whose costs a worker remembers; beyond, it starts anew.
REMEMBERED = 2_000_000
_BLOCK = 1 << 20
_SHORT = 8 * (ORDER + 1)  # above the bytes: 0, or 1 + the context's length near a text's start


def _mask(n: int) -> int:
    return (1 << (8 * n)) - 1


def _runs(texts: list[bytes]):
    """Keys of the runs of bytes of all texts (the byte lowest, then those before it), and the
    text and first key of each block. Long texts are taken in blocks that overlap by ORDER."""
    blocks, owner, skip = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, len(text), _BLOCK):
            back = ORDER if at else 0
            blocks.append(text[at - back : at + _BLOCK])
            owner.append(i)
            skip.append(back)
    if not blocks:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(blocks), np.uint8)
    size = np.array([len(b) for b in blocks])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    keys = raw.astype(np.int64)
    for back in range(1, ORDER + 1):
        keys[back:] |= raw[:-back].astype(np.int64) << (8 * back)
    skipped = np.array(skip)
    for context in range(ORDER):
        at = start[(size > context) & (skipped == 0)] + context
        keys[at] = keys[at] & _mask(context + 1) | (context + 1) << _SHORT
    if skipped.any():
        keep = np.ones(len(keys), bool)
        for at in start[skipped > 0]:
            keep[at : at + ORDER] = False
        keys = keys[keep]
        start = np.concatenate([[0], np.cumsum(size - skipped)[:-1]])
    return keys, np.array(owner), start


class ContextTree:
    """Frozen statistics of one language from its runs of bytes and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        short = keys >> _SHORT
        length = np.where(short == 0, ORDER, short - 1)
        self.grams, self.counts, self.contexts, self.stats, self.left = [], [], [], [], []
        for order in range(ORDER + 1):
            reach = length >= order
            grams, inverse = np.unique(keys[reach] & _mask(order + 1), return_inverse=True)
            n = np.bincount(inverse, counts[reach], len(grams))
            contexts, first = np.unique(grams >> 8, return_index=True)
            if len(grams):
                seen = np.diff([*first, len(grams)])
                total = np.add.reduceat(n, first)
            else:
                seen = total = np.empty(0)
            if order and len(grams):
                # what is left of the suffix's statistics without the bytes seen here
                below, below_n = self.grams[-1], self.counts[-1]
                common = below_n[np.searchsorted(below, grams & _mask(order))]
                at = np.searchsorted(self.contexts[-1], contexts & _mask(order - 1))
                suffix_total, suffix_seen = self.stats[-1]
                self.left.append((suffix_total[at] - np.add.reduceat(common, first),
                                  suffix_seen[at] - seen))
            else:
                self.left.append((np.empty(0), np.empty(0)))
            self.grams.append(grams)
            self.counts.append(n)
            self.contexts.append(contexts)
            self.stats.append((total, seen))

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each run."""
        cost = np.zeros(len(keys))
        short = keys >> _SHORT
        length = np.where(short == 0, ORDER, short - 1)
        at = np.arange(len(keys))  # runs whose byte is not coded yet
        # statistics left by a longer context, and whether there was one
        total, seen = np.zeros(len(keys)), np.zeros(len(keys))
        escaped = np.zeros(len(keys), bool)
        for order in range(ORDER, -1, -1):
            contexts, grams = self.contexts[order], self.grams[order]
            if not len(contexts) or not len(at):
                continue
            context = (keys[at] >> 8) & _mask(order)
            place = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            here = (contexts[place] == context) & (length[at] >= order)
            run, place = at[here], place[here]
            own_total, own_seen = (s[place] for s in self.stats[order])
            t = np.where(escaped[run], total[run], own_total)
            d = np.where(escaped[run], seen[run], own_seen)
            gram = keys[run] & _mask(order + 1)
            found = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            hit = grams[found] == gram
            with np.errstate(divide="ignore", invalid="ignore"):
                coded = np.log2((t + d) / self.counts[order][found])
                escape = np.where(d > 0, np.log2((t + d) / d), 0.0)
            cost[run] += np.where(hit, coded, escape)
            if order:
                left_total, left_seen = self.left[order]
                total[run], seen[run] = left_total[place], left_seen[place]
            escaped[run] = True
            done = np.zeros(len(keys), bool)
            done[run[hit]] = True
            at = at[~done[at]]
        known = len(self.grams[0])
        cost[at] += np.log2(max(256 - known, 1))
        return cost


class Languages:
    """The trees of all languages; costs of runs are remembered per process."""

    def __init__(self, trees: dict[str, ContextTree]):
        self.names = sorted(trees)
        self.trees = [trees[n] for n in self.names]
        self._forget()

    def _forget(self):
        self.known = np.empty(0, np.int64)
        self.cost = np.empty((0, len(self.names)), np.float32)

    def run_costs(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, keys)
        found = np.zeros(len(keys), bool)
        if len(self.known):
            found = self.known[np.minimum(at, len(self.known) - 1)] == keys
        new = keys[~found]
        if len(new):
            fresh = np.stack([t.costs(new) for t in self.trees], 1).astype(np.float32)
            if len(self.known) + len(new) > REMEMBERED:
                self._forget()
                found[:] = False
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            self.cost = np.concatenate([self.cost, fresh])[order]
            self.known = known[order]
            if not found.any() and len(new) < len(keys):
                return np.stack([t.costs(keys) for t in self.trees], 1).astype(np.float32)
            at = np.searchsorted(self.known, keys)
        return self.cost[at]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.names)))
        keys, owner, start = _runs(texts)
        if len(keys):
            codes, distinct = pd.factorize(keys)
            cost = self.run_costs(distinct)
            for k in range(len(self.names)):
                per_byte = np.ascontiguousarray(cost[:, k])[codes].astype(np.float64)
                np.add.at(out[:, k], owner, np.add.reduceat(per_byte, start))
        return out


def _sample(known: DataFrame, rows: int) -> DataFrame:
    """At most `rows` whole texts of each language, by a hash of the id. A first cut by the hash
    lets about three times as many pass, so that few rows of a large table are put in order."""
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.shiftrightunsigned("h", 11) / F.lit(2.0**53)
    near = known.join(F.broadcast(sizes), "lang").filter(share * F.col("n") <= 3.0 * rows)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return near.withColumn("nth", nth).filter(F.col("nth") <= rows).select("lang", "text")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = SAMPLE_ROWS) -> Languages:
    """Trees of all languages of the rows with text and language, each on at most `rows` of them.
    Runs of bytes are counted by tasks and added up by Spark; the driver gets one row per
    different run of the bounded sample."""
    known = docs.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.lit(1), F.col(id_col)).alias("h"),
    ).filter("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                langs = np.array(piece.column("lang").to_pylist(), object)
                texts = np.array([t.encode() for t in piece.column("text").to_pylist()], object)
                for lang in set(langs):
                    keys, n = np.unique(_runs(list(texts[langs == lang]))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                        ["lang", "run", "n"],
                    )

    runs = _sample(known, rows).mapInArrow(count, "lang string, run bigint, n bigint")
    found = runs.groupBy("lang", "run").agg(F.sum("n").alias("n")).toPandas()
    return Languages(
        {lang: ContextTree(g["run"].to_numpy(), g["n"].to_numpy(np.float64))
         for lang, g in found.groupby("lang")}
    )


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1) and bits (code length of the text
    under lang_pred).

    Null texts and texts without a letter are 'und' with score 0 and no bits, and so is every
    text if no language was learned. Equal code lengths go to the language first in the alphabet.
    Null ids stay null, repeated rows are judged one by one, other columns are not read. An empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # bounded by the sample: see learn
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def judge(batches):
        model = shared.value
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                names, scores, bits = (["und"] * len(texts), [0.0] * len(texts),
                                       [None] * len(texts))
                good = [i for i, t in enumerate(texts) if model.names and any(map(str.isalpha, t))]
                lengths = model.lengths([texts[i].encode() for i in good])
                for i, row in zip(good, lengths, strict=True):
                    best = int(row.argmin())
                    names[i], bits[i] = model.names[best], float(row[best])
                    scores[i] = float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(names, pa.string()), pa.array(scores),
                     pa.array(bits, pa.float64())],
                    ["id", "lang_pred", "score", "bits"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        judge, f"id {kind}, lang_pred string, score double, bits double"
    ).withColumnRenamed("id", id_col)
