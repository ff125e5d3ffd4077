"""Language-model scores by a hierarchical Pitman-Yor model with sampled seating.

Tokens are words and one end per text. Every previous word met has a restaurant of its own (a
text's start is a previous word too); all context restaurants
have the unigram restaurant as parent, whose parent is uniform over the V words known and one
unknown. Customers of a context are its counts; its tables are customers of the parent. Gibbs
sweeps seat everybody anew given the other restaurants as the sweep before left them: a customer
opens a table with probability a / (a + n - d t), a = (strength + d tables) p(word in parent), for n
customers at t tables. The predictive probabilities of the sweeps after BURN_IN are averaged.

Distribution: pairs (word, context) live in parts by a hash of the word, so a sweep needs nothing
from other parts but the number of tables of each context and a few sums. Words that hold much of
the text (`hot`, at most HOT) are spread over the parts by their contexts; their sums, and those of
the contexts they make, go through the sweep's totals. Any other context has a home, the part of
its own word: the parts that hold pairs of it ask the home, which adds up what they say and
replies, once for the counts and once per sweep for the tables. A pair of one customer has one
table in any sweep, so sweeps ask for the other pairs only. A sweep is a pure function of the
pairs, the replies and totals before it and a seed, so no seating is stored: a task repeats the
sweeps it needs, on the same executor or another.

What moves between tasks are numpy arrays in binary columns, one row per block of documents and
part: each different word and context once, an index for the context and for the document of each
token. A token whose context its part does not hold is sent on to the context's home.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..operators.staging import stage
from .common import text_pieces

SWEEPS = 4
BURN_IN = 2
STRENGTH = 1.0
# A part holds about this many tokens.
PART_TOKENS = 1_000_000
# A task takes about this many parts, one after the other.
PARTS_PER_TASK = 2
# Words with more than 1 / HOT and pairs with more than 1 / HOT_PAIRS of all tokens are treated apart;
# there are fewer than HOT and HOT_PAIRS.
HOT = 10_000
HOT_PAIRS = 100_000
# Only where hot words are put depends on this sample, no result does.
HOT_SAMPLE_ROWS = 2_000
_BLOCK_TOKENS = 1_200_000
_BLOCK_TEXTS = 20_000
_GROUP_TOKENS = 100_000
_SUMS_HELD = 1_000_000
_SEGMENT = 1 << 16
_END, _START = np.uint64(1), np.uint64(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _context(word):
    """The restaurant of the tokens after a word: the word's whole hash."""
    return word


@cache
def _powers(size: int):
    steps = np.full(size + 1, _STEP)
    steps[0] = 1
    inverse = np.full(size + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    inverse[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(inverse)


def _word_hashes(text: bytes):
    """64-bit hash and start of each word of a lower-case text."""
    hashes, starts, at = [], [], 0
    while at < len(text):
        stop = min(at + _SEGMENT, len(text))
        while stop < len(text) and not _SPACE[text[stop]]:
            stop += 1
        raw = np.frombuffer(text, np.uint8, stop - at, at)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_SPACE[raw]
        start = np.flatnonzero(inside[1:] & ~inside[:-1])
        end = np.flatnonzero(inside[:-1] & ~inside[1:])
        powers, inverse = _powers(max(_SEGMENT, 1 << len(raw).bit_length()))
        sums = np.concatenate(
            [np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + 1) * powers[: len(raw)])]
        )
        hashes.append(_mixed((sums[end] - sums[start]) * inverse[start]))
        starts.append(start + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def token_arrays(texts: list[bytes]):
    """word, context and text number of every token, the ends included."""
    joined = b"\n".join(texts).translate(_LOWER)
    hashes, starts = _word_hashes(joined)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    first = np.searchsorted(starts, begins)
    counts = np.diff([*first, len(hashes)])
    text = np.repeat(np.arange(len(texts), dtype=np.uint32), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    word = np.empty(len(text), np.uint64)
    word[ends] = _END
    inner = np.ones(len(text), bool)
    inner[ends] = False
    word[inner] = hashes
    before = np.concatenate([[_START], word[:-1]])
    before[ends[:-1] + 1] = _START
    return word, _context(before), text


@dataclass
class Layout:
    """Where pairs live: the number of parts and the sorted hot words."""

    parts: int
    hot: np.ndarray
    hot_contexts: np.ndarray = field(init=False)

    def __post_init__(self):
        self.hot_contexts = np.union1d(_context(self.hot), np.array([_START]))

    @property
    def tasks(self) -> int:
        return max(12, math.ceil(self.parts / PARTS_PER_TASK))

    def hot_index(self, word: np.ndarray) -> np.ndarray:
        """Index among the hot words, or -1."""
        return _index(self.hot, word)

    def home(self, hashes: np.ndarray) -> np.ndarray:
        """The part of a word that is not hot, which is also the home of its context."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)

    def spread(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.home(_mixed(word + context * _STEP))

    def part(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """A hot word's pairs lie at the homes of their contexts, spread if these are hot too."""
        hot = self.hot_index(word) >= 0
        part = np.where(hot, self.home(context), self.home(word))
        both = hot & (_index(self.hot_contexts, context) >= 0)
        part[both] = self.spread(word[both], context[both])
        return part


def _index(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index in the sorted known values, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _runs(sorted_values: np.ndarray):
    """Different values of a sorted array and the number of each."""
    if not len(sorted_values):
        return sorted_values, np.empty(0, np.uint32)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[first], np.diff([*first, len(sorted_values)]).astype(np.uint32)


@dataclass
class Block:
    """Tokens of some texts: the different words (and the start), sorted; of each token the indices
    of word and previous word and the text's number; the keys of the texts."""

    words: np.ndarray
    word: np.ndarray
    before: np.ndarray
    text: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(held: list[tuple], keys: list) -> Block:
        """The texts are numbered in the order of their keys."""
        word, text = map(np.concatenate, zip(*held, strict=True))
        keys = np.array(keys, np.int64)
        by = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.uint32)
        rank[by] = np.arange(len(keys))
        keys, text = keys[by], rank[text]
        words, index = _numbered(np.append(word, _START))
        start, index = index[-1], index[:-1]
        before = np.empty_like(index)
        before[1:] = index[:-1]
        before[np.concatenate([[True], text[1:] != text[:-1]])] = start
        return Block(words, index, before, text, keys)

    def take(self, at: np.ndarray) -> Block:
        return Block(self.words, self.word[at], self.before[at], self.text[at], self.keys)

    def hot(self, layout: Layout):
        """Which tokens are hot words after hot words, and the index of each different word among
        the hot contexts."""
        contexts = _index(layout.hot_contexts, _context(self.words))
        words = layout.hot_index(self.words) >= 0
        return words[self.word] & (contexts >= 0)[self.before], contexts

    def sorted_by_part(self, layout: Layout, both: np.ndarray):
        """Part of each token and the block, in the order of part, word and previous word."""
        home, hot = layout.home(self.words), layout.hot_index(self.words) >= 0
        part = home[np.where(hot[self.word], self.before, self.word)]
        words = self.words[self.word[both]], _context(self.words[self.before[both]])
        part[both] = layout.spread(*words)
        bits, low = len(self.words).bit_length(), len(self.keys).bit_length()
        if layout.parts.bit_length() + 2 * bits + low > 64:
            order = np.lexsort((self.text, self.before, self.word, part))
            return part[order], self.take(order)
        # one number per token, sorted and taken apart again
        key = part.astype(np.uint64)
        for width, column in ((bits, self.word), (bits, self.before), (low, self.text)):
            key = key << np.uint64(width) | column.astype(np.uint64)
        key.sort()
        columns = []
        for width in (low, bits, bits):
            columns.append((key & np.uint64((1 << width) - 1)).astype(np.int64))
            key >>= np.uint64(width)
        text, before, word = columns
        return key.astype(np.int32), Block(self.words, word, before, text, self.keys)

    def coded(self, own: slice, contexts: np.ndarray, n_hot: int):
        """Context of each token of the slice as an index among the n_hot hot contexts and, after
        them, the other contexts of the slice; these, sorted."""
        code = contexts[self.before[own]]
        cold = code < 0
        other, index = np.unique(self.before[own][cold], return_inverse=True)
        code[cold] = n_hot + index
        return code.astype(np.uint32), _context(self.words[other])


def _numbered(values: np.ndarray):
    """The different values, sorted, and the index of each value among them."""
    low = np.uint64(len(values).bit_length())
    places = np.sort(values >> low << low | np.arange(len(values), dtype=np.uint64))
    order = (places & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    known = ordered[new]
    if (known[1:] <= known[:-1]).any():  # two values differ in their last bits only
        return np.unique(values, return_inverse=True)
    index = np.empty(len(values), np.int64)
    index[order] = np.cumsum(new) - 1
    return known, index


def _blocks(batches: Iterator[pa.RecordBatch], copies: bool) -> Iterator[Block]:
    """Without copies, a text that comes again in a block is left out."""
    held, keys, seen, size = [], [], set(), 0
    for batch in batches:
        for piece in text_pieces(batch, "text"):
            texts, fresh = [], []
            for key, text in zip(piece.column("key").to_pylist(), piece.column("text").to_pylist(),
                                 strict=True):
                if copies or key not in seen:
                    seen.add(key)
                    fresh.append(key)
                    texts.append((text or "").encode())
            if not texts:
                continue
            word, _, text = token_arrays(texts)
            held.append((word, text + np.uint32(len(keys))))
            keys += fresh
            size += len(word)
            if size >= _BLOCK_TOKENS or len(keys) >= _BLOCK_TEXTS:
                yield Block.of(held, keys)
                held, keys, seen, size = [], [], set(), 0
    if held:
        yield Block.of(held, keys)


# Kinds of rows, in the order in which a part reads them. Columns hold packed arrays:
# PAIRS    words, number of pairs of each, contexts (coded), the contexts not hot, customers;
#          contexts not hot are in `cold`, or in `own` as an index into words
# MULTI    the same of the pairs with several customers; for words the index among the hot ones,
#          texts: pairs of one customer of each word, keys: place of the contexts in those of PAIRS
# REPLY    of a home (`other`) in a step: counts, texts: customers and tables of the contexts of the
#          part that live there (step 0) or counts: tables more than at the start (MULTI only)
# SAMPLE   as REPLY of a later step, for all contexts of PAIRS
# HOMES    the same at the home, for the contexts `cold`
# ASKED    at the home, words: which of these a part (`other`) has in PAIRS
# TOKENS   as PAIRS, with text (index into keys) of each token
# DIRECT   counts: four sums of each text in keys;  SUMS: the same
# UNSEEN   tokens by context: `cold` and runs, text, counts: word's probability in each sample
# ASK      as HOMES, what one part (`other`) has to say;  TOTALS: see _totals
(PAIRS, MULTI, REPLY, SAMPLE, HOMES, ASKED, TOKENS, DIRECT, SUMS, UNSEEN, ASK,
 TOTALS) = range(12)
_NAMES = ["part", "kind", "step", "other", "words", "runs", "contexts", "cold", "counts", "texts",
          "keys", "own"]
_ROW = ", ".join(f"{n} {'int' if i < 4 else 'binary'}" for i, n in enumerate(_NAMES))


def _pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of an array, compressed: first bytes of all values, second bytes and so on; of the
    differences if the values rise."""
    if not len(values):
        return b""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    if values.dtype.kind in "iu" and values.min() >= 0:
        values = values.astype(np.min_scalar_type(values.max()))
    width = values.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    packed = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return width.to_bytes(1, "little") + len(values).to_bytes(7, "little") + packed


def _length(packed: bytes | None) -> int:
    return int.from_bytes(packed[1:8], "little") if packed else 0


def _unpack(packed: bytes | None, kind, rising: bool = False) -> np.ndarray:
    if not packed:
        return np.empty(0, kind)
    size, width, kind = _length(packed), packed[0], np.dtype(kind)
    planes = pa.decompress(packed[8:], size * width, codec="zstd", asbytes=True)
    planes = np.frombuffer(planes, np.uint8).reshape(width, size)
    # narrower than their kind are numbers from 0 on
    stored = kind if width == kind.itemsize else np.dtype(f"u{width}")
    values = np.ascontiguousarray(planes.T).view(stored).ravel().astype(kind, copy=False)
    return np.cumsum(values, dtype=kind) if rising else values


def _pack_cold(words: np.ndarray, cold: np.ndarray) -> dict[str, bytes]:
    """Columns of sorted contexts that are not hot: a hash that is among the words by its index."""
    at = _index(words, cold)
    return {"cold": _pack(cold[at < 0], True), "own": _pack(at[at >= 0], True)}


def _cold_of(row: dict, words: np.ndarray) -> np.ndarray:
    own = words[_unpack(row.get("own"), np.int64, True)]
    return np.sort(np.append(_unpack(row.get("cold"), np.uint64, True), own))


def _row(part: int, kind: int, step: int = 0, other: int = 0, **arrays: bytes) -> tuple:
    return int(part), kind, step, int(other), *(arrays.get(name) for name in _NAMES[4:])


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 8
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES
    )


def _slices(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each different value of a sorted array and where it lies."""
    at = 0
    for value, size in zip(*_runs(sorted_values), strict=True):
        yield int(value), slice(at, at + int(size))
        at += int(size)


def _by_part(batches: Iterator[pa.RecordBatch]):
    """(part, rows of the part one by one) from batches sorted by part."""
    part, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["part"] != part:
                if rows:
                    yield part, rows
                part, rows = row["part"], []
            rows.append(row)
    if rows:
        yield part, rows


def _met(rows: DataFrame, layout: Layout) -> DataFrame:
    return rows.repartition(layout.tasks, "part").sortWithinPartitions("part", "kind")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), text.alias("text"))


def plan_layout(docs: DataFrame, text_col: str) -> Layout:
    """Number of parts and hot words, from a sample that decides only where things are put."""
    n = docs.count()
    every = max(1, n // HOT_SAMPLE_ROWS)
    sample = _texts(docs, text_col).filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0)

    def count(batches):
        for block in _blocks(batches, True):
            n_each = np.bincount(block.word, minlength=len(block.words))
            words, n_each = block.words[n_each > 0], n_each[n_each > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(n_each)], ["word", "n"]
            )

    # about HOT_SAMPLE_ROWS texts
    counted = sample.limit(2 * HOT_SAMPLE_ROWS).mapInArrow(count, "word bigint, n bigint")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.filter(F.col("n") * HOT > total).select("word").collect()
    tokens = total * every
    return Layout(
        max(12, math.ceil(tokens / PART_TOKENS)),
        np.sort(np.array([r["word"] for r in hot], np.int64).view(np.uint64)),
    )


def count_pairs(docs: DataFrame, text_col: str, layout: Layout) -> DataFrame:
    """One row per part: its words, how many contexts each has, the contexts and their counts."""

    def count(batches):
        for block in _blocks(batches, True):
            both, contexts = block.hot(layout)
            part, block = block.sorted_by_part(layout, both)
            new = np.ones(len(part), bool)
            new[1:] = ((block.word[1:] != block.word[:-1]) | (part[1:] != part[:-1])
                       | (block.before[1:] != block.before[:-1]))
            first = np.flatnonzero(new)
            n = np.diff([*first, len(part)]).astype(np.int64)
            part, block = part[first], block.take(first)
            rows = []
            for p, own in _slices(part):
                words, runs = _runs(block.words[block.word[own]])
                code, cold = block.coded(own, contexts, len(layout.hot_contexts))
                rows.append(_row(p, PAIRS, words=_pack(words, True), runs=_pack(runs),
                                 contexts=_pack(code), counts=_pack(n[own]),
                                 **_pack_cold(words, cold)))
            yield _messages(rows)

    def merge(batches):
        hot = layout.hot_contexts
        for part, rows in _by_part(batches):
            found = [_pairs_of(row) for row in rows]
            word = np.concatenate([np.repeat(w, runs) for w, runs, _, _, _ in found])
            context = np.concatenate([np.append(hot, cold)[code] for _, _, code, cold, _ in found])
            n = np.concatenate([counts for _, _, _, _, counts in found])
            words, index = np.unique(word, return_inverse=True)
            code = _index(hot, context)
            other, place = np.unique(context[code < 0], return_inverse=True)
            code[code < 0] = len(hot) + place
            key = index.astype(np.int64) << 32 | code
            order = np.argsort(key)
            key, first = np.unique(key[order], return_index=True)
            runs = np.bincount(key >> 32, minlength=len(words)).astype(np.uint32)
            code = (key & 0xFFFFFFFF).astype(np.uint32)
            yield _messages([_row(part, PAIRS, words=_pack(words, True), runs=_pack(runs),
                                  contexts=_pack(code), **_pack_cold(words, other),
                                  counts=_pack(np.add.reduceat(n[order], first)))])

    sent = _texts(docs, text_col).mapInArrow(count, _ROW)
    return stage(_met(sent, layout).mapInArrow(merge, _ROW), "pairs")


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng) -> np.ndarray:
    """Number of tables after seating each group of customers, one after the other. Beyond 256
    customers they come in steps of 1/64 of those seated, with one probability per step."""
    tables = np.ones(len(customers), np.int64)
    by = np.argsort(-customers, kind="stable")
    by = by[: np.searchsorted(-customers[by], -1)]  # more than one customer
    sizes, seated = customers[by], 1
    t, a = np.ones(len(by)), opening[by]
    while len(sizes) and sizes[0] > seated:
        active = int(np.searchsorted(-sizes, -seated))  # groups with more than `seated`
        step = 1 if seated < 256 else seated // 64
        p = a[:active] / (a[:active] + seated - discount * t[:active])
        if step == 1:
            t[:active] += rng.random(active) < p
        else:
            t[:active] += rng.binomial(np.minimum(sizes[:active] - seated, step), p)
        seated += step
    tables[by] = t
    return tables


@dataclass
class Totals:
    """What a sweep leaves for all parts: tables per context, customers and tables of the parent,
    and customers and tables there of the hot words."""

    tables: np.ndarray
    customers1: float
    tables1: float
    hot_customers1: np.ndarray
    hot_tables1: np.ndarray


@dataclass
class Fixed:
    """Counts and parameters that no sweep changes."""

    context_counts: np.ndarray
    hot_counts: np.ndarray
    tokens: int
    words: int
    discount: float
    discount1: float

    @property
    def uniform(self) -> float:
        return 1 / (self.words + 1)


class Seating:
    """The pairs of a part that have several customers, and how many others each word has."""

    def __init__(self, number: int, hot: np.ndarray, singles: np.ndarray, runs: np.ndarray,
                 contexts: np.ndarray, counts: np.ndarray, n_hot: int):
        self.number, self.hot, self.singles, self.runs = number, hot, singles, runs
        self.contexts, self.counts = contexts, counts
        self.of_word = np.repeat(np.arange(len(hot)), runs)
        # pairs of a hot word and a hot context, seated without replies of any home
        self.both_hot = (hot[self.of_word] >= 0) & (contexts < n_hot)

    def parent(self, customers1, tables1, fixed: Fixed, totals: Totals) -> np.ndarray:
        """Probability of each word in the unigram restaurant."""
        hot = self.hot >= 0
        c, t = customers1.astype(float), tables1.astype(float)
        c[hot], t[hot] = totals.hot_customers1[self.hot[hot]], totals.hot_tables1[self.hot[hot]]
        opening = STRENGTH + fixed.discount1 * totals.tables1
        below = c - fixed.discount1 * t + opening * fixed.uniform
        return below / (STRENGTH + totals.customers1)

    def sweeps(self, fixed: Fixed | None, past: list[Totals], cold: list[np.ndarray], seed: int):
        """Yields (tables of each pair, customers and tables of each word in the parent) at the
        start and after each sweep for which there are totals, and tables of the other contexts,
        before it."""
        tables = np.ones(len(self.counts), np.int64)
        customers1 = self.singles + self.runs
        tables1 = np.ones(len(self.hot), np.int64)
        yield tables, customers1, tables1
        for number, totals in enumerate(past):
            p = self.parent(customers1, tables1, fixed, totals)
            known = np.append(totals.tables, cold[number])
            opening = (STRENGTH + fixed.discount * known)[self.contexts] * p[self.of_word]
            tables = np.ones(len(self.counts), np.int64)
            for group, own in enumerate((self.both_hot, ~self.both_hot)):
                rng = np.random.default_rng([seed, number, self.number, group])
                tables[own] = seat(self.counts[own], opening[own], fixed.discount, rng)
            sums = np.bincount(self.of_word, tables, len(self.hot)).astype(np.int64)
            customers1 = self.singles + sums
            opening1 = (STRENGTH + fixed.discount1 * totals.tables1) * fixed.uniform
            rng = np.random.default_rng([seed, number, self.number, 2])
            tables1 = seat(customers1, np.full(len(self.hot), opening1), fixed.discount1, rng)
            yield tables, customers1, tables1


class Replies:
    """What the homes told a part about its contexts that are not hot: customers of each; tables at
    the start and after each sweep of those in `places`, which have pairs of several customers
    here; tables of all of them in the samples."""

    def __init__(self, rows: list[dict], places: np.ndarray, steps: int):
        self.said: dict[tuple, list[dict]] = {}
        for row in sorted(rows, key=lambda r: r["other"]):
            self.said.setdefault((row["kind"], row["step"]), []).append(row)
        self.counts, self.first = self.column(REPLY, 0, "counts"), self.column(REPLY, 0, "texts")
        later = (self.column(REPLY, step, "counts") for step in range(1, steps))
        self.tables = [self.first[places], *(self.first[places] + more for more in later)]

    def column(self, kind: int, step: int, name: str) -> np.ndarray:
        said = (_unpack(row[name], np.int64) for row in self.said.get((kind, step), []))
        return np.concatenate([np.empty(0, np.int64), *said])

    def sample(self, step: int) -> np.ndarray:
        return self.first + self.column(SAMPLE, step, "counts")


def _pairs_of(row: dict):
    """words, number of pairs of each, coded contexts, the contexts not hot, customers."""
    words = _unpack(row.get("words"), np.uint64, True)
    return (
        words,
        _unpack(row.get("runs"), np.uint32).astype(np.int64),
        _unpack(row.get("contexts"), np.uint32).astype(np.int64),
        _cold_of(row, words),
        _unpack(row.get("counts"), np.int64),
    )


class Part:
    """The pairs of one part, what homes said of their contexts, and the seating."""

    def __init__(self, row: dict, layout: Layout, replies: list[dict] | None = None):
        self.number, self.layout, self.replies = row["part"], layout, replies or []
        self.words, self.runs, self.contexts, self.cold, self.counts = _pairs_of(row)
        self.hot = layout.hot_index(self.words)
        self.of_word = np.repeat(np.arange(len(self.words)), self.runs)
        n_hot = len(layout.hot_contexts)
        self.multi = np.flatnonzero(self.counts > 1)
        code = self.contexts[self.multi]
        cold = code >= n_hot
        self.places, index = np.unique(code[cold] - n_hot, return_inverse=True)
        code[cold] = n_hot + index
        runs = np.bincount(self.of_word[self.multi], minlength=len(self.words))
        self.seating = Seating(self.number, self.hot, self.runs - runs, runs, code,
                               self.counts[self.multi], n_hot)

    def code_of_cold(self, contexts: np.ndarray) -> np.ndarray:
        at = _index(self.cold, contexts)
        return np.where(at >= 0, at + len(self.layout.hot_contexts), -1)

    def code(self, contexts: np.ndarray) -> np.ndarray:
        """Index among the hot contexts and, after them, the part's others; or -1."""
        at = _index(self.layout.hot_contexts, np.atleast_1d(contexts))
        return np.where(at >= 0, at, self.code_of_cold(np.atleast_1d(contexts)))

    def only_hot(self) -> Part:
        """The pairs of hot words and hot contexts."""
        own = (self.hot[self.of_word] >= 0) & (self.contexts < len(self.layout.hot_contexts))
        words, runs = _runs(self.words[self.of_word[own]])
        row = {"part": self.number, "words": _pack(words, True), "runs": _pack(runs),
               "contexts": _pack(self.contexts[own].astype(np.uint32)),
               "counts": _pack(self.counts[own])}
        return Part(row, self.layout)


_CONTEXT_TABLES, _CONTEXT_COUNTS, _HOT_CUSTOMERS, _HOT_COUNTS, _SUM = range(5)
_CUSTOMERS1, _TABLES1, _TOKENS, _WORDS, _ONCE, _TWICE, _ONCE1, _TWICE1 = range(8)


def _totals(part: int, arrays: list[np.ndarray]) -> tuple:
    """Row of sums: of the hot contexts and hot words, and the eight single ones."""
    return _row(part, TOTALS, **{n: _pack(np.asarray(a, float)) for n, a in
                                 zip(_NAMES[4:], arrays, strict=False)})


def _no_totals(layout: Layout) -> list[np.ndarray]:
    n_contexts, n_hot = len(layout.hot_contexts), len(layout.hot)
    return [np.zeros(n) for n in (n_contexts, n_contexts, n_hot, n_hot, 8)]


def _asks(layout: Layout, step: int, number: int, cold: np.ndarray, *columns: np.ndarray):
    for home, own in _slices(layout.home(cold)):
        said = zip(("counts", "texts"), columns, strict=False)
        yield _row(home, ASK, step, number, cold=_pack(cold[own], True),
                   **{name: _pack(column[own].astype(np.int64)) for name, column in said})


def _start(layout: Layout):
    """Task that says what the pairs of its parts hold, everybody at a table of each pair."""

    def start(batches):
        n_hot = len(layout.hot_contexts)
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch.slice(i, 1).to_pylist()[0], layout)
                seating = part.seating
                counts = np.bincount(part.contexts, part.counts, n_hot + len(part.cold))
                tables = np.bincount(part.contexts, minlength=n_hot + len(part.cold))
                of_word = np.bincount(part.of_word, part.counts, len(part.words))
                hot, own = part.hot >= 0, part.hot < 0
                sums = _no_totals(layout)
                sums[_CONTEXT_TABLES] += tables[:n_hot]
                sums[_CONTEXT_COUNTS] += counts[:n_hot]
                np.add.at(sums[_HOT_CUSTOMERS], part.hot[hot], part.runs[hot])
                np.add.at(sums[_HOT_COUNTS], part.hot[hot], of_word[hot])
                sums[_SUM] += [
                    part.runs[own].sum(), own.sum(), part.counts.sum(), own.sum(),
                    (part.counts == 1).sum(), (part.counts == 2).sum(),
                    (part.runs[own] == 1).sum(), (part.runs[own] == 2).sum(),
                ]
                multi = _row(
                    part.number, MULTI, words=_pack(part.hot.astype(np.int32)),
                    runs=_pack(seating.runs.astype(np.uint32)),
                    contexts=_pack(seating.contexts.astype(np.uint32)),
                    cold=_pack(part.cold[part.places], True), counts=_pack(seating.counts),
                    texts=_pack(seating.singles.astype(np.uint32)),
                    keys=_pack(part.places.astype(np.uint32), True),
                )
                asks = _asks(layout, 0, part.number, part.cold, counts[n_hot:], tables[n_hot:])
                yield _messages([multi, *asks, _totals(part.number, sums)])

    return start


def _sweep(layout: Layout, fixed: Fixed, past: list[Totals], seed: int):
    """Task that says how many tables its parts have more than at the start after len(past)
    sweeps."""

    def sweep(batches):
        n_hot = len(layout.hot_contexts)
        for number, rows in _by_part(batches):
            multi = rows[0]
            if multi["kind"] != MULTI:
                continue
            whole = [_unpack(multi[name], np.uint32).astype(np.int64)
                     for name in ("texts", "runs", "contexts")]
            hot = _unpack(multi["words"], np.int32)
            seating = Seating(number, hot, *whole, _unpack(multi["counts"], np.int64), n_hot)
            cold = _unpack(multi["cold"], np.uint64, True)
            places = _unpack(multi["keys"], np.uint32, True)
            replies = Replies(rows[1:], places, len(past))
            *_, (tables, customers1, tables1) = seating.sweeps(fixed, past, replies.tables, seed)
            more = np.bincount(seating.contexts, tables - 1, n_hot + len(cold))
            sums = _no_totals(layout)
            sums[_CONTEXT_TABLES] += more[:n_hot]
            np.add.at(sums[_HOT_CUSTOMERS], hot[hot >= 0], customers1[hot >= 0])
            sums[_SUM][_CUSTOMERS1] = customers1[hot < 0].sum()
            sums[_SUM][_TABLES1] = tables1[hot < 0].sum()
            asks = _asks(layout, len(past), number, cold, more[n_hot:])
            yield _messages([*asks, _totals(number, sums)])

    return sweep


def _exchange(rows: DataFrame, layout: Layout) -> DataFrame:
    """Homes add up what parts say of a context and reply to each of them. Rows of MULTI go
    through, those of TOTALS are added up in each task."""

    def meet(batches):
        sums = _no_totals(layout)
        for home, rows in _by_part(batches):
            out = [tuple(r[name] for name in _NAMES) for r in rows if r["kind"] == MULTI]
            for row in rows:
                if row["kind"] == TOTALS:
                    for total, name in zip(sums, _NAMES[4:], strict=False):
                        total += _unpack(row[name], float)
            asks = [r for r in rows if r["kind"] == ASK]
            if asks:
                cold = [_unpack(r["cold"], np.uint64, True) for r in asks]
                known, index = np.unique(np.concatenate(cold), return_inverse=True)
                ends, step, columns = np.cumsum([len(c) for c in cold])[:-1], asks[0]["step"], {}
                for name in ("counts", "texts") if step == 0 else ("counts",):
                    said = np.concatenate([_unpack(r[name], np.int64) for r in asks])
                    columns[name] = np.bincount(index, said).astype(np.int64)
                out.append(_row(home, HOMES, step, cold=_pack(known, True),
                                **{name: _pack(c) for name, c in columns.items()}))
                for row, own in zip(asks, np.split(index, ends), strict=True):
                    if step == 0:
                        asked = _pack(own.astype(np.uint32), True)
                        out.append(_row(home, ASKED, other=row["other"], words=asked))
                    out.append(_row(row["other"], REPLY, step, home,
                                    **{name: _pack(c[own]) for name, c in columns.items()}))
            if out:
                yield _messages(out)
        yield _messages([_totals(-1, sums)])

    return stage(_met(rows, layout).mapInArrow(meet, _ROW), "replies")


def _samples(said: DataFrame, layout: Layout, steps: range) -> DataFrame:
    """Homes tell every part that has a context its tables in the samples."""

    def tell(batches):
        for home, rows in _by_part(batches):
            known, _, more = _at_home([r for r in rows if r["kind"] == HOMES])
            none = np.zeros(len(known), np.int64)
            for row in rows:
                if row["kind"] == ASKED:
                    own = _unpack(row["words"], np.uint32, True)
                    yield _messages([
                        _row(row["other"], SAMPLE, step, home,
                             counts=_pack(more.get(step, none)[own]))
                        for step in steps
                    ])

    homes = _of_kinds(said, HOMES).filter((F.col("step") == 0) | (F.col("step") > BURN_IN))
    rows = _met(homes.unionByName(_of_kinds(said, ASKED)), layout)
    return stage(rows.mapInArrow(tell, _ROW), "samples")


def _at_home(rows: list[dict]):
    """Contexts of a home, customers and tables of each at the start, and, for each sample, how many
    tables it has more."""
    start = next(row for row in rows if row["step"] == 0)
    known = _unpack(start["cold"], np.uint64, True)
    first = tuple(_unpack(start[name], np.int64) for name in ("counts", "texts"))
    more = {row["step"]: np.zeros(len(known), np.int64) for row in rows if row["step"]}
    for row in rows:
        if row["step"]:
            at = _index(known, _unpack(row["cold"], np.uint64, True))
            more[row["step"]][at] = _unpack(row["counts"], np.int64)
    return known, first, more


def _of_kinds(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds))


def _found(exchanged: DataFrame, layout: Layout) -> list[np.ndarray]:
    """Sums over all parts: at most 4 HOT + 10 rows."""

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for kind, name in enumerate(_NAMES[4:9]):
                    column = _unpack(row[name], float)
                    at = np.flatnonzero(column)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), kind)), pa.array(at), pa.array(column[at])],
                        ["kind", "id", "value"],
                    )

    partial = _of_kinds(exchanged, TOTALS).mapInArrow(
        spread, "kind bigint, id bigint, value double"
    )
    rows = partial.groupBy("kind", "id").agg(F.sum("value").alias("value")).toPandas()
    found = _no_totals(layout)
    for kind, column in enumerate(found):
        own = rows[rows["kind"] == kind]
        column[own["id"].to_numpy(np.int64)] = own["value"].to_numpy()
    return found


def _discount(once: float, twice: float) -> float:
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


@dataclass
class Model:
    """pairs: table of all parts; said: what homes replied, and hold; past: the totals at the start
    and after each sweep; heavy: the pairs of hot words and contexts with more than 1/HOT_PAIRS of
    all tokens (sorted ids, log10 probability, log10 base)."""

    pairs: DataFrame
    said: DataFrame
    layout: Layout
    fixed: Fixed
    past: list[Totals]
    heavy: tuple[np.ndarray, np.ndarray, np.ndarray]
    seed: int


def _pair_id(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return _mixed(word ^ _mixed(context + np.uint64(1)))


class Back:
    """Share of each context of a part that goes to its parent."""

    def __init__(self, part: Part, values: np.ndarray):
        self.part, self.values = part, values

    def __getitem__(self, contexts):
        return self.values[self.part.code(contexts)]


class Scores:
    """Averaged predictive probabilities for the words of a part."""

    def __init__(self, part: Part, layout: Layout, fixed: Fixed, past: list[Totals], seed: int):
        self.part, self.fixed, self.layout = part, fixed, layout
        seating, replies = part.seating, Replies(part.replies, part.places, len(past) - 1)
        scale = STRENGTH + np.append(fixed.context_counts, replies.counts)
        hot = part.hot >= 0
        count = np.bincount(part.of_word, part.counts, len(part.words))
        count[hot] = fixed.hot_counts[part.hot[hot]]
        denominator = fixed.tokens + fixed.words + 1
        self.base = np.log10((count + 1) / denominator)
        self.hot_base = np.log10((fixed.hot_counts + 1) / denominator)
        self.unknown_base = -math.log10(denominator)
        # per sample: share of a context that goes to its parent, probability in the parent
        self.back, self.parent, self.unknown, self.hot_parent = [], [], [], []
        total = np.zeros(len(part.contexts))
        samples = past[BURN_IN + 1 :]
        for number, state in enumerate(seating.sweeps(fixed, past[:-1], replies.tables, seed)):
            if number <= BURN_IN:
                continue
            several, customers1, tables1 = state
            tables = np.ones(len(part.contexts), np.int64)
            tables[part.multi] = several
            totals = past[number]
            of_context = np.append(totals.tables, replies.sample(number))
            back = (STRENGTH + fixed.discount * of_context) / scale
            p = seating.parent(customers1, tables1, fixed, totals)
            own = (part.counts - fixed.discount * tables) / scale[part.contexts]
            total += own + back[part.contexts] * p[part.of_word]
            self.back.append(Back(part, back))
            self.parent.append(p)
            opening = STRENGTH + fixed.discount1 * totals.tables1
            below = opening * fixed.uniform
            self.unknown.append(below / (STRENGTH + totals.customers1))
            seated = totals.hot_customers1 - fixed.discount1 * totals.hot_tables1
            self.hot_parent.append((seated + below) / (STRENGTH + totals.customers1))
        self.known_pairs = np.log10(total / max(len(samples), 1)) if len(total) else total
        self.pair_keys = part.of_word.astype(np.int64) << 32 | part.contexts

    def look_up(self, words: np.ndarray, runs: np.ndarray, contexts: np.ndarray):
        """of_codes() for contexts that are hot or the part's."""
        return self.of_codes(words, runs, self.part.code(contexts))

    def of_codes(self, words: np.ndarray, runs: np.ndarray, code: np.ndarray):
        """log10 probability, log10 base and whether the word is known, of each token, and its
        probability in the parent in each sample. A token of a context that is neither hot nor the
        part's (code -1) gets 0 for the first."""
        own, n = self.part.words, len(self.back)
        at = np.minimum(np.searchsorted(own, words), max(len(own) - 1, 0))
        here = own[at] == words if len(own) else np.zeros(len(words), bool)
        # a hot word may have its pairs in other parts only
        hot = self.layout.hot_index(words)
        elsewhere = ~here & (hot >= 0)
        elsewhere[elsewhere] = self.fixed.hot_counts[hot[elsewhere]] > 0
        base = np.full(len(words), self.unknown_base)
        base[here], base[elsewhere] = self.base[at[here]], self.hot_base[hot[elsewhere]]
        parents = []
        for p, p_hot, p_unknown in zip(self.parent, self.hot_parent, self.unknown, strict=True):
            parent = np.full(len(words), p_unknown)
            parent[here], parent[elsewhere] = p[at[here]], p_hot[hot[elsewhere]]
            parents.append(np.repeat(parent, runs))
        word, is_here = np.repeat(at, runs), np.repeat(here, runs)
        base, is_known = np.repeat(base, runs), np.repeat(here | elsewhere, runs)
        mean = sum(b.values[code] * p for b, p in zip(self.back, parents, strict=True)) / n
        score = np.where(code >= 0, np.log10(mean), 0.0)
        if len(self.pair_keys):
            key = word.astype(np.int64) << 32 | code
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = is_here & (self.pair_keys[place] == key)  # not for code -1
            score[hit] = self.known_pairs[place[hit]]
        return score, base, is_known, parents


def fit(docs: DataFrame, text_col: str = "text", sweeps: int = SWEEPS, seed: int = 5) -> Model:
    """Learns from all rows of docs; null texts are empty texts, an end alone."""
    if sweeps <= BURN_IN:
        raise ValueError(f"more than {BURN_IN} sweeps are needed")
    layout = plan_layout(docs, text_col)
    pairs = count_pairs(docs, text_col, layout)
    started = _exchange(pairs.mapInArrow(_start(layout), _ROW), layout)
    multi, said = _of_kinds(started, MULTI), _of_kinds(started, REPLY, HOMES, ASKED)
    found = _found(started, layout)
    sums = found[_SUM]
    fixed = Fixed(
        context_counts=found[_CONTEXT_COUNTS],
        hot_counts=found[_HOT_COUNTS],
        tokens=int(sums[_TOKENS]),
        words=int(sums[_WORDS] + (found[_HOT_COUNTS] > 0).sum()),
        discount=_discount(sums[_ONCE], sums[_TWICE]),
        discount1=_discount(sums[_ONCE1], sums[_TWICE1]),
    )
    past: list[Totals] = []
    for number in range(sweeps + 1):
        if number:
            met = _met(multi.unionByName(_of_kinds(said, REPLY)), layout)
            swept = _exchange(met.mapInArrow(_sweep(layout, fixed, past, seed), _ROW), layout)
            said = said.unionByName(_of_kinds(swept, REPLY, HOMES))
            found = _found(swept, layout)
            found[_CONTEXT_TABLES] += past[0].tables
        hot = found[_HOT_CUSTOMERS]
        hot_tables = (hot > 0).astype(float)
        if past:
            opening1 = (STRENGTH + fixed.discount1 * past[-1].tables1) * fixed.uniform
            rng = np.random.default_rng([seed, number, 1 << 31])
            hot_tables *= seat(hot.astype(np.int64), np.full(len(hot), opening1),
                               fixed.discount1, rng)
        past.append(
            Totals(found[_CONTEXT_TABLES], found[_SUM][_CUSTOMERS1] + hot.sum(),
                   found[_SUM][_TABLES1] + hot_tables.sum(), hot, hot_tables)
        )
    said = said.unionByName(_samples(said, layout, range(BURN_IN + 1, sweeps + 1)))
    heavy = _heavy_pairs(pairs, layout, fixed, past, seed)
    return Model(pairs, said, layout, fixed, past, heavy, seed)


def _heavy_pairs(pairs, layout, fixed, past, seed):
    """Pairs of hot words and contexts with more than 1/HOT_PAIRS of all tokens: ids,
    scores, bases."""

    def pick(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch.slice(i, 1).to_pylist()[0], layout).only_hot()
                at = np.flatnonzero(part.counts * HOT_PAIRS > fixed.tokens)
                if not len(at):
                    continue
                scores = Scores(part, layout, fixed, past, seed)
                word = part.of_word[at]
                ids = _pair_id(part.words[word], layout.hot_contexts[part.contexts[at]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64)), pa.array(scores.known_pairs[at]),
                     pa.array(scores.base[word])],
                    ["id", "score", "base"],
                )

    rows = pairs.mapInArrow(pick, "id bigint, score double, base double").toPandas()
    ids = rows["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ids)
    return ids[order], rows["score"].to_numpy()[order], rows["base"].to_numpy()[order]


def _send(model: Model):
    """Task that sends the tokens of documents to the parts of their pairs. Heavy pairs are
    answered on the spot; what they add up to goes to a part chosen by the text's key."""
    layout, (heavy, heavy_score, heavy_base) = model.layout, model.heavy

    def send(batches):
        for block in _blocks(batches, False):
            text, keys, n = block.text, block.keys, len(block.keys)
            both, contexts = block.hot(layout)
            hit = np.flatnonzero(both)
            ids = _pair_id(block.words[block.word[hit]], _context(block.words[block.before[hit]]))
            place = _index(heavy, ids)
            hit, place = hit[place >= 0], place[place >= 0]
            owner = text[hit]
            direct = np.stack([
                np.bincount(text, minlength=n), np.bincount(owner, minlength=n),
                np.bincount(owner, heavy_base[place], n), np.bincount(owner, heavy_score[place], n),
            ], 1).astype(np.float64)  # bincount of nothing is of integers
            home = layout.home(_mixed(keys.view(np.uint64)))
            by = np.argsort(home, kind="stable")
            rows = [
                _row(p, DIRECT, counts=_pack(direct[by[own]].T.ravel()),
                     keys=_pack(keys[by[own]], True))
                for p, own in _slices(home[by])
            ]
            rest = np.ones(len(text), bool)
            rest[hit] = False
            part, block = block.take(rest).sorted_by_part(layout, both[rest])
            for p, own in _slices(part):
                words, runs = _runs(block.words[block.word[own]])
                code, cold = block.coded(own, contexts, len(layout.hot_contexts))
                here = np.bincount(block.text[own], minlength=n) > 0
                index, present = (np.cumsum(here) - 1)[block.text[own]], np.flatnonzero(here)
                rows.append(_row(p, TOKENS, words=_pack(words, True), runs=_pack(runs),
                                 contexts=_pack(code), **_pack_cold(words, cold),
                                 texts=_pack(index), keys=_pack(keys[present], True)))
            yield _messages(rows)

    return send


class _Sums:
    """Sums per key over the parts of a task; given out when there are many."""

    def __init__(self):
        self.keys, self.values, self.size = [], [], 0

    def add(self, keys: list, values: list):
        """The rows of one part: equal keys are copies of a text with equal values."""
        key, at = np.unique(np.concatenate(keys), return_index=True)
        self.keys.append(key)
        self.values.append(np.concatenate(values)[at])
        self.size += len(key)

    def take(self):
        """Keys and summed values (tokens, known tokens, base, score)."""
        key, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        columns = np.concatenate(self.values).T
        sums = np.stack([np.bincount(inverse, c, len(key)) for c in columns], 1)
        self.__init__()
        return key, sums


def _packed(key: np.ndarray, sums: np.ndarray, tasks: int) -> pa.RecordBatch:
    """A row per task that adds up what all parts say about its texts."""
    home = _mixed(key.view(np.uint64) + _STEP) >> np.uint64(32)
    home = (home * np.uint64(tasks) >> np.uint64(32)).astype(np.int32)
    by = np.argsort(home, kind="stable")
    rows = []
    for p, at in _slices(home[by]):
        own = by[at]
        rows.append(
            _row(p, SUMS, counts=_pack(sums[own].T.ravel()), keys=_pack(key[own], True))
        )
    return _messages(rows)


def _sums_of(row: dict):
    """Keys of texts and four sums of each."""
    key = _unpack(row["keys"], np.int64, True)
    return key, _unpack(row["counts"], np.float64).reshape(4, len(key)).T


def _add_up(batches):
    """A row per text from the packed sums of all parts."""
    sums = _Sums()
    for batch in batches:
        for row in batch.select(["counts", "keys"]).to_pylist():
            key, values = _sums_of(row)
            sums.add([key], [values])
    if sums.size:
        key, total = sums.take()
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), *(pa.array(c.astype(np.int64)) for c in total.T[:2]),
             *map(pa.array, total.T[2:])],
            ["key", "n_tokens", "n_known", "base", "score"],
        )


def _unseen(layout: Layout, context: np.ndarray, chances: np.ndarray, key: np.ndarray):
    """Rows that send tokens on to the homes of their contexts."""
    order = np.argsort(context)
    for home, own in _slices(layout.home(context[order])):
        at = order[own]
        cold, runs = _runs(context[at])
        keys, text = np.unique(key[at], return_inverse=True)
        yield _row(home, UNSEEN, cold=_pack(cold, True), runs=_pack(runs), keys=_pack(keys, True),
                   texts=_pack(text.astype(np.uint32)), counts=_pack(chances[:, at].ravel()))


def _answer(model: Model):
    """Task that scores the tokens sent to its parts: packed sums per text over its parts, at most
    as many as tokens and at most one per text and task, and the tokens whose contexts are not
    here."""
    layout, fixed, past, seed = model.layout, model.fixed, model.past, model.seed

    def token_sums(scores: Scores, rows: list[dict], keys: list[np.ndarray], fresh: np.ndarray):
        """Sums of each text and, of the texts that are fresh, the tokens to send on."""
        n_hot, n, n_cold = len(layout.hot_contexts), 0, 0
        words, runs, contexts, others, texts = [], [], [], [], []
        for row, key in zip(rows, keys, strict=True):
            words.append(_unpack(row["words"], np.uint64, True))
            runs.append(_unpack(row["runs"], np.uint32))
            code = _unpack(row["contexts"], np.int64)
            contexts.append(np.where(code >= n_hot, code + n_cold, code))
            others.append(_cold_of(row, words[-1]))
            texts.append(_unpack(row["texts"], np.int64) + n)
            n, n_cold = n + len(key), n_cold + len(others[-1])
        code, cold, text = map(np.concatenate, (contexts, others, texts))
        own = np.append(np.arange(n_hot), scores.part.code_of_cold(cold))[code]
        score, base, known, parents = scores.of_codes(
            np.concatenate(words), np.concatenate(runs), own
        )
        values = np.stack([np.zeros(n), np.bincount(text, known, n), np.bincount(text, base, n),
                           np.bincount(text, score, n)], 1)
        away = np.flatnonzero((own < 0) & fresh[text])
        chances = np.stack([p[away] for p in parents])
        return values, (cold[code[away] - n_hot], chances, np.concatenate(keys)[text[away]])

    def groups(tokens: list[dict]) -> Iterator[slice]:
        """Neighbouring rows of about _GROUP_TOKENS tokens."""
        first, size = 0, 0
        for at, row in enumerate(tokens):
            size += _length(row["texts"])
            if size >= _GROUP_TOKENS or at == len(tokens) - 1:
                yield slice(first, at + 1)
                first, size = at + 1, 0

    def answer(batches):
        sums = _Sums()
        for number, rows in _by_part(batches):
            of_kind: dict[int, list[dict]] = {}
            for row in rows:
                of_kind.setdefault(row["kind"], []).append(row)
            own = of_kind.get(PAIRS, [{"part": number}])[0]
            replies = of_kind.get(REPLY, []) + of_kind.get(SAMPLE, [])
            scores = Scores(Part(own, layout, replies), layout, fixed, past, seed)
            if DIRECT in of_kind:
                sums.add(*zip(*map(_sums_of, of_kind[DIRECT]), strict=True))
            tokens = of_kind.get(TOKENS, [])
            if tokens:
                keys = [_unpack(row["keys"], np.int64, True) for row in tokens]
                fresh = np.zeros(sum(map(len, keys)), bool)
                fresh[np.unique(np.concatenate(keys), return_index=True)[1]] = True
                begins = np.cumsum([0, *map(len, keys)])
                found = [
                    token_sums(scores, tokens[own], keys[own], fresh[begins[own.start] : begins[own.stop]])
                    for own in groups(tokens)
                ]
                sums.add(keys, [values for values, _ in found])
                context, chances, key = (
                    np.concatenate(x, -1) for x in zip(*(away for _, away in found), strict=True)
                )
                if len(key):
                    yield _messages([*_unseen(layout, context, chances, key)])
            if sums.size > _SUMS_HELD:
                yield _packed(*sums.take(), layout.tasks)
        if sums.size:
            yield _packed(*sums.take(), layout.tasks)

    return answer


def _settle(model: Model):
    """Task that scores the tokens sent to the homes of their contexts, and adds up sums."""
    layout, fixed, samples = model.layout, model.fixed, range(BURN_IN + 1, len(model.past))

    def shares(rows: list[dict]):
        """Contexts of a home, and of each the share that goes to its parent in each sample; after
        them that of a context never met."""
        if not rows:
            return np.empty(0, np.uint64), [np.ones(1) for _ in samples]
        known, (counts, first), more = _at_home(rows)
        tables = [first + more.get(step, 0) for step in samples]
        return known, [np.append((STRENGTH + fixed.discount * t) / (STRENGTH + counts), 1.0)
                       for t in tables]

    def settle(batches):
        sums = _Sums()
        for _, rows in _by_part(batches):
            known, back = shares([r for r in rows if r["kind"] == HOMES])
            for row in rows:
                if row["kind"] == SUMS:
                    key, values = _sums_of(row)
                elif row["kind"] == UNSEEN:
                    key = _unpack(row["keys"], np.int64, True)
                    text, runs = (_unpack(row[name], np.uint32) for name in ("texts", "runs"))
                    at = np.repeat(_index(known, _unpack(row["cold"], np.uint64, True)), runs)
                    chances = _unpack(row["counts"], np.float64).reshape(len(back), len(text))
                    mean = sum(b[at] * p for b, p in zip(back, chances, strict=True)) / len(back)
                    values = np.zeros((len(key), 4))
                    values[:, 3] = np.bincount(text, np.log10(mean), len(key))
                else:
                    continue
                sums.add([key], [values])
            if sums.size > _SUMS_HELD:
                yield _packed(*sums.take(), layout.tasks)
        if sums.size:
            yield _packed(*sums.take(), layout.tasks)

    return settle


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens (bigint), base_score and score
    (log10 probabilities of the text: add-one unigrams, the model) and perplexity (per token).

    Null texts are empty: one token, the end. Words not learned have the probability of the one
    unknown word. Null ids stay null, repeated rows come out as often as they go in; a text is
    scored once per block whatever the number of its copies. Other columns are not read. An empty
    table gives an empty result; a model of no rows gives every text the log probability 0.
    """
    layout = model.layout
    sent = _texts(docs, text_col).mapInArrow(_send(model), _ROW)
    sent = model.pairs.unionByName(_of_kinds(model.said, REPLY, SAMPLE)).unionByName(sent)
    answers = _met(sent, layout).mapInArrow(_answer(model), _ROW)
    homes = _of_kinds(model.said, HOMES).filter((F.col("step") == 0) | (F.col("step") > BURN_IN))
    answers = _met(answers.unionByName(homes), layout).mapInArrow(_settle(model), _ROW)
    answers = answers.repartition(layout.tasks, "part")
    totals = answers.mapInArrow(
        _add_up, "key bigint, n_tokens bigint, n_known bigint, base double, score double"
    )
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"),
    )
    return spread_join(keyed, totals, ["key"], ["id"]).select(
        F.col("id").alias(id_col), "n_tokens", "n_known",
        F.lit(model.fixed.tokens).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
