"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, the rest lower-case words. Windows of WINDOW
template tokens of the benchmark and of the documents meet in a hash join, so a question whose
numbers or names were exchanged has the windows of the original. Matches of an item and a document
are lined up by their offset; on each line the values in the slots are compared: an item's value
must always stand for the same value of the document. An item is found in a document if lines with
consistent slots cover at least COVERAGE of its windows.

A window of which half or more are placeholders says too little as a template, and another letter
case makes names of other words. So every window is also looked for by its words themselves, in
lower case and with their numbers; these windows have no slots, and an item is found as well if they
cover COVERAGE of it. Items of numbers, in capitals or in another case are found that way.
"""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..operators.staging import stage
from .common import text_pieces

WINDOW = 5
# Items of fewer tokens than this say too little to look for.
LEAST_TOKENS = 3
COVERAGE = 0.5
# Share of an item's slot values that may stand for two values of the document.
LOOSE_SLOTS = 0.2

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty "
    "ninety hundred thousand million billion"
).split()
# Units count as such behind a number only.
UNITS = (
    "m cm mm km kg g mg t l ml s ms h min hz khz mhz ghz w kw mw v a j kj n pa mol ft in yd mi lb "
    "oz mph kmh usd eur gbp meter meters metre metres kilometer kilometers kilometre kilometres "
    "centimeter centimeters gram grams kilogram kilograms tonne tonnes liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years inch "
    "inches foot feet yard yards mile miles pound pounds ounce ounces dollar dollars euro euros "
    "cent cents percent degree degrees watt watts volt volts"
).split()

_LETTER, _CAPITAL, _DIGIT, _STOP, _IDEOGRAM = 1, 2, 3, 4, 5
_LITERAL, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
_MARKS = ("", "number:", "name:", "unit:")
# Characters taken at once; small enough for the processor's cache.
_SEGMENT = 1 << 17
_WORD_STEP = np.uint64(0x9E3779B97F4A7C15)
_WINDOW_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
# The filter for windows has a bit per value of the upper 22 bits of the hash: 512 kB.
_FILTER_BITS = 22
_MASK = (1 << 64) - 1


@cache
def _tables():
    """Kind and lower case of each code point of the basic plane; the last entry stands for all
    points beyond it."""
    kind, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint64)
    for p in range(1 << 16):
        c = chr(p)
        if c.isalpha():
            kind[p] = _CAPITAL if c.isupper() or c.istitle() else _LETTER
            low = c.lower()
            lower[p] = ord(low) if len(low) == 1 else p
        elif c.isdecimal():
            kind[p] = _DIGIT
        elif c in ".!?:\n。！？":
            kind[p] = _STOP
    kind[0x300:0x370] = _LETTER
    kind[0x3040:0x3100] = kind[0x3400:0xA000] = _IDEOGRAM
    kind[-1] = _LETTER
    return kind, lower


@cache
def _powers():
    steps = np.full(_SEGMENT + 1, _WORD_STEP)
    steps[0] = 1
    inverse = np.full(_SEGMENT + 1, np.uint64(pow(int(_WORD_STEP), -1, 1 << 64)))
    inverse[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(inverse)


@cache
def _known(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(np.array([_word_hash(w) for w in words], np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hash(word: str) -> int:
    total = sum(ord(c) * pow(int(_WORD_STEP), i, 1 << 64) for i, c in enumerate(word)) & _MASK
    return int(_mixed(np.array([total], np.uint64))[0])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def _segment_tokens(text: str, fresh: bool):
    """hash, type, start, end of the tokens of a text of at most _SEGMENT characters. fresh: a
    sentence begins at its start."""
    kinds, lower = _tables()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(raw, 0xFFFF)
    kind = kinds[points]
    # A point or comma between digits belongs to the number.
    inner = np.zeros(len(kind), bool)
    inner[1:-1] = (
        ((points[1:-1] == 44) | (points[1:-1] == 46))
        & (kind[:-2] == _DIGIT)
        & (kind[2:] == _DIGIT)
    )
    kind = np.where(inner, _DIGIT, kind)
    inside = (kind != 0) & (kind != _STOP)
    alone = kind == _IDEOGRAM
    joined = np.zeros(len(kind) + 1, bool)  # joined[i]: i-1 and i are in one token
    joined[1:-1] = inside[1:] & inside[:-1] & ~alone[1:] & ~alone[:-1]
    start = np.flatnonzero(inside & ~joined[:-1])
    end = np.flatnonzero(inside & ~joined[1:]) + 1
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.uint8), start, end
    powers, inverse = _powers()
    running = np.concatenate(
        [np.zeros(1, np.uint64), np.cumsum(lower[points] * powers[: len(points)])]
    )
    word = _mixed((running[end] - running[start]) * inverse[start])

    stops = np.concatenate([[0], np.cumsum(kind == _STOP)])
    opens = stops[start] > np.concatenate([[0], stops[end[:-1]]])
    opens[0] |= fresh
    first = kind[start]
    number = (first == _DIGIT) | _among(word, _known(tuple(NUMBER_WORDS)))
    unit = _among(word, _known(tuple(UNITS)))
    unit[1:] &= number[:-1]
    unit[0] = False
    name = (first == _CAPITAL) & ~opens
    typed = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, _LITERAL)))
    return word, typed.astype(np.uint8), start, end


def tokens(text: str):
    """hash, type, start, end of all tokens; long texts are taken in segments between words."""
    parts, at, fresh = [], 0, True
    while at < len(text) or not parts:
        stop = min(at + _SEGMENT, len(text))
        if stop < len(text):
            space = max(text.rfind(" ", at + 1, stop), text.rfind("\n", at + 1, stop))
            stop = space if space > 0 else stop
        word, typed, start, end = _segment_tokens(text[at:stop], fresh)
        parts.append((word, typed, start + at, end + at))
        tail = text[at + (int(end[-1]) if len(end) else 0) : stop + 1]
        fresh = (fresh and not len(end)) or any(c in ".!?:\n。！？" for c in tail)
        at = stop
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Templates:
    """The template tokens of several texts and their windows."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        # A line end closes a sentence and a token, so texts do not run into each other.
        self.joined = "\n".join(texts)
        word, self.typed, self.start, self.end = tokens(self.joined)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.first = np.searchsorted(self.start, begins)  # first token of each text
        self.counts = np.diff([*self.first, len(word)])
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.word = word
        # the types' own marks, far from the sums of words
        self.template = np.where(
            self.typed == _LITERAL,
            word,
            self.typed.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93),
        )
        self.literals = np.concatenate([[0], np.cumsum(self.typed == _LITERAL)])

    def windows(self, size: int, folded: bool, wanted: np.ndarray | None = None):
        """text number, position in the text, hash and slot values of the windows of `size`
        tokens of one text: templates in which more than half are literal words, or, folded, all
        windows by their lower-case words, without slots. With a filter, only windows that it
        lets pass."""
        n = len(self.template) - size + 1
        if n < 1:
            return []
        parts = self.word if folded else self.template
        # another start keeps the two kinds apart
        window = np.full(n, np.uint64(1 if folded else 0))
        for k in range(size):
            window = window * _WINDOW_STEP + parts[k : k + n]
        window = _mixed(window)
        keep = self.text[:n] == self.text[size - 1 :]
        if not folded:
            keep &= 2 * (self.literals[size:] - self.literals[:-size]) > size
        if wanted is not None:
            keep &= wanted[window >> np.uint64(64 - _FILTER_BITS)]
        return [
            (int(self.text[i]), i - int(self.first[self.text[i]]), int(window[i].view(np.int64)),
             [] if folded else self.slots(i, size))
            for i in np.flatnonzero(keep).tolist()
        ]

    def slots(self, at: int, size: int) -> list[str]:
        return [
            _MARKS[self.typed[j]] + self.joined[self.start[j] : self.end[j]].lower()
            for j in range(at, at + size)
            if self.typed[j]
        ]


_SLOTS = pa.list_(pa.string())


def _item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, size, folded, item_at, hash, item_slots, total (windows of the item of this kind)."""
    kind = items.schema[item_col].dataType.simpleString()

    def make(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                rows = {c: [] for c in ("at", "size", "folded", "item_at", "hash", "item_slots",
                                        "total")}
                for i, text in enumerate(piece.column("text").to_pylist()):
                    item = Templates([text])
                    size = min(window, len(item.template))
                    for folded in (False, True) if size >= LEAST_TOKENS else ():
                        found = item.windows(size, folded)
                        for _, at, value, slots in found:
                            row = (i, size, folded, at, value, slots, len(found))
                            for c, v in zip(rows, row, strict=True):
                                rows[c].append(v)
                ids = piece.column("id").take(pa.array(rows.pop("at"), pa.int64()))
                kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), _SLOTS, pa.int64())
                arrays = [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], ["item", *rows])

    texts = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.filter("id is not null").mapInArrow(
        make, f"item {kind}, size int, folded boolean, item_at bigint, hash bigint, "
        "item_slots array<string>, total bigint",
    )


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """A bit per upper part of the hashes; at most 128 rows of 4 kB come to the driver, however
    many windows there are."""
    place = f"shiftrightunsigned(hash, {64 - _FILTER_BITS})"
    rows = windows.groupBy(F.expr(f"bitmap_bucket_number({place})").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias("bits")
    )
    # bucket b holds the values 32768 (b - 1) + 1 to 32768 b, bucket 0 the value 0
    bits = np.zeros((1 << _FILTER_BITS) + 32768, bool)
    for row in rows.collect():
        first = max(32768 * (row["bucket"] - 1) + 1, 0)
        part = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        bits[first : first + 32768] |= part.astype(bool)
    return bits


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """A row per document and benchmark item found in it: id, text_key (xxhash64 of the text),
    item_col, coverage (share of the item's windows found, 0 to 1, the greater of templates and
    lower-case words) and reparameterised (some slot has another value).

    Null and empty texts contain nothing. Items without a text, with fewer than LEAST_TOKENS
    tokens or without an id are not looked for; items shorter than the window are one window. Repeated rows give one row, null ids keep apart by
    text_key. Other columns are not read. Empty tables give an empty result.
    """
    known = stage(_item_windows(items, item_col, item_text_col, window), "item-windows")
    wanted = _filter_bits(known)
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # at most `window`
    kind = docs.schema[id_col].dataType.simpleString()

    def look(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                rows = {c: [] for c in ("row", "size", "folded", "doc_at", "hash", "doc_slots")}
                found = Templates(piece.column("text").to_pylist())
                for size, folded in product(sizes, (False, True)):
                    for i, at, value, slots in found.windows(size, folded, wanted):
                        for c, v in zip(rows, (i, size, folded, at, value, slots), strict=True):
                            rows[c].append(v)
                taken = piece.select(["id", "text_key"]).take(pa.array(rows.pop("row"), pa.int64()))
                kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), _SLOTS)
                arrays = [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, *arrays], ["id", "text_key", *rows]
                )

    text = F.col(text_col).cast("string")
    seen = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    ).mapInArrow(
        look, f"id {kind}, text_key bigint, size int, folded boolean, doc_at bigint, "
        "hash bigint, doc_slots array<string>",
    )
    met = spread_join(seen, known, ["hash", "size", "folded"], ["id", "text_key"])
    pair = ["id", "text_key", "item"]
    lines = (
        met.withColumn("line", F.expr("doc_at - item_at"))
        .groupBy(*pair, "folded", "total", "line")
        # on one line an item's position meets one position of the document
        .agg(
            F.collect_set("item_at").alias("found"),
            F.expr("array_distinct(flatten(collect_set(arrays_zip(item_slots, doc_slots))))")
            .alias("slots"),
        )
        .withColumn("values", F.expr("size(array_distinct(transform(slots, s -> s.item_slots)))"))
        .filter(F.expr(f"size(slots) - values <= {LOOSE_SLOTS} * values"))
    )
    return (
        lines.select(
            *pair, "folded", "total", F.explode("found").alias("at"),
            F.expr("exists(slots, s -> s.item_slots <> s.doc_slots)").alias("other"),
        )
        .groupBy(*pair, "folded", "total")
        .agg(F.countDistinct("at").alias("n"), F.max("other").alias("reparameterised"))
        .withColumn("coverage", F.col("n") / F.col("total"))
        .filter(F.col("coverage") >= coverage)
        .groupBy(*pair)
        .agg(F.max("coverage").alias("coverage"), F.max("reparameterised").alias("reparameterised"))
        .select(F.col("id").alias(id_col), "text_key", F.col("item").alias(item_col), "coverage",
                "reparameterised")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item is found. Rows are told apart by
    id and text: rows with a null text stay, rows with a null id go by their text, of repeated rows
    all or none stay. An empty table of items keeps every row."""
    found = contaminated(docs, items, id_col, text_col, **options)
    # names that docs does not have
    own = "found"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    bad = found.select(
        F.col(id_col).alias(f"{own}id"), F.col("text_key").alias(f"{own}key")
    ).distinct()
    same = F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (
        F.xxhash64(F.col(text_col).cast("string")) == F.col(f"{own}key")
    )
    return docs.join(bad, same, "left_anti")
