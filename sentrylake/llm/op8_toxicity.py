"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

The units of a text are the character n-grams of its words, with marks for where a word begins
and ends, and the words themselves; each unit has an embedding (by a hash). A bag of units is the
mean of their embeddings, and a softmax over two classes reads it. A misspelling not seen before
still has most of its n-grams in common with the word. The bags are segments of SEGMENT_WORDS
words, and a text is as toxic as its worst segment, so that a few words count in a long text as
in a short one; training takes the worst segment of each text likewise.

The model is fitted on a bounded sample of labelled rows by one task; scoring runs over all texts.
After training only the difference of the two class scores of each unit matters, a table of
2**BUCKET_BITS numbers.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

BUCKET_BITS = 20
DIM = 8
LENGTHS = (3, 4, 5, 6)
SEGMENT_WORDS = 6
# A unit found in fewer texts of the sample says nothing about others and stays at zero.
LEAST_TEXTS = 3
# The bound of the sample: rows of class 0 and 1, and bytes of their texts together.
SAMPLE_ROWS = (3000, 1500)
SAMPLE_BYTES = (5 << 20, 4 << 20)
# A text of the sample holds at most this part of its class's bytes (1/64: 80 or 64 kB), taken
# from this many places.
TEXT_SHARE = 64
EXCERPTS = 64
# First epochs over random segments of each text, so that units which only occur in one class
# stand out; then epochs over the worst segments.
WARM_EPOCHS = 6
WARM_SEGMENTS = 8
EPOCHS = 12
BATCH = 64
_START = 0.05
RATE = 0.2
_SEGMENT_CHARS = 1 << 17
_KEPT_SIGNS = "@$*"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Lower case of each code point of the basic plane, 0 for what is no letter or digit. The
    last entry stands for all points beyond."""
    table = np.zeros(1 << 16, np.uint64)
    for p in range(1 << 16):
        c = chr(p)
        if c.isalnum() or c in _KEPT_SIGNS:
            low = c.lower()
            table[p] = ord(low) if len(low) == 1 else p
    table[0x300:0x370] = np.arange(0x300, 0x370)
    table[-1] = 0xFFFF
    return table


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _units(text: str):
    """(place, bucket) of the units, a pair of arrays for each length of n-gram and for the words,
    and the places where words begin. The text is read as if white space stood around it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(points) + 2, np.uint64)
    c[1:-1] = _letters()[np.minimum(points, 0xFFFF)]
    mark = c == 0
    place = np.where(mark, np.arange(len(c), dtype=np.int32), np.int32(len(c)))
    # how far the next mark behind each place is
    ahead = np.minimum.accumulate(place[:0:-1])[::-1] - np.arange(len(c) - 1, dtype=np.int32)
    first = np.flatnonzero(mark[:-1] & ~mark[1:]).astype(np.int32)  # the mark before each word
    units = []
    h = c
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] * _STEP + c[n - 1 :]
        if n not in LENGTHS:
            continue
        good = np.flatnonzero(ahead[: len(h)] >= n - 1).astype(np.int32)
        if n == LENGTHS[0]:
            # a word is known by the sum of its shortest n-grams
            grams = np.zeros(len(c) + 1, np.uint64)
            grams[good + 1] = h[good] ^ (h[good] >> np.uint64(29))
            grams = np.cumsum(grams)
        units.append((good, _bucket(h[good] + np.uint64(n))))
    if len(first):
        units.append((first, _bucket(grams[first + 1 + ahead[first + 1]] - grams[first])))
    return units, first


def _parts(text: str):
    """A text in parts of about _SEGMENT_CHARS characters, cut at white space where there is."""
    at = 0
    while at < len(text):
        stop = min(at + _SEGMENT_CHARS, len(text))
        if stop < len(text):
            space = max(text.rfind(" ", at + 1, stop), text.rfind("\n", at + 1, stop))
            stop = space if space > 0 else stop
        yield text[at:stop]
        at = stop


def _groups(texts: list[str | None]):
    """Texts in groups of about _SEGMENT_CHARS characters: (units, where segments begin, text of
    each segment). Texts without a word have no segment."""
    joined, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _parts(text or ""):
            if joined and size + len(part) > _SEGMENT_CHARS:
                yield _grouped(joined, owner)
                joined, owner, size = [], [], 0
            joined.append(part)
            owner.append(i)
            size += len(part)
    if joined:
        yield _grouped(joined, owner)


def _grouped(joined: list[str], owner: list[int]):
    units, first = _units("\n".join(joined))  # a line end between two parts
    begins = np.cumsum([0, *[len(p) + 1 for p in joined[:-1]]])
    part_of_word = np.searchsorted(begins, first, "right") - 1
    first_word = np.searchsorted(part_of_word, np.arange(len(joined)))
    begin = (np.arange(len(first)) - first_word[part_of_word]) % SEGMENT_WORDS == 0
    return units, first[begin], np.array(owner, np.int64)[part_of_word[begin]]


def text_logits(texts: list[str | None], model) -> np.ndarray:
    """Log odds of class 1 of each text: of its worst segment, or those of an empty text."""
    weights, bias, empty = model
    out = np.full(len(texts), -np.inf)
    for units, begins, owner in _groups(texts):
        if not len(owner):
            continue
        size = 1 + max(int(where[-1]) for where, _ in units if len(where))
        total, count = np.zeros(size, np.float32), np.zeros(size, np.int32)
        for where, buckets in units:
            total[where] += weights[buckets]
            count[where] += 1
        mean = np.add.reduceat(total, begins) / np.add.reduceat(count, begins)
        np.maximum.at(out, owner, bias + mean)
    return np.where(np.isinf(out), empty, out)


def _bags(texts: list[str]):
    """buckets of all units by segment, number of units and text of each segment."""
    all_buckets, lengths, owners = [], [], []
    for units, begins, owner in _groups(texts):
        if len(owner):
            where = np.concatenate([w for w, _ in units])
            all_buckets.append(
                np.concatenate([b for _, b in units])[np.argsort(where, kind="stable")]
            )
            count = np.bincount(where)
            lengths.append(np.add.reduceat(count, begins))
            owners.append(owner)
    return np.concatenate(all_buckets), np.concatenate(lengths), np.concatenate(owners)


def _place_in_group(group: np.ndarray) -> np.ndarray:
    """For sorted groups: 0, 1, 2, ... within each."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(first, np.diff([*first, len(group)]))


def _spans(group: np.ndarray):
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
    return zip(cuts, cuts[1:])


def train(texts: list[str], labels: np.ndarray, seed: int = 8, epochs: int = EPOCHS):
    """The model: the class difference of each bucket, the bias, and the log odds of an empty
    text, which are those of the classes in the sample."""
    rng = np.random.default_rng(seed)
    buckets, lengths, owner = _bags(texts)
    n_seg = len(owner)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    texts_with = np.zeros(1 << BUCKET_BITS, np.int32)
    for first, last in _spans(owner):
        texts_with[np.unique(buckets[ends[first] : ends[last]])] += 1
    learned = (texts_with >= LEAST_TEXTS).astype(np.float32)[:, None]
    emb = rng.uniform(-_START, _START, (1 << BUCKET_BITS, DIM)).astype(np.float32) * learned
    emb_seen = np.full(1 << BUCKET_BITS, 1e-6, np.float32)
    # softmax over classes 0 and 1
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    out_seen, bias, bias_seen = np.full((DIM, 2), 1e-6), np.zeros(2), np.full(2, 1e-6)
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    for epoch in range(WARM_EPOCHS + epochs):
        if epoch < WARM_EPOCHS:
            by = np.lexsort((rng.random(n_seg), owner))
            picked = rng.permutation(by[_place_in_group(owner[by]) < WARM_SEGMENTS])
        else:
            scalar = emb @ (out[:, 1] - out[:, 0])
            mean = np.add.reduceat(scalar[buckets], ends[:-1]) / lengths
            # the worst segment of each text, and another one of some texts of class 0
            by = np.lexsort((-mean, owner))
            picked = by[_place_in_group(owner[by]) == 0]
            spare = rng.integers(0, n_seg, len(picked) // 4)
            picked = rng.permutation(np.concatenate([picked, spare[labels[owner[spare]] == 0]]))
        for at in range(0, len(picked), BATCH):
            seg = picked[at : at + BATCH]
            y = labels[owner[seg]]
            sizes = ends[seg + 1] - ends[seg]
            ids = np.concatenate([buckets[ends[s] : ends[s + 1]] for s in seg])
            row = np.repeat(np.arange(len(seg)), sizes)
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bag = np.add.reduceat(emb[ids], cuts) / sizes[:, None]
            logits = bag @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(seg)), y] -= 1
            p *= (0.5 / share[y])[:, None]  # both classes weigh the same
            g_out, g_bias = bag.T @ p / len(seg), p.mean(axis=0)
            g_bag = (p @ out.T) / sizes[:, None]
            touched, inverse = np.unique(ids, return_inverse=True)
            g_emb = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g_emb, inverse, g_bag[row])
            emb_seen[touched] += (g_emb**2).mean(axis=1)
            step = RATE * g_emb / np.sqrt(emb_seen[touched])[:, None]
            emb[touched] -= step * learned[touched]
            out_seen += g_out**2
            out -= (0.1 * g_out / np.sqrt(out_seen)).astype(np.float32)
            bias_seen += g_bias**2
            bias -= 0.1 * g_bias / np.sqrt(bias_seen)
    weights = (emb @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return weights, float(bias[1] - bias[0]), float(np.log(share[1] / share[0]))


def _spread_excerpt(text: str, limit: int) -> str:
    """At most about limit bytes of a longer text, in EXCERPTS runs of characters at even distances
    that begin and end at white space where there is some."""
    size = len(text.encode("utf-8", "surrogatepass"))
    if size <= limit:
        return text
    run = max(limit * len(text) // size // EXCERPTS, 1)
    step = (len(text) - run) // max(EXCERPTS - 1, 1)
    runs = []
    for at in range(0, EXCERPTS * step, step):
        part = text[at : at + run]
        first = part.find(" ") + 1 if at else 0
        last = part.rfind(" ")
        runs.append(part[first:last] if last > first else part)
    # each piece may be dense in long characters
    kept = "\n".join(runs).encode("utf-8", "surrogatepass")[:limit]
    return kept.decode("utf-8", "ignore")


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    label_col: str, rows=SAMPLE_ROWS, total_bytes=SAMPLE_BYTES) -> DataFrame:
    """text, label: at most rows[y] rows of class y, together at most total_bytes[y], taken in the
    order of a hash of the id. A text longer than 1 / TEXT_SHARE of total_bytes[y] counts with
    excerpts of that size from all over it, so no text can end its class."""
    known = (
        labels.filter(f"{label_col} in (0, 1) and {id_col} is not null")
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .withColumn("h", F.xxhash64(F.lit(8), "id"))
    )
    picked = [known.filter(f"label = {y}").orderBy("h", "id").limit(rows[y]) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = (
        texts.filter("text is not null")
        # at most sum(rows) ids
        .join(F.broadcast(picked[0].unionByName(picked[1])), "id")
        .dropDuplicates(["id"])
    )
    kind = found.schema["id"].dataType.simpleString()
    limits = [max(size // TEXT_SHARE, 1) for size in total_bytes]

    def shorten(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                texts = [_spread_excerpt(t, limits[y]) for t, y in
                         zip(piece.column("text").to_pylist(), piece.column("label").to_pylist(),
                             strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.select(["id", "label", "h"]).columns, pa.array(texts, pa.string())],
                    ["id", "label", "h", "text"],
                )

    bounded = found.select("id", "label", "h", "text").mapInArrow(
        shorten, f"id {kind}, label int, h bigint, text string"
    )
    # From here on the sample lies in two tasks, and its rows are bounded.
    return bounded.withColumn(
        "upto", F.expr("sum(octet_length(text)) over (partition by label order by h, id)")
    ).filter(f"upto <= if(label = 0, {total_bytes[0]}, {total_bytes[1]})").select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows=SAMPLE_ROWS, total_bytes=SAMPLE_BYTES):
    """The model (weights, bias, empty) from a bounded sample of the labelled rows, trained in one
    task. Without labelled words of both classes it gives every text the class that there is, or
    0."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, rows, total_bytes)

    def train_all(batches):
        y, texts = [], []
        for batch in batches:
            y += batch.column("label").to_pylist()
            texts += batch.column("text").to_pylist()
        if len({v for v, t in zip(y, texts, strict=True) if any(map(str.isalnum, t))}) < 2:
            sure = 30.0 if 1 in y and 0 not in y else -30.0
            model = np.zeros(1 << BUCKET_BITS, np.float32), sure, sure
        else:
            model = train(texts, np.array(y))
        yield pa.RecordBatch.from_pydict(
            {"weights": [model[0].tobytes()], "bias": [model[1]], "empty": [model[2]]}
        )

    schema = "weights binary, bias double, empty double"
    row = sample.coalesce(1).mapInArrow(train_all, schema).first()
    if row is None:
        return np.zeros(1 << BUCKET_BITS, np.float32), -30.0, -30.0
    return np.frombuffer(bytes(row["weights"]), np.float32), row["bias"], row["empty"]


def toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1, the probability of class 1) and predicted (1 if
    the score is at least 0.5). Null texts and texts without a word get the share of class 1 in
    the sample. Null ids stay null, repeated rows are scored one by one, other columns are not read. An
    empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB

    def score(batches):
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                logits = text_logits(piece.column("text").to_pylist(), shared.value)
                p = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["id", "score", "predicted"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed(
        "id", id_col
    )
