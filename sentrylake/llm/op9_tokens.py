"""Token counts of byte-level BPE by dynamic programming over prefixes.

A text falls into pieces by the tokenizer's split pattern, and merges never cross a piece. For a
piece, count[i] is the exact number of tokens of its first i bytes. The encoding of a prefix ends
in exactly one token t, and it is the encoding of what stands before t plus t; t is right if and
only if merging the two byte strings "last token before t" and "t" on their own gives these two
tokens back. So last[i] and count[i] follow from smaller prefixes, and the answers to "how many
tokens" and "how much text fits" come from stored counts without another encoding.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

# Distinct pieces a worker remembers; beyond, it starts anew.
REMEMBERED = 400_000
_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: bytes that print stand for
    themselves, the others follow from code point 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Exact token counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.tokens = {raw(t) for t in content["model"]["vocab"]}
        self.longest = max(map(len, self.tokens))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in content["added_tokens"]]
        self.split = regex.compile(pattern)
        self.at_special = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special else None
        )
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.grown: dict[bytes, tuple[list, list]] = {}
        self.pieces: dict[str, bytes | list[int]] = {}

    def _edges(self, token: bytes) -> tuple[list, list]:
        """How the first and the last part of a token grow while its bytes are merged: pairs of
        the part and the rank of the merge that takes it up. Both end in the token itself, or
        are empty if its bytes never merge into it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        first, last = [], []
        while len(parts) > 1:
            rank, at = min(
                (self.rank.get(pair, _NEVER), i) for i, pair in enumerate(zip(parts, parts[1:]))
            )
            if rank == _NEVER:
                return [], []
            if at == 0:
                first.append((parts[0], rank))
            if at == len(parts) - 2:
                last.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*first, (token, _NEVER)], [*last, (token, _NEVER)]

    def edges(self, token: bytes) -> tuple[list, list]:
        found = self.grown.get(token)
        if found is None:
            found = self.grown[token] = self._edges(token)
        return found

    def _side_by_side(self, a: bytes, b: bytes) -> bool:
        """Whether the bytes of a followed by those of b are encoded as a, b. Merges run in
        rising rank, so a merge across the border happens if its two parts stand there at once
        and its rank comes before those that take either part up; of equal ranks the left one
        comes first."""
        key = (a, b)
        held = self.fits.get(key)
        if held is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            held = self.fits[key] = self._stays_apart(a, b)
        return held

    def _stays_apart(self, a: bytes, b: bytes) -> bool:
        growing_right = self.edges(b)[0]
        if not a or not growing_right:
            return bool(growing_right)
        growing_left, i, j = self.edges(a)[1], 0, 0
        while True:
            (x, x_until), (y, y_until) = growing_left[i], growing_right[j]
            rank = self.rank.get((x, y), _NEVER)
            if rank < x_until and rank <= y_until:
                return False
            if x_until == y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def byte_counts(self, piece: bytes) -> list[int]:
        """count[i] for the prefixes of 1..n bytes of one piece."""
        tokens, longest, fits = self.tokens, self.longest, self._side_by_side
        count, last = [0], [b""]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in tokens and fits(last[start], token):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count[1:]

    def piece_counts(self, piece: str) -> bytes | list[int]:
        """byte_counts of a piece, remembered; as bytes while they fit."""
        found = self.pieces.get(piece)
        if found is None:
            found = self.byte_counts(piece.encode("utf-8", "surrogatepass"))
            if found[-1] < 256:
                found = bytes(found)
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            if len(found) < 64:
                self.pieces[piece] = found
        return found

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """(part, is special) in order; special strings in a text are one token each."""
        if self.at_special is None or not any(s in text for s in self.special):
            return [(text, False)]
        parts = self.at_special.split(text)
        return [(p, i % 2 == 1) for i, p in enumerate(parts) if p]

    def running(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a text and the number of tokens up to the end of each."""
        pieces: list[str] = []
        sizes: list[int] = []
        remembered, counts = self.pieces, self.piece_counts
        for part, special in self.segments(text):
            if special:
                pieces.append(part)
                sizes.append(1)
            else:
                found = self.split.findall(part)
                pieces += found
                sizes += [(remembered.get(p) or counts(p))[-1] for p in found]
        return pieces, list(accumulate(sizes))

    def _ordinary(self, text: str) -> int:
        _, upto = self.running(text)
        return upto[-1] if upto else 0

    def _cuts(self, pieces: list[str], first: int, base: int) -> tuple[int, list[int]]:
        """Counts after each character from piece `first` to the end of the next piece that is
        not white space, and the index behind it. base: tokens before `first`, which the start
        of the text or something else than white space precedes."""
        out: list[int] = []
        space = ""
        at = first
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece in self.special:
                out += [base + self._ordinary(space + piece[:k]) for k in range(1, len(piece))]
                return at, [*out, base + (self._ordinary(space) if space else 0) + 1]
            blank = len(piece) - len(piece.lstrip())
            # White space at the end of a prefix is split as one run, whatever follows in the text.
            for k in range(1, blank + 1):
                out.append(base + self._ordinary(space + piece[:k]))
            if blank == len(piece):
                space += piece
                continue
            base += sum(self.piece_counts(p)[-1] for p in self.split.findall(space + piece)[:-1])
            counts, end = self.piece_counts(piece), blank
            for k in range(blank + 1, len(piece) + 1):
                end += len(piece[k - 1].encode("utf-8", "surrogatepass"))
                if piece[0] == "'" and 1 < k < len(piece):
                    out.append(base + self._ordinary(piece[:k]))
                else:
                    out.append(base + counts[end - 1])
            return at, out
        return at, out

    def prefix_counts(self, text: str) -> list[int]:
        """The number of tokens of text[:k] for every k from 1 to the length of the text."""
        pieces, upto = self.running(text)
        at, out = 0, []
        while at < len(pieces):
            at, cuts = self._cuts(pieces, at, upto[at - 1] if at else 0)
            out += cuts
        return out

    def fitting(self, pieces: list[str], upto: list[int], budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens, from the result of
        running(): stored counts lead to the one place where the prefix can end."""
        whole = bisect_right(upto, budget)
        while whole and pieces[whole - 1].isspace():
            whole -= 1
        chars = sum(map(len, pieces[:whole]))
        _, cuts = self._cuts(pieces, whole, upto[whole - 1] if whole else 0)
        return chars + max((k for k, n in enumerate(cuts, 1) if n <= budget), default=0)


_counters: dict[tuple[str, str], PrefixCounter] = {}


def counter(path: str, pattern: str) -> PrefixCounter:
    """One per worker process."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = PrefixCounter(path, pattern)
    return _counters[path, pattern]


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, budget: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > budget) and
    fit_chars, the characters of the longest prefix that takes at most budget tokens.

    tokenizer: the vocabulary file, on every executor; pattern: its split pattern. Null texts are
    empty: no byte, no token. Null ids stay null, repeated rows are counted one by one, other
    columns are not read, an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        prefixes = counter(tokenizer, pattern)
        for batch in batches:
            for piece in text_pieces(batch, "text"):
                n_bytes, n_tokens, fit = [], [], []
                for text in piece.column("text").to_pylist():
                    text = text or ""
                    pieces, upto = prefixes.running(text)
                    n = upto[-1] if upto else 0
                    n_bytes.append(len(text.encode()))
                    n_tokens.append(n)
                    fit.append(len(text) if n <= budget else prefixes.fitting(pieces, upto, budget))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(n_bytes, pa.int64()),
                     pa.array(n_tokens, pa.int64()),
                     pa.array([n > budget for n in n_tokens], pa.bool_()),
                     pa.array(fit, pa.int64())],
                    ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(
        count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    )
    return out.withColumnRenamed("id", id_col)
