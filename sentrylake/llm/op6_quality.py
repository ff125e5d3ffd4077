"""Quality rules as a short-circuit cascade.

Every document gets the base measures. Documents that pass the base test go through a list of
further rules, and a rule is only computed for documents that no earlier rule has rejected. The
order comes from a sample: each rule is timed and its rejections are counted there, and the next
rule is always the one that rejects most of the still undecided sample per second. The order
changes the cost, never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LETTER = re.compile(r"[^\W\d_]")
_BULLET = re.compile(r"[ \t]*(?:[-*•●▪–]|\d+[.)])[ \t]")

# Rows of the sample from which costs and rejections are estimated.
SAMPLE_ROWS = 400
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


class Measured:
    """A text with its words and the base measures."""

    __slots__ = ("text", "words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 "n_repeat_words")

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = _WORD.findall(self.text)
        self.lines = [x for x in self.text.split("\n") if _WORD.search(x)]
        self.n_words = len(self.words)
        self.word_chars = sum(map(len, self.words))
        self.n_symbols = len(_SYMBOL.findall(self.text))
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = _repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return (
            self.n_words < MIN_WORDS
            or 100 * self.n_repeat_words > MAX_REPEATED_PERCENT * self.n_words
        )


def _repeated_words(words: list[str]) -> int:
    """Words inside a three-word window that the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = upto = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


@dataclass(frozen=True)
class Rule:
    """rejects(document) is true for text that should go."""

    name: str
    rejects: Callable[[Measured], bool]


def _many_lines(d: Measured, test: Callable[[str], object], percent: int) -> bool:
    return 100 * sum(1 for x in d.lines if test(x)) > percent * len(d.lines)


RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("bullets", lambda d: _many_lines(d, _BULLET.match, 90)),
    Rule("ellipses", lambda d: len(d.lines) > 3
         and _many_lines(d, lambda x: x.rstrip().endswith(("...", "…")), 30)),
    Rule("no_letters", lambda d: 10 * sum(1 for w in d.words if _LETTER.search(w)) < 7 * d.n_words),
    Rule("digits", lambda d: 10 * sum(map(str.isdecimal, d.text)) > 3 * d.word_chars),
    Rule("broken_text", lambda d: 100 * (d.text.count("�") + d.text.count("\x00"))
         > d.word_chars),
    Rule("giant_word", lambda d: max(map(len, d.words)) > 1000),
)


def _text_rows(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str):
    for batch in batches:
        for piece in text_pieces(batch, text_col):
            yield piece, piece.column(text_col).to_pylist()


def rule_order(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows=SAMPLE_ROWS):
    """Names of the rules in the order to run them: [(name, seconds, rejected)], from a random
    sample of at most sample_rows rows, each of which is measured by every rule."""
    n = docs.count()
    every = max(1, n // sample_rows)
    sample = (
        docs.select(F.col(text_col).cast("string").alias("text"))
        .filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
        .limit(sample_rows)
    )

    def trial(batches):
        for batch in batches:
            costs, verdicts = [], []
            for text in batch.column("text").to_pylist():
                d = Measured(text)
                if d.base_failed:
                    continue
                cost, bad = [], []
                for rule in rules:
                    t = time.perf_counter()
                    bad.append(bool(rule.rejects(d)))
                    cost.append(time.perf_counter() - t)
                costs.append(cost)
                verdicts.append(bad)
            yield pa.RecordBatch.from_arrays(
                [pa.array(costs, pa.list_(pa.float64())), pa.array(verdicts, pa.list_(pa.bool_()))],
                ["cost", "bad"],
            )

    tried = sample.mapInArrow(trial, "cost array<double>, bad array<boolean>").collect()
    order, left, open_rules = [], list(tried), list(range(len(rules)))
    while open_rules:
        gain = []
        for k in open_rules:
            spent = sum(r["cost"][k] for r in left or tried) + 1e-9
            rejected = sum(r["bad"][k] for r in left)
            gain.append((rejected / spent, -spent, k, spent, rejected))
        _, _, k, spent, rejected = max(gain)
        order.append((rules[k].name, spent, rejected))
        open_rules.remove(k)
        left = [r for r in left if not r["bad"][k]]
    return order


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (bigint), base_failed, kept.

    Null texts are empty: no word, so base_failed. A null id stays null; repeated rows are
    judged one by one; other columns are not read. An empty table gives an empty result.
    """
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, _, _ in rule_order(docs, text_col, rules, sample_rows)]
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches):
        for piece, texts in _text_rows(batches, "id", "text"):
            rows = {n: [] for n in names}
            failed, kept = [], []
            for text in texts:
                d = Measured(text)
                for n in names:
                    rows[n].append(getattr(d, n))
                failed.append(d.base_failed)
                # any() stops at the first rule that rejects
                kept.append(not d.base_failed and not any(r.rejects(d) for r in ordered))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), *(pa.array(rows[n], pa.int64()) for n in names),
                 pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                ["id", *names, "base_failed", "kept"],
            )

    longs = ", ".join(f"{n} bigint" for n in names)
    judged = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = judged.mapInArrow(judge, f"id {kind}, {longs}, base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose text passes the base test and every rule. The text
    is judged in place, so no join is needed and repeated or null ids do not matter."""
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, _, _ in rule_order(docs, text_col, rules, sample_rows)]

    def keep(batches):
        for piece, texts in _text_rows(batches, "", text_col):
            found = map(Measured, texts)
            mask = [not d.base_failed and not any(r.rejects(d) for r in ordered) for d in found]
            yield piece.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
