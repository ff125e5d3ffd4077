"""Exact, linearly interpolated quantiles by selection in rounds.

The built-in exact percentile keeps every distinct value of the column in the memory of one
task. Here every round reads the stored columns in one map-side aggregate: cuts divide a column's
values into slots, each slot is counted exactly, and the slots in which a wanted rank lies are
sketched. The counts say in which slot a rank is, the sketch only proposes
the next two cuts around it, so its error costs a round and never a value. A slot that holds at
most LEAF values is listed, which ends the search: two rounds up to a million rows, one more for
every further factor of some 300. Nothing is ordered in one task, whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .staging import stage

# Proposed cuts are taken from MARKS equal steps of rank; a sketched rank is off by at most
# 1 / ACCURACY of the slot's values.
MARKS = 1000
ACCURACY = 10000
# Part of a step that a proposed cut keeps away from the wanted rank: above MARKS / ACCURACY.
_MARGIN = 0.3
# Most values of a slot that are listed.
LEAF = 4096


def quantile_name(q: float) -> str:
    return f"p{round(q * 100):d}"


@dataclass
class _Search:
    """What is known of one column's ranks. Slot 2j lies between cuts j-1 and j, both left out;
    slot 2j+1 is cut j itself."""

    open_ranks: set[int]
    cuts: list[float] = field(default_factory=list)
    sketched: set[int] = field(default_factory=set)
    listed: set[int] = field(default_factory=set)
    found: dict[int, float] = field(default_factory=dict)

    def learn(self, slots: dict[int, Row]) -> None:
        """Settle the ranks that the counted slots show, and cut closer around the others."""
        ends = list(accumulate(
            slots[s].cnt if s in slots else 0 for s in range(2 * len(self.cuts) + 1)
        ))
        near: dict[tuple[float | None, float | None], bool] = {}
        for rank in sorted(self.open_ranks):
            s = next(i for i, end in enumerate(ends) if rank < end)
            row, place = slots[s], rank - (ends[s] - slots[s].cnt)
            if s % 2:
                self.found[rank] = self.cuts[s // 2]
            elif s in self.listed:
                self.found[rank] = row.listed[place]
            else:
                between, small = self._closer(s, row, place)
                near[between] = small
        self.open_ranks -= self.found.keys()
        self.cuts = sorted({end for between in near for end in between if end is not None})
        self.sketched, self.listed = set(), set()
        for (low, high), small in near.items():
            first = 0 if low is None else 2 * bisect_left(self.cuts, low) + 2
            last = 2 * len(self.cuts) if high is None else 2 * bisect_left(self.cuts, high)
            (self.listed if small else self.sketched).update(range(first, last + 1, 2))
        self.sketched -= self.listed

    def _closer(self, s: int, row: Row, place: int) -> tuple[tuple, bool]:
        """The open interval to look at next, and whether it surely holds few values."""
        low = self.cuts[s // 2 - 1] if s else None
        high = self.cuts[s // 2] if s // 2 < len(self.cuts) else None
        if row.cnt <= LEAF or not row.marks:
            # Without marks a cut has missed its rank: the same slot again, now sketched.
            return (low, high), row.cnt <= LEAF
        at = (place + 0.5) / row.cnt * MARKS
        first, last = max(0, floor(at - _MARGIN)), min(MARKS, ceil(at + _MARGIN))
        most = ((last - first) / MARKS + 2 / ACCURACY) * row.cnt + 2
        return (row.marks[first], row.marks[last]), most <= LEAF


def _sketch(condition: str) -> Column:
    steps = [i / MARKS for i in range(MARKS + 1)]
    return F.percentile_approx(F.when(F.expr(condition), F.col("x")), steps, ACCURACY)


def _literal(x: float) -> str:
    return f"double('{x!r}')"


def _slot(search: _Search) -> str:
    if not search.cuts:
        return "0"
    cuts = ", ".join(_literal(c) for c in search.cuts)
    return (
        f"aggregate(array({cuts}), 0, (s, c) -> s + if(x > c, 2, if(x = c, 1, 0)))"
    )


def _by_column(expressions: dict[str, str], otherwise: str) -> str:
    cases = " ".join(f"when '{c}' then {e}" for c, e in expressions.items())
    return f"case name {cases} else {otherwise} end" if expressions else otherwise


def _within(slots: dict[str, set[int]]) -> str:
    tests = [
        f"(name = '{c}' and slot in ({', '.join(map(str, sorted(s)))}))"
        for c, s in slots.items() if s
    ]
    return " or ".join(tests) or "false"


def _round(values: DataFrame, open_: dict[str, _Search]) -> dict[str, dict[int, Row]]:
    """Count, sketch and list the slots of the columns still searched; at most four slots per
    wanted rank, and one. Counting stays apart, since a sketch per slot is an aggregate in Java
    objects, which sorts its rows when there are many slots."""
    names = ", ".join(f"'{c}'" for c in open_)
    slotted = values.filter(f"name in ({names}) and not isnan(x)").selectExpr(
        "name", "x", f"{_by_column({c: _slot(s) for c, s in open_.items()}, '0')} as slot"
    )
    counts = slotted.groupBy("name", "slot").agg(F.expr("count(1) as cnt"))
    sketched = _within({c: s.sketched for c, s in open_.items()})
    listed = _within({c: s.listed for c, s in open_.items()})
    looked_at = slotted.filter(f"({sketched}) or ({listed})").groupBy("name", "slot").agg(
        _sketch(sketched).alias("marks"),
        F.expr(f"sort_array(collect_list(case when {listed} then x end)) as listed"),
    )
    merged = counts.unionByName(looked_at, allowMissingColumns=True).groupBy("name", "slot").agg(
        *[F.expr(f"any_value({c}) ignore nulls as {c}") for c in ("cnt", "marks", "listed")]
    )
    out: dict[str, dict[int, Row]] = {c: {} for c in open_}
    for row in merged.collect():
        out[row["name"]][row.slot] = row
    return out


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    qs: Sequence[float],
    extra: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """One row per column name: name, n, the extra SQL aggregates over x, and p<percent> for
    each q. Null values are left out, NaN counts as larger than any number, and a column without
    a value has no row. Runs at once. Every round has to see the same values: the columns are
    written first, unless df is a stored table already."""
    if not stored:
        df = stage(df.selectExpr(*[f"cast({c} as double) as {c}" for c in columns]), "quantiles")
    pairs = ", ".join(f"struct('{c}' as name, cast({c} as double) as x)" for c in columns)
    values = df.selectExpr(f"inline(array({pairs}))").filter("x is not null")

    about = values.groupBy("name").agg(
        F.expr("count(1) as n"),
        *[F.expr(e) for e in extra],
        F.expr("count_if(isnan(x)) as __nans"),
        _sketch("not isnan(x)").alias("__marks"),
    )
    known = about.collect()
    searches = {}
    for row in known:
        ends = {side(q * (row.n - 1)) for q in qs for side in (floor, ceil)}
        numbers = row.n - row["__nans"]
        search = _Search({r for r in ends if r < numbers})
        search.found.update({r: float("nan") for r in ends if r >= numbers})
        search.learn({0: Row(cnt=numbers, marks=row["__marks"], listed=[])})
        searches[row["name"]] = search
    while open_ := {c: s for c, s in searches.items() if s.open_ranks}:
        for column, slots in _round(values, open_).items():
            open_[column].learn(slots)

    def quantile(row: Row, q: float) -> float:
        at = q * (row.n - 1)
        low, high = (searches[row["name"]].found[side(at)] for side in (floor, ceil))
        return low if low == high else low + (high - low) * (at - floor(at))

    kept = [f for f in about.schema.fields if not f.name.startswith("__")]
    schema = StructType([*kept, *[StructField(quantile_name(q), DoubleType()) for q in qs]])
    rows = [(*[row[f.name] for f in kept], *[quantile(row, q) for q in qs]) for row in known]
    return df.sparkSession.createDataFrame(rows, schema)
