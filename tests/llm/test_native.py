"""Mixing and sharding: the laws they promise, odd inputs, and no Python in their plans."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sentrylake.llm.catalog import QUERIES
from sentrylake.llm.op2_mixing import SPAN, in_mix_order, mix, schedule, shares
from sentrylake.llm.op7_sharding import communication_matrix, shuffle_into_shards, with_digest

DOCS = "doc_id bigint, text string, source string, slot string, __k int"


def odd_rows(n=300):
    """A hot source, null ids, null sources, repeated rows, columns with the operators' names."""
    rows = [(i, f"text {i}", "big" if i % 3 else f"s{i % 5}", "mine", 1) for i in range(n)]
    rows += [(None, "no id", None, "mine", 1), (None, None, "", "mine", 1)]
    return rows + [(7, "text 7", "big", "mine", 1)] * 5


def plain_schedule(blocks, share):
    """Slot of each block by the tree, then earliest deadline first in spans, twice."""
    total = sum(share.values())
    hashed = sorted(share, key=lambda s: (-math.floor(8 * math.log2(share[s])), s))
    middle, upto = {}, 0
    for s in hashed:
        middle[s] = Fraction(2 * upto + share[s], 2 * total)
        upto += share[s]

    def slots(sources, low, size):
        """Source of each slot of the node over [low, low + size), block by block."""
        if len(sources) == 1:
            return lambda s, k: k
        first = [s for s in sources if middle[s] < low + size / 2]
        rest = [s for s in sources if middle[s] >= low + size / 2]
        if not first or not rest:
            return slots(sources, low if first else low + size / 2, size / 2)
        one, two = slots(first, low, size / 2), slots(rest, low + size / 2, size / 2)
        whole = sum(share[s] for s in sources)

        def up(s, k):
            k = one(s, k) if s in first else two(s, k)
            part = sum(share[x] for x in (first if s in first else rest))
            at = Fraction((2 * k + 1) * whole, 2 * part)
            return math.ceil(at) - 1 if s in first else math.floor(at)

        return up

    up = slots(list(share), Fraction(0), Fraction(1))
    placed = {(s, k): up(s, k) for s, n in blocks.items() for k in range(n)}
    release = {(s, k): k * total // share[s] for s, k in placed}
    due = {(s, k): -(-(k + 1) * total // share[s]) for s, k in placed}
    for offset in (0, SPAN // 2):
        spans, now = defaultdict(list), {}
        for b, at in placed.items():
            spans[(at + offset) // SPAN].append(b)
        for jobs in spans.values():
            waiting = sorted(jobs, key=lambda b: (due[b], release[b], b))
            for t in sorted(placed[b] for b in jobs):
                ready = [b for b in waiting if release[b] <= t]
                b = ready[0] if ready else min(
                    waiting, key=lambda b: (release[b], waiting.index(b)))
                waiting.remove(b)
                now[b] = t
        placed = now
    return {b: (placed[b], release[b], due[b]) for b in placed}


WEIGHTS = [{"a": 5, "b": 2, "c": 1}, {"a": 3, "b": 13}, {"x": 16}, {"a": 1, "b": 1, "c": 7, "d": 7},
           {"big": 0.995, **{f"r{i}": 0.0001 * (1 + i % 3) for i in range(25)}},
           {f"s{i}": 1 / (1 + i) for i in range(40)}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_schedule_is_pfair(spark, weights):
    """Slot by slot against plain Python; every source less than one block off its target."""
    every = sum(weights.values())
    blocks = {s: math.ceil(900 * w / every) for s, w in weights.items()}
    sizes = spark.createDataFrame(list(blocks.items()), "source string, n bigint")
    share = {r.source: r.share for r in shares(sizes, weights).collect()}
    total = sum(share.values())
    for s, w in weights.items():
        assert abs(share[s] / total - w / every) < 1e-8
    rows = schedule(sizes, weights, 1).collect()
    got = {(r.source, r.block): (r.slot, r.release, r.deadline) for r in rows}
    assert len(got) == len(rows) == len({r.slot for r in rows}) == sum(blocks.values())
    assert got == plain_schedule(blocks, share)
    slots = {at: s for (s, _), (at, _, _) in got.items()}
    done, last = Counter(), min(max(at for (s, _), (at, *_) in got.items() if s == x) for x in share)
    for t in range(last + 1):
        done[slots[t]] += 1
        assert all(abs(done[s] - (t + 1) * h / total) < 1 for s, h in share.items())
    assert all(release <= at < due for at, release, due in got.values())


def test_many_sources(spark):
    """5,000 sources, one of half of the weight, rare ones among them."""
    weights = {f"s{i}": 1 / (1 + i) ** 2 for i in range(4999)}
    weights["half"] = sum(weights.values())
    every = sum(weights.values())
    rows = [(s, max(1, math.ceil(20_000 * w / every))) for s, w in weights.items()]
    sizes = spark.createDataFrame(rows, "source string, n bigint")
    given = spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = schedule(sizes, given, 1)
    worst = got.selectExpr(
        "count(*) as n", "count(distinct slot) as slots", "count_if(slot < 20000) as early",
        "avg(if(slot >= release and slot < deadline, 1, 0)) as inside",
        f"max(abs(slot * share / {1 << 30} - block - 0.5 + share / {1 << 31})) as off",
    ).first()
    assert worst.n == worst.slots == sum(n for _, n in rows)
    assert worst.early > 19_900 and worst.inside > 0.999
    assert worst.off < 0.5 + 0.6


def test_weights(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 90), ("c", 1)], "source string, n bigint")
    got = {r.source: r.share for r in shares(sizes, {"a": 1, "b": 1, "c": 2, "d": 9}).collect()}
    assert got == {"a": 1 << 28, "b": 1 << 28, "c": 1 << 29}
    assert shares(sizes, {"a": 0, "b": -1}).count() == 0
    tempered = {r.source: r.share for r in shares(sizes).collect()}
    assert abs(tempered["a"] / tempered["b"] - 10**0.7) < 1e-4


def test_mix_keeps_every_row(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    rows = mix(docs, block_rows=4).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(
        str(r[0]) for r in odd_rows()
    )
    assert len({(r.slot, r.place) for r in rows}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source or ""].append(r)
    for own in by_source.values():
        places = sorted((r.block, r.place) for r in own)
        assert places == [(i // 4, i % 4) for i in range(len(own))]
    last = max(r.slot for r in rows if r.in_mix)
    assert all(r.in_mix == (r.slot <= last) for r in rows)
    again = mix(docs.repartition(5), block_rows=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_order_and_weights(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    kept = in_mix_order(docs, weights={"big": 1.0, "s0": 1.0}, block_rows=1)
    assert kept.columns == docs.columns
    assert {r.slot for r in kept.collect()} == {"mine"}
    sources = [r.source for r in kept.collect()]
    assert set(sources) == {"big", "s0"}
    n = min(Counter(sources).values())
    for i in range(1, 2 * n + 1):
        assert abs(sources[:i].count("s0") - i / 2) < 1


def test_mix_of_nothing(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_are_exact(spark):
    rows = shuffle_into_shards(
        spark.createDataFrame(odd_rows(), DOCS), ["doc_id", "text"], shards=7
    ).collect()
    assert len(rows) == len(odd_rows())
    assert Counter(map(str, (r.doc_id for r in rows))) == Counter(str(r[0]) for r in odd_rows())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(7))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame(odd_rows()[:3], DOCS)
    rows = shuffle_into_shards(docs, ["doc_id"], shards=16).collect()
    assert len({r.shard for r in rows}) == 3 and {r.slot for r in rows} == {0}
    assert shuffle_into_shards(docs.limit(0), ["doc_id"]).count() == 0


def test_matrix_is_hypergeometric(spark):
    """Mean and variance of the counts over many seeds, and exact sums."""
    counts = spark.createDataFrame([(0, 40), (1, 10), (2, 0), (3, 50)], "bucket int, n bigint")
    first = []
    for seed in range(150):
        rows = {r.bucket: r.to_shard for r in communication_matrix(counts, 2, 4, seed).collect()}
        assert [sum(rows[b]) for b in range(4)] == [40, 10, 0, 50]
        assert [sum(rows[b][k] for b in range(4)) for k in range(4)] == [25] * 4
        first.append(rows[0][1])
    mean = sum(first) / len(first)
    variance = sum((x - mean) ** 2 for x in first) / len(first)
    true = 40 * 0.25 * 0.75 * 60 / 99
    assert abs(mean - 10) < 4 * math.sqrt(true / len(first))
    assert 0.65 * true < variance < 1.45 * true


def test_digest_of_null(spark):
    rows = with_digest(spark.createDataFrame([(1, None), (2, ""), (3, "é")], "doc_id int, text string"))
    assert [(r.size, r.text_crc32) for r in rows.orderBy("doc_id").collect()][:2] == [(1, 0), (1, 0)]
    assert rows.filter("doc_id = 3").first().size == 3


@pytest.mark.parametrize("name", ["op2_pfair_mix", "op7_hypergeometric_shards"])
def test_no_python_in_the_plan(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExternalRDD"))


def test_shard_query_columns(spark, sf):
    df = QUERIES["op7_hypergeometric_shards"](spark, sf)
    assert dict(df.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
        "shard": "int", "slot": "bigint", "grown_shard": "int",
    }
    gaps = df.groupBy("shard").agg((F.max("slot") - F.count("*")).alias("gap"))
    assert [r.gap for r in gaps.select("gap").distinct().collect()] == [-1]
