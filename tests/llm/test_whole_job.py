"""The stages of the pipeline do the whole job: no row lost, odd rows kept, models complete."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylake.llm import op5_pitman_yor as lm
from sentrylake.llm.op8_toxicity import fit, toxicity, training_sample


def written(spark, df, path):
    df.write.parquet(f"file://{path}")
    return spark.read.parquet(f"file://{path}")


def test_mixing_keeps_surplus_and_shards_follow_the_mix(spark, sf, tmp_path):
    """One source of a third of the rows and 19 equal ones."""
    rows = [(i, f"text {i}", "hot" if i % 3 == 0 else f"s{i % 19}") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed_docs = corpus_pipeline.mixing(spark, docs, sf)
    mixed = mixed_docs.collect()
    assert sorted(r.doc_id for r in mixed) == list(range(12_000))
    place = {r.doc_id: i for i, r in enumerate(mixed)}
    sharded = corpus_pipeline.sharding(spark, written(spark, mixed_docs, tmp_path / "mix"), sf)
    assert sharded.columns == [*docs.columns, "shard", "slot"]
    by_shard = {}
    for r in sharded.collect():
        by_shard.setdefault(r.shard, []).append((r.slot, place[r.doc_id], r.source))
    assert Counter(map(len, by_shard.values())) == {750: 16}
    for own in by_shard.values():
        own.sort()
        assert [slot for slot, _, _ in own] == list(range(750))
        assert [at for _, at, _ in own] == sorted(at for _, at, _ in own)
    # 4,000 ** 0.7 against 19 times 421 ** 0.7, less than a third of the rows
    first = sum(r.source == "hot" for r in mixed[:6000]) / 6000
    assert 0.17 < first < 0.23


CLASHING = """doc_id bigint, text string, source string, slot string, shard string, share int,
    block int, place string, in_mix string, release int, deadline int, mix_file string"""


@pytest.mark.parametrize("rows", [0, 40])
def test_stages_on_odd_rows(spark, sf, tmp_path, rows):
    """Null ids, texts and sources, repeated rows, columns with the names that stages add."""
    own = ("a", "b", 1, 2, "c", "d", 3, 4, "e")
    r = np.random.default_rng(1)
    words = [a + b + c for a in ("re", "the", "in", "or") for b in ("tion", "lan", "mer", "s")
             for c in ("ed", "ing", "ly", "a", "es")]

    def text():
        return ". ".join(" ".join(r.choice(words, 9)).capitalize() for _ in range(9)) + "."

    data = [(i, text(), f"s{i % 3}", *own) for i in range(rows)]
    if rows:
        data += [(None, text(), None, *own), (7, None, "s1", *own), (8, "", "s1", *own)]
        data += [data[3]] * 3
    docs = written(spark, spark.createDataFrame(data, CLASHING), tmp_path / "docs")
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf)
        if name != "sharding":
            assert out.columns == docs.columns
        after = written(spark, out, tmp_path / name)
        if name in ("mixing", "sharding"):
            drop = ("slot", "shard", "mix_file")
            plain = lambda d: sorted(map(str, d.drop(*drop).collect()))
            assert plain(after) == plain(docs)
        docs = after
    assert {"shard", "slot"} <= set(docs.columns)
    assert docs.count() == 0 if rows == 0 else docs.count() > 0


def test_giant_labelled_text_does_not_end_its_class(spark):
    """The text that comes first in the order is longer than the bound of its class."""
    first = {y: spark.range(80).filter(f"id % 2 = {y}").orderBy(F.xxhash64(F.lit(8), "id")).first().id
             for y in (0, 1)}
    filler = "the quiet garden keeps green leaves near old stone walls "
    insult = "the quiet garden blorgsnark keeps green leaves near walls "
    rows = [(i, (insult if i % 2 else filler) * (2_000 if i in first.values() else 2)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int")
    bounds = {"rows": (100, 100), "total_bytes": (60_000, 60_000)}
    got = training_sample(docs, labels, "doc_id", "text", "toxic", **bounds).collect()
    assert Counter(r.label for r in got) == {0: 40, 1: 40}
    assert all(sum(len(r.text) for r in got if r.label == y) <= 60_000 for y in (0, 1))
    scored = toxicity(docs, fit(docs, labels, **bounds)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in scored)


def test_sweeps_of_the_language_model(spark):
    """By default two sweeps go by before two are averaged."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a b b")], "doc_id bigint, text string")
    model = lm.fit(docs)
    assert len(model.past) == 5  # the start and four sweeps
    part = lm.Part(model.pairs.first().asDict(), model.layout)
    scores = lm.Scores(part, model.layout, model.fixed, model.past, model.seed)
    assert len(scores.back) == len(model.past) - 1 - lm.BURN_IN == 2
