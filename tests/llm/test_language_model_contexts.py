"""Every previous word has a restaurant of its own, hot or not, in the part of a pair or elsewhere."""

import math
from collections import defaultdict

import numpy as np
import pytest

from sentrylake.llm import op5_pitman_yor as lm


def scores_of(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {texts[r.doc_id]: r for r in lm.score(docs, model).collect()}


# "W3" and "W9" stand for two words that shared one of 65,536 contexts by the former 16-bit hash.
SHARED = {"W3": "w7", "W9": "w225"}


@pytest.mark.parametrize("hot", [1, 10_000])
def test_scores_equal_closed_form(spark, monkeypatch, hot):
    """One text of different words: every pair is met once, so that no seating is random."""
    monkeypatch.setattr(lm, "HOT", hot)  # 1: no word is hot
    words = [SHARED.get(f"W{i}", f"x{i}") for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    model = lm.fit(docs)
    n, d, d1 = len(words) + 1, model.fixed.discount, model.fixed.discount1
    assert d == 0.95
    known = {*words, None}
    pairs = set(zip(["start", *words], [*words, None], strict=True))
    below = (1 + d1 * n) / (n + 1)

    def chance(word, before):
        parent = ((1 - d1 if word in known else 0) + below) / (1 + n)
        back = (1 + d) / 2 if before == "start" or before in words else 1.0
        return ((before, word) in pairs) * (1 - d) / 2 + back * parent

    probes = [" ".join(words), "", "zz", "zz zz x5", f"{words[3]} {words[10]} {words[9]} {words[4]}",
              f"{words[9]} {words[10]} zz {words[3]}", " ".join(reversed(words))]
    got = scores_of(spark, model, probes)
    for probe in probes:
        own = probe.split()
        expected = sum(
            math.log10(chance(w, b))
            for w, b in zip([*own, None], ["start", *own], strict=True)
        )
        assert got[probe].score == pytest.approx(expected, rel=1e-9)
        assert got[probe].n_known == 1 + sum(w in known for w in own)


def test_tables_of_the_homes_are_those_of_the_pairs(spark, monkeypatch):
    """Without hot words: the probabilities of all words after any word add up to one."""
    monkeypatch.setattr(lm, "HOT", 1)
    rng = np.random.default_rng(3)
    lines = [" ".join(f"v{int(i)}" for i in rng.geometric(0.08, 40)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    model = lm.fit(docs)
    assert not len(model.layout.hot)
    replies = defaultdict(list)
    for row in model.said.filter(f"kind in ({lm.REPLY}, {lm.SAMPLE})").collect():
        replies[row.part].append(row.asDict())
    total, back, parents, moved = defaultdict(float), {}, 0.0, False
    for row in model.pairs.collect():
        part = lm.Part(row.asDict(), model.layout, replies[row.part])
        scores = lm.Scores(part, model.layout, model.fixed, model.past, model.seed)
        shares = np.stack([b.values for b in scores.back])
        chances = np.stack(scores.parent)
        parents = parents + chances.sum(1)
        through = (shares[:, part.contexts] * chances[:, part.of_word]).mean(0)
        names = np.append(model.layout.hot_contexts, part.cold)
        for code, value in zip(part.contexts, 10**scores.known_pairs - through, strict=True):
            total[names[code]] += value
            back[names[code]] = shares[:, code]
        told = lm.Replies(part.replies, part.places, len(model.past)).tables
        moved = moved or any((t != told[0]).any() for t in told)
    assert moved and len(total) > 40
    np.testing.assert_allclose(parents + np.array(scores.unknown), 1, atol=1e-9)
    for context, value in total.items():
        assert value + back[context].mean() == pytest.approx(1, abs=1e-9)
