"""Language, quality, toxicity and token counts against plain Python, and odd inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentrylake.llm.catalog import QUERIES
from sentrylake.llm.op1_language import ORDER, ContextTree, Languages, _runs, identify, learn
from sentrylake.llm.op6_quality import RULES, Measured, keep_good, quality, rule_order
from sentrylake.llm.op8_toxicity import fit, text_logits, toxicity, train
from sentrylake.llm.op9_tokens import PrefixCounter, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = "doc_id bigint, text string, lang string, score double, id int, key int, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, repeated rows, clashing names, a very long text."""
    long = "The river ran past the mill and nobody came to see it. " * 8000
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here"), (4, "12 34 !!"), (5, long),
            (6, "x" * 300_000), (7, "same same"), (7, "same same")]
    return spark.createDataFrame([(i, t, "en", 0.5, 1, 2, "k") for i, t in rows], ODD)


# --- language


def plain_bits(training, text):
    seen = [{} for _ in range(ORDER + 1)]
    for t in training:
        for i in range(len(t)):
            for k in range(min(i, ORDER) + 1):
                seen[k].setdefault(t[i - k : i], Counter())[t[i]] += 1
    bits = 0.0
    for i, byte in enumerate(text):
        ruled_out = set()
        for k in range(min(i, ORDER), -1, -1):
            here = seen[k].get(text[i - k : i])
            if here is None:
                continue
            left = {b: n for b, n in here.items() if b not in ruled_out}
            ruled_out |= set(here)
            if not left:
                continue
            total = sum(left.values()) + len(left)
            bits += math.log2(total / left.get(byte, len(left)))
            if byte in left:
                break
        else:
            bits += math.log2(256 - len(seen[0].get(b"", ())))
    return bits


@pytest.mark.parametrize("seed", range(3))
def test_code_lengths(seed):
    r = random.Random(seed)
    text = lambda letters: bytes(r.choice(letters) for _ in range(r.randint(0, 40)))
    training = [text(b"abc d") for _ in range(8)]
    keys, n = np.unique(_runs(training)[0], return_counts=True)
    model = Languages({"x": ContextTree(keys, n.astype(float))})
    texts = [text(b"abcd xyz") for _ in range(60)]
    got = model.lengths(texts)[:, 0]
    assert got == pytest.approx([plain_bits(training, t) for t in texts], abs=1e-3)


def test_blocks_of_a_long_text(monkeypatch):
    import sentrylake.llm.op1_language as m

    text = bytes(random.Random(1).choices(b"abcd", k=1000))
    whole = np.sort(_runs([text, b"ab"])[0])
    monkeypatch.setattr(m, "_BLOCK", 64)
    keys, owner, start = _runs([text, b"ab"])
    assert (np.sort(keys) == whole).all() and owner.tolist() == [0] * 16 + [1]
    assert start[-1] == 1000


def test_held_out_languages(spark, sf):
    got = QUERIES["op1_ppm_language"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    # a few labels are wrong on purpose
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd):
    known = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "fr"),
         (4, "ignored", None)], "doc_id int, text string, lang string")
    model = learn(known)
    assert model.names == ["de", "en"]
    rows = identify(odd, model).collect()
    assert len(rows) == odd.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 4}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows if r.doc_id == 5} == {"en"}
    none = learn(known.limit(0))
    assert {r.lang_pred for r in identify(odd, none).collect()} == {"und"}
    assert identify(odd.limit(0), model).count() == 0


# --- quality


def plain_measures(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines, earlier, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            dup += line in earlier
            earlier.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(inside)


def test_measures_against_plain_python(spark, sf):
    rows = QUERIES["op6_quality_cascade"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed
        assert r.kept == (not failed and not any(x.rejects(Measured(texts[r.doc_id])) for x in RULES))


def test_repeats_overlap():
    assert Measured("a b c a b c a b c").n_repeat_words == 9
    assert Measured("a b c d a b c").n_repeat_words == 6
    assert Measured("a a a a").n_repeat_words == 4
    assert Measured("x\nx\ny\n\n\nx").n_dup_lines == 2


def test_quality_of_odd_rows(spark, odd):
    rows = quality(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert keep_good(odd).columns == odd.columns
    good = [w for w in ("Every morning the baker walks along the old canal and greets the people "
                        "who sit on benches near the water while boats pass slowly under small "
                        "bridges toward distant towns where markets open early and children "
                        "carry bread home for breakfast before school begins in quiet streets "
                        "full of trees").split()]  # fmt: skip
    rows = [(1, " ".join(good)), (1, " ".join(good)), (2, "% " * 80), (None, " ".join(good))]
    assert [r.doc_id for r in keep_good(spark.createDataFrame(rows, "doc_id int, text string"))
            .collect()] == [1, 1, None]
    assert quality(odd.limit(0)).count() == keep_good(odd.limit(0)).count() == 0


def test_order_does_not_change_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = rule_order(docs)
    assert sorted(n for n, _, _ in order) == sorted(r.name for r in RULES)
    assert order[0][2] > 0
    a = quality(docs, rules=RULES).filter("kept").count()
    assert a == quality(docs, rules=RULES[::-1]).filter("kept").count() == keep_good(docs).count()


# --- toxicity


def toxic_texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["la", "ri", "so", "men", "ta", "ko"]) for _ in range(3))
    bad = ["grumblefoot", "nastyface", "vilebrain"]
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 400))]
        if i % 4 == 0:
            words[r.randrange(len(words))] = r.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_toxicity_finds_words_and_misspellings():
    texts, labels = toxic_texts(1, 400)
    model = train(texts, labels)
    held, truth = toxic_texts(2, 200)
    assert ((text_logits(held, model) >= 0) == truth).mean() > 0.95
    spelled = ["larisota koso grumbelfoot taso", "men rita nastyfaces soko", "larita somenko"]
    assert (text_logits(spelled, model) >= 0).tolist() == [True, True, False]


def test_toxicity_query(spark, sf):
    rows = QUERIES["op8_subword_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, odd):
    texts, labels = toxic_texts(1, 200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    known = spark.createDataFrame(
        [(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (3, None), (9999, 1), (1, 0)],
        "doc_id bigint, toxic int",
    )
    rows = toxicity(odd, fit(docs, known)).collect()
    assert len(rows) == odd.count()
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    one_class = fit(docs, known.filter("toxic = 0"))
    assert {r.predicted for r in toxicity(odd, one_class).collect()} == {0}
    nothing = fit(docs.limit(0), known)
    assert {r.predicted for r in toxicity(odd, nothing).collect()} == {0}
    assert toxicity(odd.limit(0), nothing).count() == 0


# --- token counts


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(FILE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_every_prefix(counter, library):
    size = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    r = random.Random(1)
    parts = ["'ll", "'re", "'", "l", " ", "  ", "\n", "\n\n", "é", "日本", "<|endoftext|>", "the",
             "ing", "ab", "123", "!!", "<|", "…", "　", "\t", "İ", "aaaa", "'s", "́"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        want = [size(text[:k]) for k in range(1, len(text) + 1)]
        assert counter.prefix_counts(text) == want
        pieces, upto = counter.running(text)
        assert (upto[-1] if upto else 0) == size(text)
        for budget in (0, 1, 3, 6):
            fits = max((k for k, n in enumerate(want, 1) if n <= budget), default=0)
            assert counter.fitting(pieces, upto, budget) == fits


def test_counts_of_all_texts(spark, sf, library):
    rows = QUERIES["op9_prefix_token_counts"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = [r.doc_id for r in rows]
    want = library.encode_batch([texts[i] for i in ids], add_special_tokens=False)
    for r, e in zip(rows, want, strict=True):
        assert (r.n_tokens, r.n_bytes) == (len(e.ids), len(texts[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 512)


def test_counts_of_odd_rows(spark, odd, library):
    rows = token_counts(odd, FILE, public_tokenizers.PATTERN, 10).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_tokens, by[1].n_bytes, by[2].n_tokens) == (0, 0, 0)
    long = odd.filter("doc_id = 6").first().text
    assert by[6].n_tokens == len(library.encode(long, add_special_tokens=False).ids)
    assert token_counts(odd.filter(F.lit(False)), FILE, public_tokenizers.PATTERN, 10).count() == 0
