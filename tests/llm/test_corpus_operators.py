"""Near-duplicates, decontamination, language-model scores, archives and the pipeline against
plain Python, and odd inputs."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylake.llm import op5_pitman_yor as lm
from sentrylake.llm.catalog import QUERIES, SQL
from sentrylake.llm.op3_templates import contaminated, without_contaminated
from sentrylake.llm.op4_simhash import (
    covering_masks,
    fingerprint,
    keep_one_of_each,
    near_duplicates,
    near_links,
)
from sentrylake.llm.op6_quality import RULES, Measured
from sentrylake.llm.op10_warc import (
    archive_round_trip,
    mark_repeats,
    normalise,
    read_records,
    record_parts,
    write_archives,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- SimHash


def plain_fingerprint(text):
    words = words_of(text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or (
        [" ".join(words)] if words else []
    )
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 4):
            a, b = find(i), find(ids[k + 1 + j])
            head[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in covering_masks(4, 64)]
    r = np.random.default_rng(4)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
        assert any(m & flips == 0 for m in masks)


def test_fingerprints(texts):
    for text in [*list(texts.values())[:40], None, "", " \n", "One", "one TWO three", "É é A\x0bb c d e"]:
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_components(spark, sf, texts):
    rows = QUERIES["op4_covering_simhash"](spark, sf).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (format(prints[i], "016x"), want[i]) for i in prints
    }


@pytest.mark.parametrize("limit", [4096, 8])
def test_crowded_keys(spark, limit):
    """A chain and a cloud of fingerprints around one point, with and without the detour by
    shared points."""
    r = np.random.default_rng(1)
    centre = 0x0123456789ABCDEF
    cloud = {centre ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(60)}
    chain = [(1 << 4 * k) - 1 for k in range(1, 12)]
    alone = [int(x) for x in r.integers(0, 1 << 63, 20)]
    values = sorted({centre, *cloud, *chain, *alone})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), limit=limit)
    mask = (1 << 64) - 1
    head = {v: v for v in values}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for u, v in links.collect():
        head[find(u & mask)] = find(v & mask)
    want = plain_components(dict(zip(values, values)))
    assert len(set(map(find, values))) == len(set(want.values()))
    for a in values:
        for b in (centre, chain[0]):
            assert (find(a) == find(b)) == (want[a] == want[b])


def test_odd_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (8, None, 1), (7, "", 1),
            (9, " ".join(f"other{i}" for i in range(60)), 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted(
        [("5", 3), ("3", 3), ("3", 3), ("None", 3), ("8", 7), ("7", 7), ("9", 9)]
    )
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    assert near_duplicates(docs.limit(0)).count() == keep_one_of_each(docs.limit(0)).count() == 0


# --- decontamination


def test_benchmark_passages(spark, sf, texts):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_template_decontamination"](spark, sf).collect()}
    squeeze = lambda t: " ".join((t or "").split())
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d, r.item_id) for d, t in texts.items() for r in items if squeeze(r.text) in squeeze(t)}
    assert want and got == want


QUESTION = "Alice Smith has 3 apples and gives Bob 5 of them to eat at home. How many apples " \
           "does Alice Smith have after 7 days if nobody buys any more?"  # fmt: skip


def test_reparameterised_questions(spark):
    other = QUESTION.replace("Alice Smith", "Carol Jones").replace("3", "12.5").replace("Bob", "Dan")
    mixed = QUESTION.replace("Alice Smith", "Carol Jones", 1).replace("7 days", "9 km")
    mixed = mixed.replace("Alice Smith", "Eve Miller").replace("Bob", "Alice")
    docs = [(1, "Some text first. " + other + " And more"), (2, QUESTION.lower()), (None, other),
            (3, "Many apples are eaten at home, and nobody buys any more of them."), (4, None),
            (5, ""), (6, " ".join(QUESTION.split()[::-1])), (1, "Some text first. " + other + " And more"),
            (8, "lorem ipsum " * 60_000 + QUESTION)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, hash int")
    items = spark.createDataFrame(
        [(1, QUESTION), (2, None), (3, "too short"), (None, QUESTION), (4, "1 2 3 4 5 6 7 8")],
        "item_id bigint, text string",
    )
    rows = contaminated(docs, items).collect()
    found = {r.doc_id: r for r in rows}
    assert {str(r.doc_id) for r in rows} == {"1", "2", "None", "8"} and {r.item_id for r in rows} == {1}
    assert found[1].reparameterised and not found[8].reparameterised
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert contaminated(docs, items.limit(0)).count() == 0
    assert contaminated(docs.limit(0), items).count() == 0


def test_items_of_numbers_in_capitals_and_in_another_case(spark):
    """Found as exact and as re-cased copies; other texts of the same words and numbers stay."""
    german = "Der Hund und die Katze liefen über die Wiese und suchten den alten Baum im Garten."
    loud = "THE QUICK BROWN FOX JUMPED OVER THE LAZY DOG NEAR THE OLD STONE BRIDGE."
    items = {1: "What is 12 + 7 * 3 ?", 2: loud, 3: german.lower(), 4: "Compute 3 4 5 6 7 8 9 now"}
    docs = {
        10: "Some words first. What is 12 + 7 * 3 ? And some after it.",
        11: f"Before. {loud} After.", 12: f"Before. {loud.capitalize()} After.",
        13: f"Erst dies. {german} Dann das.", 14: f"Erst dies. {german.upper()}",
        15: "They say: compute 3 4 5 6 7 8 9 now or never.",
        20: "What is 12 + 7 * 4 ? is another question, 12 of 7 and 3.",
        21: "The quick fox and the brown dog jumped near the stone bridge over the old lazy river.",
        22: "Der Baum im Garten und die Wiese, der alte Hund suchte die Katze.",
        23: "Compute 9 8 7 6 5 4 3 now",
    }
    found = contaminated(
        spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"),
        spark.createDataFrame(list(items.items()), "item_id bigint, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {
        (10, 1), (11, 2), (12, 2), (13, 3), (14, 3), (15, 4)
    }


def test_inconsistent_slots(spark):
    items = spark.createDataFrame(
        [(1, "we saw Rome then left Rome then saw Rome then left Rome then went home")],
        "item_id int, text string",
    )
    docs = spark.createDataFrame(
        [(1, "and we saw Pisa then left Pisa then saw Pisa then left Pisa then went home"),
         (2, "and we saw Pisa then left Bari then saw Oslo then left Kiel then went home")],
        "doc_id int, text string")
    assert [r.doc_id for r in contaminated(docs, items).collect()] == [1]


# --- language model


def test_base_scores(spark, sf, texts):
    rows = QUERIES["op5_pitman_yor_scores"](spark, sf).collect()
    tokens = {i: [*words_of(t), "\0"] for i, t in texts.items()}
    counts = Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    better = total = 0
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(
            sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9
        )
        if r.held_out:
            better += r.score > r.base_score
            total += 1
    assert better > 0.8 * total


def test_tokens_and_layout(monkeypatch):
    monkeypatch.setattr(lm, "_SEGMENT", 16)
    words, contexts, text = lm.token_arrays([b"The cat  the\tdog", b"", b"x" * 50 + b" the"])
    assert text.tolist() == [0] * 5 + [1] + [2] * 3
    assert words[0] == words[2] == words[7] and words[4] == words[5] == words[8] == 1
    assert contexts[0] == contexts[5] == contexts[6] and contexts[1] == contexts[3]


def test_probabilities_add_up(spark):
    """Over all words and the unknown one, and the same whether words are hot or not."""
    lines = ["a b a c", "a b", "b b a", "c a b a b", "", None] * 5
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    model = lm.fit(docs)
    # a text of one word under two contexts: P(w | start) P(end | w)
    probes = ["a", "b", "c", "zzz"]
    rows = lm.score(spark.createDataFrame(list(enumerate(probes)), "doc_id bigint, text string"),
                    model).collect()
    assert sum(r.n_known for r in rows) == 7
    layout, fixed, past = model.layout, model.fixed, model.past
    parts = [lm.Part(r.asDict(), layout) for r in model.pairs.collect()]
    start = lm._context(np.array([2], np.uint64))[0]
    total = 0.0
    hot_seen = set()
    for part in parts:
        scores = lm.Scores(part, layout, fixed, past, model.seed)
        for k, word in enumerate(part.words):
            if word in hot_seen:
                continue
            home = layout.part(part.words[k : k + 1], np.array([start]))[0]
            if home != part.number:
                continue
            hot_seen.add(word)
            total += 10 ** scores.look_up(part.words[k : k + 1], np.array([1]), np.array([start]))[0][0]
        unknown = np.mean([b[start] * u for b, u in zip(scores.back, scores.unknown)])
    # hot words without a pair in their home part
    missing = set(layout.hot) - hot_seen
    for word in missing:
        total += 10 ** scores.look_up(np.array([word]), np.array([1]), np.array([start]))[0][0]
    assert total + unknown == pytest.approx(1, abs=1e-9)


def test_seating():
    rng = np.random.default_rng(0)
    tables = lm.seat(np.array([1, 2, 3, 50_000, 1, 700]), np.full(6, 0.8), 0.6, rng)
    assert tables[0] == tables[4] == 1 and (tables >= 1).all() and 5 < tables[3] < 5000
    n, opening, discount = 40, 0.8, 0.6
    got = lm.seat(np.full(20_000, n), np.full(20_000, opening), discount, rng)
    shares = np.zeros(n + 1)
    shares[1] = 1
    for k in range(1, n):
        p = opening / (opening + np.maximum(k - discount * np.arange(n + 1), 0.1))
        shares[1:] = shares[1:] * (1 - p[1:]) + shares[:-1] * p[:-1]
    assert np.abs(np.bincount(got, minlength=n + 1)[: n + 1] / 20_000 - shares).max() < 0.015


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "q" * 200_000)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id bigint, text string, score double")
    model = lm.fit(docs)
    got = lm.score(docs, model).collect()
    assert len(got) == len(rows)
    assert {(r.n_tokens, r.n_known) for r in got if r.doc_id in (1, 2)} == {(1, 1)}
    assert len({r.score for r in got if r.doc_id in (3, None)}) == 1
    assert lm.score(docs.limit(0), model).count() == 0
    nothing = lm.score(docs, lm.fit(docs.limit(0))).collect()
    assert len(nothing) == len(rows) and all(abs(r.score) < 1e-9 for r in nothing)


# --- archives


def test_archives_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = con.sql(SQL["op10_warc_normaliser"])
    names = rel.columns
    got = QUERIES["op10_warc_normaliser"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def odd_pages(spark):
    big = "<p>" + "page " * 60_000
    shared = "<html>" + "same " * 40
    rows = [(4, "http://a/ü?x=1\r\nInjected: yes", shared), (2, None, shared), (2, "u", shared),
            (None, "u", shared), (9, "u", None), (8, "u", ""), (7, "u", "short"), (6, "u", "short"),
            (1, "u", big), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    return spark.createDataFrame(
        [(i, u, h, "x", 1) for i, u, h in rows],
        "page_id bigint, url string, html string, digest string, payload int",
    )


def test_a_task_for_each_archive(spark):
    from sentrylake.llm.op10_warc import _a_task_each

    manifest = spark.range(5).selectExpr("concat('a', id) as archive", "1 as records")
    tasks = _a_task_each(manifest).select(F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in tasks}) == 5


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_odd_pages(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr("sentrylake.llm.op10_warc.BROADCAST_ROWS", broadcast_rows)
    pages = odd_pages(spark)
    rows = archive_round_trip(pages, f"file://{tmp_path}").collect()
    html = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in rows) == sorted(
        (str(i), len(h), hashlib.sha256(h).hexdigest()) for i, h in html
    )
    types = {(str(r.page_id), r.record_type, r.refers_to) for r in rows}
    assert {("4", "revisit", 2), ("2", "response", None), ("None", "revisit", 2)} <= types
    assert sum(r.record_type == "revisit" for r in rows) == 2
    assert archive_round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_members_and_index(spark, tmp_path):
    """Small archives; each member is a gzip file of one record, and both forms hold the same."""
    marked = mark_repeats(odd_pages(spark).coalesce(1))
    whole = spark.createDataFrame(
        write_archives(marked, f"file://{tmp_path}/w", archive_bytes=1).collect(),
        "archive string, records bigint")
    assert whole.count() == 10 and whole.agg(F.sum("records")).first()[0] == 10
    members = spark.createDataFrame(normalise(whole, f"file://{tmp_path}/m").collect(), whole.schema)
    assert read_records(members).count() == 10
    before = b"".join(sorted(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")))
    after = b"".join(sorted(gzip.decompress(p.read_bytes()) for p in (tmp_path / "m").glob("*.gz")))
    assert before == after and b"\r\nInjected" not in before
    # what is normalised already can be normalised again
    assert read_records(normalise(members, f"file://{tmp_path}/n")).count() == 10


def test_broken_archives(tmp_path):
    import pyarrow as pa

    record = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    parts = lambda b: list(record_parts(pa.BufferReader(b)))
    assert len(parts(gzip.compress(record * 3))) == 3
    with pytest.raises(ValueError, match="ends early"):
        parts(gzip.compress(record * 3)[:-9])
    with pytest.raises(ValueError, match="within a record"):
        parts(gzip.compress(record[:-5]))


# --- pipeline


def test_pipeline(spark, sf, texts, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, kept = {}, docs
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, kept, sf)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        kept = spark.read.parquet(f"file://{tmp_path}/{name}")
        stages[name] = {r.doc_id for r in kept.collect()}
    good = set()
    for i, t in texts.items():
        d = Measured(t)
        if not d.base_failed and not any(r.rejects(d) for r in RULES):
            good.add(i)
    assert stages["quality"] == good
    heads = plain_components({i: plain_fingerprint(texts[i]) for i in good})
    assert stages["near_dedup"] == {i for i, h in heads.items() if i == h}
    squeeze = lambda t: " ".join((t or "").split())
    items = [squeeze(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in stages["near_dedup"] if not any(x in squeeze(texts[i]) for x in items)}
    assert stages["decontamination"] == clean
    assert stages["mixing"] == clean
    assert stages["sharding"] == stages["mixing"]
    sizes = Counter(r.shard for r in kept.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == stages["sharding"]
