"""op11, op12 and op13 against plain Python, on odd inputs and on the given tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import op11_prefix_trie as trie
from sentrylake.llm import op12_lexical as lexical
from sentrylake.llm import op13_merkle as merkle
from sentrylake.llm.op11_prefix_trie import prefix_trie
from sentrylake.llm.op12_lexical import Block, ranked_search, terms_of
from sentrylake.llm.op13_merkle import edit_fingerprints, fingerprints, locate_edits, root


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- op11


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = sha(f"{len(role)}:{role}:{text}")
            own[c].append(((turn is not None, turn or 0, role, tie), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(node[:-1] for node in members if node)
    saves = {n: (len(m) - 1) * len(n[-1][1]) if n else 0 for n, m in members.items()}
    leaves, saved = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += saves[n]
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n],
         saved[n], sha(",".join(map(str, sorted(c for c in m if whole[c] == n)))))
        for n, m in members.items()
    )


def spark_trie(spark, rows):
    odd = spark.createDataFrame(
        [(*r, 1, 2, "x") for r in rows],
        "conv_id long, turn long, role string, text string, p1 int, depth int, part string",
    )
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs,
         r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in prefix_trie(odd).collect()
    )


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rng = random.Random(3)
    rows = [(None, 1, "user", "nobody's"), (250, None, None, None), (250, None, None, "é😀")]
    for c in [*range(0, 30), 100, 101, 102, 205, 399, -5, -100]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "", None])))
    # copies of one conversation, a long one and one that repeats a turn
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(6)]
    rows += [(777, t, "user", "long") for t in range(70)]
    rows += [(778, 1, "user", "again")] * 20 + [(778, 1, "user", "other")]
    rng.shuffle(rows)
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_prefix_trie_without_rows_and_without_turns(spark):
    assert spark_trie(spark, []) == []
    # crc32 of each id modulo 6 is above 0, so all of its one turn is cut off; no base exists
    ids = [c for c in range(501, 520) if zlib.crc32(str(c).encode()) % 6]
    rows = [(c, 0, "user", "x") for c in ids]
    got = spark_trie(spark, rows)
    assert got == plain_trie(rows) and len(got) == 1 and got[0][3] == len(ids)


# --- op12


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                      re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(plain_terms(text)), []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items() if t in c
            )
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def spark_search(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs],
                              "doc_id long, text string, n int, terms string")
    i = spark.createDataFrame([(*r, 1, "y") for r in items],
                              "item_id long, text string, rank int, row string")
    got = ranked_search(d, i, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def odd_documents(n=120):
    rng = random.Random(5)
    words = ["the", "The", "a", "été", "ÉTÉ", "x1", "2024", "zebra", "𝒳", "lion", "cat's", "_"]
    docs = [(i, " ".join(rng.choices(words, weights=[40, 20, 30, 5, 5, 3, 3, 1, 1, 2, 3, 2],
                                     k=rng.randint(1, 40)))) for i in range(n)]
    docs += [(900, "the lion"), (901, "the lion"), (901, "the lion"), (None, "the lion")]
    return docs + [(902, None), (903, ""), (904, " .,_ "), (905, "lion " * 3000)]


ITEMS = [(1, "The zebra, the LION and the cat"), (2, None), (3, ""), (4, "nothing known here"),
         (None, "a été"), (1, "zebra"), (6, "the the the a")]


@pytest.mark.parametrize("options", [{}, {"block_postings": 40}, {"group_terms": 3, "k": 3}])
def test_ranked_search(spark, options):
    docs = odd_documents()
    assert spark_search(spark, docs, ITEMS, **options) == plain_search(
        docs, ITEMS, options.get("k", 10)
    )


def test_ranked_search_on_empty_tables(spark):
    assert spark_search(spark, [], ITEMS) == []
    assert spark_search(spark, odd_documents(5), []) == []
    assert spark_search(spark, [(1, None), (2, "")], ITEMS) == []


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PART_BYTES", 7)
    text = "Aé ,b" * 50 + "long" * 30
    parts = list(terms_of(text.encode()))
    assert len(parts) > 5
    assert [t.decode() for p in parts for t in p] == plain_terms(text)


def test_few_accumulators_give_the_same_best():
    """Accumulators stop being made, and the k best are still those of all documents."""
    rng = np.random.default_rng(7)
    rows, vocabulary, k = 3000, 12, 5
    limited = 0
    for trial in range(20):
        share = 1 / (1 + np.arange(vocabulary)) ** 1.3
        terms, counts = [], []
        for _ in range(rows):
            got = np.flatnonzero(rng.random(vocabulary) < share)
            terms.append(got)
            counts.append(len(got))
        flat = np.concatenate(terms)
        tfs = rng.integers(1, 6, len(flat))
        n = rng.integers(5, 60, rows)
        df = np.bincount(flat, minlength=vocabulary)
        weight = np.floor(1000 * np.log((2 * rows + 2) / (2 * df + 1))).astype(np.int64)
        block = Block(n, np.array(counts), flat, tfs, weight, rows, int(n.sum()))
        full = np.zeros(rows, np.int64)
        np.add.at(full, block.doc, block.adds)
        order = np.argsort(df, kind="stable")
        got, scores = block.search(order, np.ones(vocabulary, np.int64), k, 0)
        assert (scores == full[got]).all()
        best = np.lexsort((np.arange(rows), -full))[:k]
        top = got[np.lexsort((got, -scores))[:k]]
        assert top.tolist() == best.tolist()
        limited += len(got) < np.count_nonzero(full)
    assert limited == 20


# --- op13


def plain_fingerprint(text):
    sections, now = [], ""
    pieces = re.findall(merkle.PARAGRAPH, text)
    assert "".join(pieces) == text
    for p in pieces:
        now += f"{sha(p)}.{len(p)},"
        if sha(p)[0] == "0" or p.endswith("\n\n"):
            sections.append(now)
            now = ""
    sections += [now] if now else []
    short = [sha(s)[:16] + "=" + re.sub("([0-9a-f]{16})[0-9a-f]{48}", r"\1", s) for s in sections]
    return sha("".join(map(sha, sections))) + ":" + "/".join(short)


def plain_likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0
    parts = [{p for s in x[65:].split("/") for p in s.split("=")[-1].split(",") if p}
             for x in (a, b)]
    size = lambda ps: sum(int(p.split(".")[1]) for p in ps)
    return 2 * size(parts[0] & parts[1]) / (size(parts[0]) + size(parts[1]))


def plain_edits(docs):
    """docs in descending order."""
    out = []
    for at, (i, text) in enumerate(docs):
        text, after = text or "", docs[(at + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine, new, other = map(plain_fingerprint, (text, edited, after))
        out.append((i, len(text), sha(edited), mine, new, plain_likeness(mine, new),
                    plain_likeness(mine, other)))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(11)
    words = ["one", "two. ", "Drei!\n", "été ", "😀", "\n\n", "... ", "x" * 90, " "]
    docs = [(i, "".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40, 0, -1)]
    docs[3] = (docs[3][0], None)
    docs[5] = (docs[5][0], "y" * 5000)
    docs[7] = (docs[7][0], docs[8][1])
    return docs


def spark_edits(spark, docs, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs],
                                  "doc_id long, text string, __h int, id string")
    got = edit_fingerprints(frame, **options)
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("range_rows", [2000, 3])
def test_edit_fingerprints(spark, range_rows):
    docs = odd_texts()
    shuffled = random.Random(1).sample(docs, len(docs))
    assert spark_edits(spark, shuffled, range_rows=range_rows) == plain_edits(docs)


@pytest.mark.parametrize("range_rows", [2000, 2])
def test_rows_of_one_id_and_without_id(spark, range_rows):
    same = [(7, f"text {n}. " * 9) for n in range(12)]
    none = [(None, f"none {n}. " * 5) for n in range(9)]
    hashes = {r.text: r.h for r in spark.createDataFrame(same + none, "i long, text string")
              .select("text", F.xxhash64("text").alias("h")).collect()}
    down = lambda rows: sorted(rows, key=lambda r: -((hashes[r[1]] % 2**64) >> 11))
    docs = [(9, "first")] + down(same) + [(7, down(same)[-1][1])] * 3 + [(1, "low")] + down(none)
    shuffled = random.Random(2).sample(docs, len(docs))
    assert spark_edits(spark, shuffled, range_rows=range_rows) == plain_edits(docs)


def test_few_rows(spark):
    assert spark_edits(spark, []) == []
    for docs in ([(1, "abc. def")], [(1, None)], [(None, "")], [(2, "a"), (1, "")]):
        assert spark_edits(spark, docs) == plain_edits(docs)


def test_differing_branches_locate_edits(spark):
    rng = random.Random(4)
    parts = [f"Sentence {i} about {rng.random()}. " for i in range(300)]
    changed = list(parts)
    changed[150] = "Something else altogether. "
    changed.insert(200, "Put in between! ")
    old, new = "".join(parts), "".join(changed)
    frame = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, "")],
                                  "doc_id long, old string, new string")
    prints = fingerprints(frame, "doc_id", "old").selectExpr("doc_id", "fingerprint as a").join(
        fingerprints(frame, "doc_id", "new").selectExpr("doc_id", "fingerprint as b"), "doc_id"
    )
    assert {r.doc_id for r in prints.filter(root(F.col("a")) == root(F.col("b"))).collect()} == {2, 3}
    edits = {new[r.start : r.start + r.length] for r in
             locate_edits(prints, "doc_id", "a", "b").collect()}
    assert edits == {p for p in re.findall(merkle.PARAGRAPH, new)
                     if p not in re.findall(merkle.PARAGRAPH, old)}


def test_merkle_plan_is_native(spark, sf):
    from sentrylake.llm.catalog import QUERIES

    plan = QUERIES["op13_merkle_fingerprints"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
