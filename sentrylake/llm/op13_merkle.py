"""Document fingerprints: a Merkle tree over paragraphs and sections of each text.

A paragraph is the stretch up to and including a line break or a sentence end, 400 code points at
most; put together again the paragraphs are the text. A section ends behind a blank line or a
paragraph whose hash begins with the digit 0 (one in 16), so that sections find each other again
behind an inserted or deleted paragraph. A section's hash covers the hashes and lengths of its
paragraphs, the root covers the sections' hashes: equal roots mean equal texts, and walking down
only where hashes differ leads to the paragraphs that differ.

A fingerprint is text: root ':' section '/' section ..., a section being hash '=' paragraph ','
paragraph ',' ..., a paragraph being hash '.' length. The root has all 64 digits of its SHA-256,
the others are written with 16 (the tree itself is built from whole hashes).

DataFrame and SQL functions only. Hashing needs no exchange; pairing each document with the next
one takes one exchange of the texts by ranges of the id.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed by the format of the fingerprint.
PARAGRAPH = r"[^\n.!?]{0,400}[\n.!?]+|[^\n.!?]{1,400}"
# Rows of a range of ids, and the largest number of ranges (their bounds go to every task).
RANGE_ROWS = 2_000
MAX_RANGES = 1 << 16
_LEVEL = 256


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows plus a column with the fingerprint of the column `text` (null: empty)."""
    own = rows.columns
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    # '/' stands behind the last paragraph of a section
    leaves = f"""transform(__pieces, p -> transform(array(sha2(p, 256)), h -> concat(
        h, '.', cast(length(p) as string), ',',
        if(startswith(h, '0') or endswith(p, '\\n\\n'), '/', '')))[0])"""
    return (
        rows.withColumn("__pieces", pieces)
        .withColumn("__tree", F.array_join(F.expr(leaves), ""))
        .withColumn("__sections", F.filter(F.split("__tree", "/"), lambda s: s != ""))
        .withColumn("__hashes", F.transform("__sections", lambda s: F.sha2(s, 256)))
        .select(
            *own,
            F.concat(
                F.sha2(F.array_join("__hashes", ""), 256),
                F.lit(":"),
                F.array_join(
                    F.zip_with("__hashes", "__sections", lambda h, s: F.concat(
                        F.substring(h, 1, 16), F.lit("="),
                        F.regexp_replace(s, "([0-9a-f]{16})[0-9a-f]{48}", "$1"))),
                    "/",
                ),
            ).alias(name),
        )
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars (code points) and fingerprint.

    A null text counts as empty; an empty text has a root and no section. Null ids and repeated
    rows are kept as they are, other columns are not read, an empty table gives an empty result,
    and a text of any length is hashed as a whole.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return with_fingerprint(rows, "__text", "fingerprint").select(
        id_col, F.length("__text").cast("long").alias("n_chars"), "fingerprint"
    )


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def _paragraphs(fingerprint: str) -> str:
    """SQL of the array of different paragraphs ('hash.length') of a fingerprint."""
    return (f"array_distinct(filter(split(regexp_replace(substr({fingerprint}, 66), "
            f"'[0-9a-f]+=|/', ''), ','), x -> x != ''))")  # fmt: skip


def likeness(a: str, b: str) -> Column:
    """How alike two columns of fingerprints are, from 0 to 1: 1 where the roots are equal, else
    twice the length of the paragraphs in both over the length of the paragraphs of either, each
    different paragraph counted once."""
    length = "aggregate({}, 0L, (n, x) -> n + cast(split(x, '[.]')[1] as bigint))"
    both = length.format(f"array_intersect({_paragraphs(a)}, {_paragraphs(b)})")
    all_ = f"({length.format(_paragraphs(a))} + {length.format(_paragraphs(b))})"
    return F.expr(
        f"case when substr({a}, 1, 64) = substr({b}, 1, 64) then 1.0D "
        f"else 2.0D * {both} / {all_} end"
    )


def locate_edits(pairs: DataFrame, id_col: str, old: str, new: str) -> DataFrame:
    """pairs (id, old and new fingerprint) -> id, section, start, length: the paragraphs of the new
    text that the old one does not have, by their offset in code points.

    Pairs with equal roots give nothing; only sections whose hash the old tree lacks are opened.
    Deleted paragraphs leave no row. Ids should be unique; a null fingerprint gives nothing.
    """
    def sections(side):
        return f"filter(split(substr({side}, 66), '/'), s -> s != '')"

    changed = pairs.filter(F.substring(old, 1, 64) != F.substring(new, 1, 64)).select(
        id_col,
        F.expr(f"transform({sections(old)}, s -> split(s, '=')[0])").alias("__known"),
        F.expr(_paragraphs(old)).alias("__old"),
        F.posexplode(F.expr(sections(new))).alias("section", "__section"),
    )
    before = Window.partitionBy(id_col).orderBy("section").rowsBetween(
        Window.unboundedPreceding, -1
    )
    lengths = """aggregate(filter(split(split(__section, '=')[1], ','), x -> x != ''), 0L,
                           (n, x) -> n + cast(split(x, '[.]')[1] as bigint))"""
    opened = (
        changed.withColumn("__n", F.expr(lengths))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .filter("not array_contains(__known, split(__section, '=')[0])")
        .select(
            id_col, "section", "__start", "__old",
            F.expr("posexplode(filter(split(split(__section, '=')[1], ','), x -> x != ''))")
            .alias("__at", "__paragraph"),
        )
        .withColumn("length", F.expr("cast(split(__paragraph, '[.]')[1] as bigint)"))
    )
    inside = Window.partitionBy(id_col, "section").orderBy("__at").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        opened.withColumn(
            "start", F.col("__start") + F.coalesce(F.sum("length").over(inside), F.lit(0))
        )
        .filter("not array_contains(__old, __paragraph)")
        .select(id_col, "section", "start", "length")
    )


def _with_range(rows: DataFrame, range_rows: int) -> DataFrame:
    """rows (id, text) plus __h, a hash of the text, and __part, which grows with (id, __h); null
    ids come first. An id that fills several ranges is cut by __h."""
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")
    ).first()
    ranges = min(max(math.ceil((seen["n"] - seen["nulls"]) / range_rows), 1), MAX_RANGES)
    bounds = [0]
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = rows.agg(F.percentile_approx("id", cuts, 50 * ranges)).first()[0]

    # Two short searches instead of one over all bounds; as JSON they fold to one constant.
    def array(values):
        return f"from_json('{json.dumps(values)}', 'array<bigint>')"

    def below(values, op):
        return f"size(filter({values}, b -> b {op} id))"

    def place(op):
        near = f"slice({array(bounds)}, {_LEVEL} * greatest(top - 1, 0) + 1, {_LEVEL})"
        return (f"transform(array({below(array(bounds[::_LEVEL]), op)}), top -> "
                f"{_LEVEL} * greatest(top - 1, 0) + {below(near, op)})[0]")  # fmt: skip

    nulls = min(math.ceil(seen["nulls"] / range_rows), MAX_RANGES)
    share = f"(__h / {2.0**53!r}D)"
    return (
        rows.withColumn("__h", F.expr("shiftrightunsigned(xxhash64(text), 11)"))
        .withColumn("__lo", F.expr(place("<")))
        .withColumn("__hi", F.expr(place("<=")))
        .withColumn("__part", F.expr(
            f"cast(if(id is null, floor({share} * {nulls}) - {nulls}, "
            f"__lo + floor((__hi - __lo + 1) * {share})) as int)"))
        .drop("__lo", "__hi")
    )


def _in_descending_order() -> Window:
    return Window.partitionBy("__part").orderBy(
        "__guest", F.desc_nulls_last("id"), F.desc("__h")
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """id and text (null: empty) of every row of docs with next_text, the text of the next row by
    descending id; the first row follows the last. Rows of one id come in the order of a hash of
    their text, null ids last. Also holds, for _next_of, one more row per range (__guest): the
    first row of the range below, which the last row of a range has as its next."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ranged = _with_range(rows, range_rows)
    # At most two times MAX_RANGES rows of three numbers.
    firsts = ranged.groupBy("__part").agg(
        F.max(F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "__h")).alias("first")
    )
    by_part = Window.orderBy(F.desc("__part"))
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = firsts.select(
        "__part", "first",
        F.coalesce(F.lag("__part").over(by_part), F.last("__part").over(whole)).alias("__host"),
    )
    texts = (
        ranged.join(F.broadcast(guests), "__part")
        .filter("coalesce(id, -9223372036854775808L) = first.id and __h = first.__h")
        .select("__part", "__host", "id", "text", "__h")
        # repeated rows are the same text: one of them is enough
        .dropDuplicates(["__part"])
        .selectExpr("id", "text", "__h", "__host as __part", "true as __guest")
    )
    every = ranged.withColumn("__guest", F.lit(False)).unionByName(texts)
    return every.withColumn("next_text", F.lead("text").over(_in_descending_order()))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.

    The edited text has its last half (rounded down) replaced by the first as many code points of
    the next text by descending id, or all of it. near_edited is the likeness of the fingerprint to
    the edited text's, near_next to the next document's. Null texts count as empty. Null ids come
    last in the order; rows of one id come by a hash of their text, equal rows are interchangeable.
    A single row is its own next. Other columns are not read. An empty table gives an empty result.
    """
    paired = with_next(docs, id_col, text_col, range_rows)
    half = "cast(length(text) div 2 as int)"
    edited = paired.withColumn(
        "__edited",
        F.expr(f"concat(substring(text, 1, length(text) - {half}), "
               f"substring(coalesce(next_text, ''), 1, {half}))"),
    ).drop("next_text")
    printed = with_fingerprint(edited, "text", "fingerprint").withColumn(
        "n_chars", F.length("text").cast("long")
    ).drop("text")
    printed = printed.withColumn(
        "next_fingerprint", F.lead("fingerprint").over(_in_descending_order())
    ).filter("not __guest")
    both = with_fingerprint(printed, "__edited", "edited_fingerprint")
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
