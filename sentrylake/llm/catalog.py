"""The registered queries of this package. SQL maps a query to DuckDB SQL where there is one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import run_folder
from .common import id_remainder, table
from .op1_language import identify, learn
from .op2_mixing import mix
from .op3_templates import contaminated
from .op4_simhash import near_duplicates
from .op5_pitman_yor import fit as fit_pitman_yor
from .op5_pitman_yor import score as pitman_yor_score
from .op6_quality import quality
from .op7_sharding import shuffle_into_shards, with_digest
from .op8_toxicity import fit, toxicity
from .op9_tokens import token_counts
from .op10_warc import archive_round_trip
from .op11_prefix_trie import prefix_trie
from .op12_lexical import ranked_search
from .op13_merkle import PARAGRAPH, edit_fingerprints

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ppm_language(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), id_remainder("doc_id", 4) == 2
    found = identify(docs, learn(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


@query
def op2_pfair_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents").select("doc_id", "source"))


@query
def op3_template_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "reparameterised")


@query
def op4_covering_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query
def op5_pitman_yor_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), id_remainder("doc_id", 7) == 2
    scored = pitman_yor_score(docs, fit_pitman_yor(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score", "perplexity")


@query
def op6_quality_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"))


@query
def op7_hypergeometric_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_digest(table(spark, sf, "documents"))
    return shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_subword_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), id_remainder("doc_id", 5) == 0
    model = fit(docs, table(spark, sf, "labels").filter(~held_out))
    scored = toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_prefix_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(
        table(spark, sf, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        budget=512,
    )


@query
def op10_warc_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{run_folder(spark)}/warc-{uuid.uuid4().hex}"
    return archive_round_trip(table(spark, sf, "pages"), folder)


SQL["op10_warc_normaliser"] = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), f as (
  select body, min(page_id) as first_id from p where strlen(body) >= 100 group by body
)
select page_id, strlen(p.body) as payload_bytes, sha256(p.body) as payload_digest,
  case when first_id is not null and page_id is distinct from first_id
       then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from p left join f on p.body = f.body
"""


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(table(spark, sf, "conversations"))


# crc32 bit by bit: the text's bytes, each followed by eight steps of the polynomial.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
    string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda crc, byte:
  list_reduce(list_prepend(xor(crc, byte), range(8)), lambda t, i:
    xor(t >> 1, (t & 1) * 3988292384))), 4294967295)"""

SQL["op11_prefix_trie"] = f"""
with ranked as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':'
             || coalesce(text, ''))) as d
  from conversations where conv_id is not null
), convs as (
  select c, c - c % 100 as base, {_CRC32} % 6 as h
  from (select distinct c from ranked)
), used as (
  select v.c, v.h, count(r.d) as used from convs v
    left join ranked r on r.c = v.base and r.d <= v.h group by 1, 2
), turns as (
  select v.c, r.d as place, r.role, r.text from convs v
    join ranked r on r.c = v.base and r.d <= v.h
  union all
  select u.c, u.used + r.d - u.h, r.role, r.text from used u
    join ranked r on r.c = u.c and r.d > u.h
), prefixes as (
  select c, place as depth, length(text) as n_chars, sha256(to_json(list(struct_pack(r := role,
    t := text)) over (partition by c order by place))::varchar) as node
  from turns
  union all
  select c, 0, 0, '' from convs
), whole as (
  select c, max(depth) as depth, arg_max(node, depth) as node from prefixes group by c
), ends as (
  select node, depth, sha256(string_agg(c::varchar, ',' order by c)) as ends_sha256
  from whole group by 1, 2
), nodes as (
  select p.node, p.depth, any_value(b.node) as parent, count(*) as n_convs,
    min(p.c) as conv_id, (count(*) - 1) * any_value(p.n_chars) as saves
  from prefixes p left join prefixes b on b.c = p.c and b.depth = p.depth - 1 group by 1, 2
), children as (
  select parent as node, depth - 1 as depth, count(*) as n_children
  from nodes where depth > 0 group by 1, 2
), below as (
  select distinct a.node, a.depth, n.node as under, n.depth as under_depth, n.saves,
    k.n_children is null as leaf
  from prefixes a join prefixes b on a.c = b.c and b.depth >= a.depth
    join nodes n on n.node = b.node and n.depth = b.depth
    left join children k on k.node = b.node and k.depth = b.depth
), sums as (
  select node, depth, sum(saves)::bigint as saved_tokens, sum(leaf::int)::bigint as n_leaves
  from below group by 1, 2
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens,
  coalesce(e.ends_sha256, sha256('')) as ends_sha256
from nodes n join sums s using (node, depth) left join children k using (node, depth)
  left join ends e using (node, depth)
  left join nodes p on p.node = n.parent and p.depth = n.depth - 1
"""


@query
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TERMS = """unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+'))"""

SQL["op12_lexical_search"] = f"""
with words as (
  select doc_id, {_TERMS} as term from documents
), postings as (
  select doc_id, term, count(*) as tf from words group by 1, 2
), lengths as (
  select doc_id, count(*) as n from words group by 1
), totals as (
  select count(*) as n_docs, sum(n)::bigint as n_terms from lengths
), norms as (
  select doc_id, 100 - 75 + ((75 * n * n_docs) // n_terms) as m from lengths, totals
), weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from postings, totals group by term, n_docs
), asked as (
  select item_id, {_TERMS} as term from benchmark
), scores as (
  select item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (term) join postings using (term) join norms using (doc_id)
  group by 1, 2
), ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank
  from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


@query
def op13_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf, "documents"))


def _paragraph_lengths(fingerprint: str) -> str:
    """DuckDB: the different paragraphs of a fingerprint as a list of 'hash.length'."""
    return (f"list_distinct(list_filter(string_split(regexp_replace({fingerprint}[66:], "
            "'[0-9a-f]+=|/', '', 'g'), ','), lambda x: x <> ''))")  # fmt: skip


def _likeness(a: str, b: str) -> str:
    def total(of):
        return f"list_sum(list_transform({of}, lambda x: cast(string_split(x, '.')[2] as bigint)))"

    x, y = _paragraph_lengths(a), _paragraph_lengths(b)
    both = f"coalesce({total(f'list_intersect({x}, {y})')}, 0)"
    all_ = f"(coalesce({total(x)}, 0) + coalesce({total(y)}, 0))"
    return (f"case when {a}[1:64] = {b}[1:64] then 1.0::double "
            f"else 2.0::double * {both} / {all_} end")  # fmt: skip


SQL["op13_merkle_fingerprints"] = f"""
with d as (
  select doc_id, coalesce(text, '') as text from documents
), paired as (
  select doc_id, text,
    coalesce(lead(text) over w, first_value(text) over w) as next_text
  from d window w as (order by doc_id desc nulls last)
), edited as (
  select *, left(text, (length(text) - length(text) // 2)::int)
            || left(next_text, (length(text) // 2)::int) as edited
  from paired
), texts as (
  select text from d union select edited from edited
), trees as (
  select text, list_filter(string_split(array_to_string(list_transform(
      regexp_extract_all(text, '{PARAGRAPH}'),
      lambda p: sha256(p) || '.' || length(p) || ','
        || case when starts_with(sha256(p), '0') or ends_with(p, chr(10) || chr(10))
                then '/' else '' end), ''), '/'), lambda s: s <> '') as sections
  from texts
), printed as (
  select text, sha256(coalesce(array_to_string(
      list_transform(sections, lambda s: sha256(s)), ''), '')) || ':'
    || coalesce(array_to_string(list_transform(sections, lambda s: sha256(s)[1:16] || '='
      || regexp_replace(s, '([0-9a-f]{{16}})[0-9a-f]{{48}}', '\\1', 'g')), '/'), '') as fingerprint
  from trees
)
select e.doc_id, length(e.text) as n_chars, sha256(e.edited) as edited_sha256,
  a.fingerprint, b.fingerprint as edited_fingerprint,
  {_likeness("a.fingerprint", "b.fingerprint")} as near_edited,
  {_likeness("a.fingerprint", "c.fingerprint")} as near_next
from edited e join printed a on a.text = e.text join printed b on b.text = e.edited
  join printed c on c.text = e.next_text
"""
