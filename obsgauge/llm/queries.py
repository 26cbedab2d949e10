"""The corpus operators over the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from obsgauge.llm import (
    byte_bpe, golay, hard_negatives, hilbert, isolation, lempel_ziv, line_chunks, lsh_forest, merkle, mixture, neighbour_vote, toxicity, url_cascade,
)
from obsgauge.llm.common import table

QUERIES = {}
ORACLE = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_byte_bpe(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return byte_bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN)


@register
def op4_mixture(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return mixture.accounts(docs)


@register
def op5_simhash(spark, folder):
    return golay.digest(table(spark, folder, "documents", "doc_id", "text"))


@register
def op9_line_chunks(spark, folder):
    return line_chunks.digest(table(spark, folder, "documents", "doc_id", "text"))


@register
def op7_toxicity(spark, folder):
    return toxicity.digest(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "toxic"))


#: Rules of the task, and a blocklist of advertising domains as the production list would be: a table.
BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
SPAM = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ENDINGS = ("com", "net", "org")


@register
def op2_url_cascade(spark, folder):
    domains = spark.range(1).select(F.explode(F.array(*[F.lit(f"{s}.example.{e}") for s in SPAM for e in ENDINGS])).alias("domain"))
    return url_cascade.judge(table(spark, folder, "pages", "page_id", "url"), BLOCK, ALLOW, domains)


ORACLE["op2_url_cascade"] = r"""
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(rule, rule_host, rule_path, kind) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits as (
  select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(kind, length(rule)) as kind
  from parts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by all)
select page_id, host, path, rule, coalesce(kind, case when
  regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$')
  then 'block' else 'allow' end) as verdict
from fits
"""


@register
def op6_lempel_ziv(spark, folder):
    return lempel_ziv.neighbours(table(spark, folder, "documents", "doc_id", "text"))


@register
def op8_hilbert(spark, folder):
    return hilbert.digest(table(spark, folder, "documents", "doc_id", "text", "source", "lang"))


@register
def op1_neighbour_vote(spark, folder):
    return neighbour_vote.digest(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality"))


@register
def op10_isolation(spark, folder):
    return isolation.digest(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality"))


@register
def op13_merkle(spark, folder):
    return merkle.digest(table(spark, folder, "documents", *merkle.FIELDS))


ORACLE["op13_merkle"] = r"""
with recursive docs as (
  select *, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) & 1) = 0 as hit
  from documents),
hashed as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when hit and text is not null then sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) end as bent
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from docs)),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by source) as n from hashed),
tree(level, source, idx, h, n) as (
  select 0, source, r, leaf, n from leaves
  union all
  select level + 1, source, idx // 3, sha256(string_agg(h, '' order by idx)), n from tree where n > 3 ** level group by level, source, idx // 3, n),
subs as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as r, count(*) over () as n from tree where n <= 3 ** level),
upper_tree(level, idx, h, n) as (
  select 0, r, subroot, n from subs
  union all
  select level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), n from upper_tree where n > 3 ** level group by level, idx // 3, n),
steps as (
  select l.source, l.r, t.level as pos, coalesce(string_agg(t.h, '' order by t.idx) filter (t.idx < l.r // (3 ** t.level)::bigint), '') as before,
    coalesce(string_agg(t.h, '' order by t.idx) filter (t.idx > l.r // (3 ** t.level)::bigint), '') as after
  from leaves l join tree t on l.source is not distinct from t.source and t.idx // 3 = l.r // (3 ** (t.level + 1))::bigint and t.n > 3 ** t.level
  group by l.source, l.r, t.level),
upper_steps as (
  select s.source, 1000 + t.level as pos, coalesce(string_agg(t.h, '' order by t.idx) filter (t.idx < s.r // (3 ** t.level)::bigint), '') as before,
    coalesce(string_agg(t.h, '' order by t.idx) filter (t.idx > s.r // (3 ** t.level)::bigint), '') as after
  from subs s join upper_tree t on t.idx // 3 = s.r // (3 ** (t.level + 1))::bigint and t.n > 3 ** t.level
  group by s.source, t.level),
paths as (
  select source, r, list({'before': before, 'after': after} order by pos) as path
  from (select * from steps union all select l.source, l.r, u.pos, u.before, u.after from leaves l join upper_steps u on l.source is not distinct from u.source)
  group by source, r),
folds as (
  select l.doc_id, l.leaf, s.subroot, (select h from upper_tree where n <= 3 ** level) as root,
    sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x.before || x.after), ''), '')) as proof_sha256,
    coalesce(list_reduce(list_prepend({'before': coalesce(l.bent, l.leaf), 'after': ''}, p.path),
      lambda a, x: {'before': sha256(x.before || a.before || x.after), 'after': ''}).before, l.bent, l.leaf) as folded_root
  from leaves l join subs s on l.source is not distinct from s.source left join paths p on l.source is not distinct from p.source and l.r = p.r)
select *, folded_root = root as verified from folds
"""


@register
def op11_hard_negatives(spark, folder):
    return hard_negatives.digest(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


ORACLE["op11_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


@register
def op12_lsh_forest(spark, folder):
    return lsh_forest.digest(table(spark, folder, "documents", "doc_id", "text"))


ORACLE["op12_lsh_forest"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, list_distinct(case len(w) when 0 then [] when 1 then w
    else list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) end) as s
  from words),
shingles as (select doc_id, unnest(s) as shingle from sets),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join sets x on a = x.doc_id join sets y on b = y.doc_id
  where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from sets
  union
  select r.doc_id, b from reach r join both_ways on other = a)
select doc_id, len(any_value(s)) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
from reach join sets using (doc_id) group by doc_id
"""
