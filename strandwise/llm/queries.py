"""The queries over these operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, exact_dedup, jaccard, licences, mixing, neighbours, repeats, sharding, topk, toxicity, trie
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.byte_repeats(table(spark, sf_dir, "documents"), length=200)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.word_repeats(table(spark, sf_dir, "documents"), length=35)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), k=20)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=40)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, share=(85, 100))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).drop("source")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; here each source is a tree, with directories of up to a thousand and a hundred ids.

    By a hash of the id, a tenth lies directly under the source, a fifth under the thousand, the others under the hundred.
    """
    i = F.coalesce(F.col("doc_id"), F.lit(-1))
    depth = F.pmod(F.xxhash64(i), F.lit(10))
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("unknown")), F.when(depth > 0, F.floor(i / 1000)), F.when(depth > 2, F.floor(i / 100)), i)
    return licences.scan(table(spark, sf_dir, "documents"), path)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, k=10)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"), period=100, most=6)


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_neighbours, op3_sharding, op4_bpe, op5_substring_dedup, op6_exact_dedup, op7_jaccard_join, op8_mixing, op9_licences, op10_toxicity, op11_divergence, op12_trie, op13_topk)}


OP6_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""

OP8_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5('mix:|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as k
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (
  select *, cast([3, 1, 2][i % 3 + 1] as double) as w, cast([-0.5, 0.0, 0.5][i % 3 + 1] as double) as lean,
    cast(source_size * 2.0 as double) as cap from s),
l as (
  select *, cap / w as ratio,
    (cast(sum(source_size) over () as double) * cast(1.5 as double)
     - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from w),
t as (
  select *, (select level from l where ratio >= level order by ratio, source nulls last limit 1) as reached from l),
g as (
  select source, source_size, lean, case when reached is null or ratio < reached then cap else least(w * reached, cap) end as target from t),
p as (
  select d.doc_id, d.size, g.source_size, g.target, g.lean, cast(round(g.target) as bigint) as goal,
    cast(coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from d join g on d.source is not distinct from g.source),
c as (
  select *, list_sum([greatest(0, least(size, goal - k * source_size - start)) for k in [0, 1, 2]]) as taken,
    list_sum([case when k * source_size + start < goal then 1 else 0 end for k in [0, 1, 2]]) as copies from p)
select doc_id, size, source_size, target, cast(taken as bigint) as taken, cast(copies as integer) as copies,
  case when copies > 0 then 2.0::double * (start / target)
    / ((1.0::double - lean) + sqrt((1.0::double - lean) * (1.0::double - lean) + 4.0::double * lean * (start / target))) end as position
from c
"""


OP11_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
w as (select r, lang, source, unnest(terms) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 10),
c as (select w.lang, w.source, w.term, count(*) as n from w join kept using (lang, term) group by all),
lc as (select lang, term, sum(n) as n from c group by all),
langs as (select lang, count(distinct kept.term) as v from (select distinct lang from d) left join kept using (lang) group by lang),
lt as (select langs.lang, v, coalesce((select sum(n) from lc where lc.lang = langs.lang), 0) + 2 * v as total from langs),
gs as (select distinct lang, source from d),
gt as (select lang, source, v, coalesce((select sum(n) from c where c.lang = gs.lang and c.source = gs.source), 0) + 2 * v as total from gs join langs using (lang)),
p as (
  select gt.lang, gt.source, k.term, coalesce(c.n, 0) as n, cast(1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // gt.total::hugeint as hugeint) as p
  from gt join kept k on k.lang = gt.lang left join c on c.lang = gt.lang and c.source = gt.source and c.term = k.term),
q as (select lc.lang, lc.term, cast(1 + 1000000000::hugeint * (lc.n + 2)::hugeint // lt.total::hugeint as hugeint) as q from lc join lt using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce((
    select sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) from p x join p y on y.lang = x.lang and y.term = x.term
    where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from gs a join gs b on a.lang = b.lang and a.source <> b.source),
t as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
u as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from t qualify rank <= 10)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from u
"""

#: DuckDB has no CRC-32: it is worked out bit by bit over the decimal digits, with the polynomial 0xEDB88320.
OP12_SQL = """
with rows as (
  select conv_id, turn, sha256(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as t, length(coalesce(text, '')) as n
  from conversations where conv_id is not null),
turns as (select conv_id, t, n, row_number() over (partition by conv_id order by turn nulls first, t) - 1 as i, count(*) over (partition by conv_id) as own from rows),
convs as (
  select conv_id, conv_id - conv_id % 100 as base, own, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: unicode(c)::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 6 as h
  from (select conv_id, max(own) as own from turns group by conv_id)),
plan as (select c.*, least(c.h, coalesce(b.own, 0)) as there from convs c left join convs b on b.conv_id = c.base),
whole as (
  select p.conv_id as c, t.i, t.t, t.n from plan p join turns t on t.conv_id = p.base where t.i < p.h
  union all select p.conv_id, t.i - p.h + p.there, t.t, t.n from plan p join turns t on t.conv_id = p.conv_id where t.i >= p.h),
pre as (select c, i + 1 as depth, n, string_agg(t, '') over (partition by c order by i) as p, count(*) over (partition by c) as size from whole),
members as (
  select c, depth, n, p, depth = size as ended from pre
  union all select conv_id, 0, 0, '', conv_id not in (select c from whole) from plan),
nodes as (
  select p, depth, min(c) as conv_id, count(*) as n_convs, max(n) as n, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ended), '')) as ends_sha256
  from members group by p, depth),
kids as (select left(p, 64 * (depth - 1)) as p, count(*) as k from nodes where depth > 0 group by 1),
each as (select nodes.*, coalesce(k, 0) as n_children from nodes left join kids using (p))
select a.conv_id, a.depth, b.conv_id as parent_conv_id, a.n_convs, a.n_children,
  (select count(*) from each x where x.n_children = 0 and starts_with(x.p, a.p)) as n_leaves,
  cast((select sum((x.n_convs - 1) * x.n) from each x where starts_with(x.p, a.p)) as bigint) as saved_tokens, a.ends_sha256
from each a left join each b on a.depth > 0 and b.depth = a.depth - 1 and b.p = left(a.p, 64 * (a.depth - 1))
"""

OP13_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op11_divergence": OP11_SQL, "op12_trie": OP12_SQL, "op13_topk": OP13_SQL}
