"""The registered queries of this subpackage, with DuckDB SQL where SQL can say the same.

Each takes ``(spark, sf_dir)`` and applies its operator to the whole table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldspark.llm import (centroid_cluster, chat_format, decontaminate, itq_dedup, jaccard_join, mixing, ppm_langid,
                           prefix_trie, span_dedup, token_count, toxicity, url_filter, warc)
from foldspark.llm.common import shared_path
from foldspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


OP1_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
         sha1(coalesce(html, '')) as payload_digest from pages),
o as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes >= 1000)
             end as owner from p)
select page_id, payload_bytes, payload_digest,
       case when owner <> page_id then 'revisit' else 'response' end as record_type,
       case when owner <> page_id then owner end as refers_to, true as verified
from o
"""


@register(OP1_SQL)
def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, normalise the archives, read them back."""
    return warc.archive_pages(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))


OP2_SQL = r"""
with recursive rules(r_host, r_path, r_verdict) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
raw as (select page_id, url, html,
  case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
cut as (select page_id, url, html, rest,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from raw),
edges as (
  select distinct url as src, dst from (
    select url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                               '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as dst from cut
    union all
    select url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                               '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) from cut
    union all
    select url, 'https://' || regexp_replace(host, '^(www|m)\.', '') || path || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1)
    from cut where instr(url, '://') > 0)
  where dst like '%://%' and dst <> url),
variants as (
  select distinct url as src, dst from (
    select url, 'https://' || regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') as dst
    from cut where instr(url, '://') > 0) where dst <> url),
links as (select src as a, dst as b from edges union select dst, src from edges),
reach(a, b) as (select a, a from links union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a as url, min(b) as component from reach group by a),
wider as (select a, b from links union select src, dst from variants union select dst, src from variants),
wide_reach(a, b) as (select a, a from wider union select r.a, l.b from wide_reach r join wider l on r.b = l.a),
wide as (select a as url, min(b) as component from wide_reach group by a),
nodes as (
  select url, coalesce(component, url) as component, rest,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select url, component, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
        from (select url from pages where url is not null union select url from comp) left join comp using (url))),
ruled as (
  select url, arg_max(r_host || r_path, length(r_host || r_path)) as rule,
         arg_max(r_verdict, length(r_host || r_path)) as v
  from nodes join rules on (host = r_host or host like '%.' || r_host) and starts_with(path, r_path) group by url),
blocked as (select distinct component from ruled join nodes using (url) where v = 'block')
select c.page_id, c.host, c.path, r.rule,
       coalesce(r.v, case when b.component is not null then 'block' else 'allow' end) as verdict, n.component,
       coalesce(w.component, c.url) as variant_component
from cut c left join nodes n on c.url = n.url left join ruled r on c.url = r.url left join wide w on c.url = w.url
left join blocked b on n.component = b.component
"""


@register(OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url by the rules and by the aliases that its page and url state; name the wider class of
    addresses that differ in query, file ending or slash only."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.page_edges(pages), url_filter.rules_frame(spark),
                            url_filter.page_variants(pages))


@register()
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register()
def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that it keeps, what it lost and the documents that have that first."""
    return span_dedup.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register()
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard similarity 0.8 of word shingles."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@register()
def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under piece_bpe_32k.model."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15) as h, row_number() over () as r from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
k as (select *, row_number() over (order by source is null, encode(source)) - 1 as rk from s),
w as (select *, 1 + rk % 3 as weight, 3 * source_size as cap from k),
o as (select *, (sum(source_size) over () - coalesce(sum(cap) over (
          order by source_size / weight, rk rows between unbounded preceding and 1 preceding), 0))::hugeint as room,
        (sum(weight) over (order by source_size / weight, rk rows between current row and unbounded following))::hugeint as open
      from w),
f as (select *, cap * open <= room * weight as capped from o),
u as (select max({'open': open, 'room': room}) as m from f where not capped),
t as (select source, source_size, case when capped then cap::double else (u.m.room * weight)::double / u.m.open::double end as target
      from f cross join u),
b as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
c as (select d.doc_id, d.size, b.source_size, b.target, b.whole, d.h,
        sum(d.size) over (partition by d.source order by d.h, d.r rows between unbounded preceding and current row) as upto,
        b.target - b.whole * b.source_size as budget
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       (size * least(3, whole + case when upto <= budget then 1 else 0 end))::bigint as taken
from c
"""


@register(OP7_SQL)
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the sources' target weights."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@register()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return ppm_langid.identify(table(spark, sf_dir, "documents"))


@register()
def op10_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Squared distances computed anew in every round."""
    sql = """
with recursive q as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select (row_number() over (order by sha256('1:' || vec_id::varchar), x) - 1)::int as j, x as c
       from q where vec_id is not null qualify j < {k})""".replace("{k}", str(k))
    for i in range(rounds + 1):
        sql += f""",
a{i} as (select r, vec_id, x, min_by(j, (far, j)) as j, min(far) as far from (
  select q.*, j, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint as far from q, c{i})
  group by r, vec_id, x)"""
        if i < rounds:
            sql += f""",
s{i} as (select j, i, sum(v)::bigint as s, count(*) as n from (select j, unnest(range(1, 65)) as i, unnest(x) as v from a{i}) group by j, i),
c{i + 1} as (select j, coalesce(m, c) as c from c{i} left join (
  select j, list((s - ((s % n) + n) % n) // n order by i) as m from s{i} group by j) using (j))"""
    return sql + f"""
select vec_id, j::int as cluster, far as distance, (sum(far) over (partition by j))::bigint as cluster_inertia,
       (sum(far) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (j)
"""


@register(_op11_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds of exact integer updates."""
    return centroid_cluster.cluster_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') as r,
             replace(replace(text, '\', '\\'), '<|', '<\|') as t from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1)::bigint as formatted_chars,
       0::bigint as n_rewrites
from e group by conv_id
"""


@register(OP12_SQL)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and read the result back."""
    return chat_format.read_back(chat_format.format_turns(
        chat_format.with_probe_conversation(table(spark, sf_dir, "conversations"))))


OP13_SQL = """
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as h,
         row_number() over (partition by conv_id order by turn nulls first,
           sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as rk
  from conversations where conv_id is not null),
ids as (select c, c - ((c % 100) + 100) % 100 as head,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::bigint)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)),
                               lambda v, k: xor(v >> 1, 3988292384::bigint * (v & 1)))), 4294967295::bigint) % 6 as n
  from (select distinct c, c::varchar as s from t)),
p as (select ids.c, 1 as part, rk, h, text from ids join t on t.c = ids.head and rk <= n
      union all select c, 2, rk, h, text from t join ids using (c) where rk > n),
q as (select c, row_number() over w as depth, sha256(string_agg(h, '') over w) as node, text from p window w as (partition by c order by part, rk)),
r as (select c, depth, node, length(text) as chars from q union all select c, 0, 'root', 0 from ids),
l as (select *, lag(node) over (partition by c order by depth) as parent, max(depth) over (partition by c) as last from r),
n as (select node, min(c) as conv_id, min(depth) as depth, min(parent) as parent, count(*) as n_convs, min(chars) as chars,
             sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where depth = last), '')) as ends_sha256
      from l group by node),
k as (select parent as node, count(*) as n_children from n where parent is not null group by parent),
f as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * chars as own from n left join k using (node)),
s as (select distinct x.node as top, y.node from l x join l y on x.c = y.c and x.depth <= y.depth),
m as (select top as node, sum((n_children = 0)::int)::bigint as n_leaves, sum(own)::bigint as saved_tokens from s join f using (node) group by top)
select f.conv_id, f.depth::bigint as depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from f join m using (node) left join n u on u.node = f.parent
"""


@register(OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
