"""Registered queries of the training-data operators on the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrid.llm import (
    bm25_packing,
    bpe_count,
    circulant_minhash,
    collision_ann,
    cotraining,
    lang_ecoc,
    pattern_packing,
    pii_bootstrap,
    poisson_mix,
    prefix_trie,
    son_phrases,
    sorted_projection,
    url_reputation,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- 1
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_S = url_reputation.SECOND_LEVEL


def _shrink(name: str, children: str) -> str:
    """Two SQL tables: the prior's strength over ``children`` (n, k, m), and children with the shrunk mean."""
    even = "m * (1 - m)"
    exact = lambda e: f"cast(sum(cast({e} as decimal(30,12))) as double)"
    return f"""{name}_sums as (select {exact(f'n * (k / n - m) * (k / n - m)')} as s, {exact(even)} as e,
    {exact(f'(n - 1) * ({even})')} as d from {children} where n > 0),
{name}_strength as (select case when d is null or not d > 0 or (s - e) / d <= 1 / 1001.0::double then 1000.0::double
    when (s - e) / d >= 0.5 then 1.0::double else 1 / ((s - e) / d) - 1 end as strength from {name}_sums),
{name} as (select c.*, strength, (k + strength * m) / (n + strength) as mean from {children} c, {name}_strength)"""


URL_SQL = rf"""with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parsed as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
outcome as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1
  when quality is not null or toxic is not null then 0 end) as bad from labels group by 1),
counted as (select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as k
  from parsed left join outcome using (page_id) group by 1),
named as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*\z', '') as name from counted),
hosts as (select host, n, k,
  case when regexp_matches(name, '^[0-9.]+\z') or regexp_extract(name, '{url_reputation.DOMAIN}', 1) = '' then name
    else regexp_extract(name, '{url_reputation.DOMAIN}', 1) end as domain,
  case when regexp_matches(name, '^[0-9.]+\z') then '' else regexp_extract(name, '{url_reputation.SUFFIX}', 1) end as suffix from named),
overall as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) as m from hosts),
suffix_counts as (select suffix, sum(n) as n, sum(k) as k, any_value(m) as m from hosts, overall group by suffix),
{_shrink('suffixes', 'suffix_counts')},
domain_counts as (select domain, h.suffix, sum(h.n) as n, sum(h.k) as k, any_value(s.mean) as m
  from hosts h join suffixes s on h.suffix = s.suffix group by 1, 2),
{_shrink('domains', 'domain_counts')},
host_counts as (select h.host, h.domain, h.suffix, h.n, h.k, d.mean as m
  from hosts h join domains d on h.domain = d.domain and h.suffix = d.suffix),
{_shrink('shrunk', 'host_counts')},
params as (select *, k + strength * m as a, n - k + strength * (1 - m) as b from shrunk),
known as (select host, domain, suffix, n, k, mean, mean - 1.645::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from params),
ruled as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from parsed)
select page_id, r.host, path, rule, case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
  when bound > 0.5 then 'block' else 'allow' end as verdict, domain, suffix, n::bigint as labelled, k::bigint as bad,
  round(mean, 6) as bad_mean, round(bound, 6) as bad_bound
from ruled r join known using (host)"""


@query("op1_url_reputation", URL_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return url_reputation.judge(read(spark, sf, "pages"), read(spark, sf, "labels"), URL_RULES)


# ---------------------------------------------------------------- 2
@query("op2_bpe_token_counts")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_count.token_counts(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- 3
@query("op3_language_ecoc")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = lang_ecoc.learn(docs.where(~F.col("held_out")))
    return lang_ecoc.identify(docs.drop("lang"), model, keep=["held_out"])


# ---------------------------------------------------------------- 4
@query("op4_pattern_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pattern_packing.pack(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


# ---------------------------------------------------------------- 5
@query("op5_collision_counting_neighbours")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return collision_ann.nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


# ---------------------------------------------------------------- 6
MIX_SQL = """with sized as (select source, count(*) as docs, coalesce(sum(length(text)), 0)::bigint as chars from documents group by 1),
total as (select sum(chars) as all_chars, count(*) as all_weight from sized where chars > 0),
rates as (select source, case when chars > 0 then 1.0::double / all_weight::double * all_chars::double * 1.0::double / chars::double end as rate from sized, total),
ks as (select source, rate, unnest(generate_series(greatest(floor(rate - (12 * sqrt(rate) + 30)), 0)::bigint,
  ceil(rate + 12 * sqrt(rate) + 30)::bigint)) as k from rates where rate > 0),
steps as (select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k rows unbounded preceding) as c from ks),
cdf as (select source, min(k) as least, list(c order by k) as cs from steps group by 1),
drawn as (select d.*, case when rate is null then 1 else least + len(list_filter(cs, lambda c:
  c <= ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double)) end as n
  from documents d join rates r on d.source is not distinct from r.source left join cdf f on d.source is not distinct from f.source),
copies as (select *, unnest(generate_series(0, n - 1)) as copy from drawn where n > 0)
select doc_id, text, lang, source, n_chars, copy::bigint as copy,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || copy::varchar), 1, 13))::bigint as shuffle_key from copies"""


@query("op6_poisson_mixing", MIX_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return poisson_mix.mix(read(spark, sf, "documents"))


# ---------------------------------------------------------------- 7
@query("op7_quality_cotraining")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return cotraining.score_quality(docs, cotraining.learn_quality(docs, read(spark, sf, "labels")))


# ---------------------------------------------------------------- 8
@query("op8_pii_bootstrap")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = pii_bootstrap.find(read(spark, sf, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii_bootstrap.KINDS],
        F.sha2(pii_bootstrap.listed(F.col("base")), 256).alias("base_sha256"),
        pii_bootstrap.listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


# ---------------------------------------------------------------- 9
@query("op9_circulant_minhash")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return circulant_minhash.near_duplicates(read(spark, sf, "documents"), per_hundred=85)


# ---------------------------------------------------------------- 10
@query("op10_sorted_projection_passes")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return sorted_projection.near_vectors(read(spark, sf, "embeddings"))


# ---------------------------------------------------------------- 11
@query("op11_bm25_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_packing.pack(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


# ---------------------------------------------------------------- 12
TRIE_SQL = """with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place,
  {'r': coalesce(role, ''), 't': coalesce(text, '')} as turn from conversations where conv_id is not null),
own as (select conv_id, list(turn order by place) as turns from turns group by 1),
hashed as (select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)),
  lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 9 as h from own),
whole as (select a.conv_id, coalesce(b.turns[:a.h], []) || a.turns[a.h + 1:] as turns
  from hashed a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
member as (select conv_id, len(turns) as n, unnest(range(len(turns) + 1)) as depth, turns from whole),
path as (select conv_id, n, depth, turns[:depth] as prefix from member),
node as (select depth, prefix, min(conv_id) as conv_id, count(*) as n_convs,
  coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') as ends from path group by 1, 2),
child as (select depth - 1 as depth, prefix[:depth - 1] as prefix, count(*) as n_children from node where depth > 0 group by 1, 2),
full_node as (select node.*, coalesce(n_children, 0) as n_children from node left join child using (depth, prefix)),
below as (select p.depth, p.prefix, sum((f.n_children = 0)::int) as n_leaves,
  sum((f.n_convs - 1) * case when f.depth = 0 then 0 else strlen(f.prefix[-1].t) end) as saved
  from full_node f join path p on p.conv_id = f.conv_id and p.depth <= f.depth group by 1, 2)
select f.conv_id, f.depth::bigint as depth, up.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(f.ends) as ends_sha256
from full_node f join below using (depth, prefix) left join node up on up.depth = f.depth - 1 and up.prefix = f.prefix[:f.depth - 1]"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf, "conversations"))


# ---------------------------------------------------------------- 13
PHRASE_SQL = r"""with piece as (select coalesce(lang, 'und') as lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
word as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from piece),
run as (select lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: ws[i:i + size - 1])) as ws
  from word, (select unnest([1, 2, 3, 4]) as size) sizes where len(ws) >= size),
f as (select lang, ws, count(*) as a from run group by 1, 2),
total as (select lang, sum(len(ws)) as n from word group by 1),
candidate as (select * from f where len(ws) > 1 and a >= 30),
cut as (select c.lang, c.ws, c.a, unnest(range(1, len(c.ws))) as k from candidate c),
rated as (select cut.*, l.a as l, r.a as r, (2000000::hugeint * cut.a) // (l.a + r.a) as score from cut
  join f l on l.lang = cut.lang and l.ws = cut.ws[:k] join f r on r.lang = cut.lang and r.ws = cut.ws[k + 1:]),
least as (select * from rated qualify row_number() over (partition by lang, ws order by score, k) = 1),
inside as (select c.lang, c.a, unnest(list_concat(case when len(ws) = 4 then [ws[1:3], ws[2:4]] else [] end,
  list_transform(range(1, len(ws)), lambda i: ws[i:i + 1]))) as ws from candidate c where len(ws) > 2),
longest as (select lang, ws, max(a) as longer from inside group by 1, 2),
kept as (select least.* from least left join longest using (lang, ws) where longer is null or 100 * longer < 80 * a),
named as (select *, array_to_string(ws, ' ') as phrase from kept),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from named qualify rank <= 2000)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join total using (lang)"""


@query("op13_son_collocations", PHRASE_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return son_phrases.collocations(read(spark, sf, "documents"))
