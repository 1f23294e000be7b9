"""The registered queries of this subpackage, thin over its operators, and their
SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bfd_packing, chat_rotation, dp_packing, exact_dedup, mixing, string_kernel, suffix_array, tensor_minhash, url_reputation, winnowing

#: Rules of the URL filter. Fixed values.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept", "spans")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.identify(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_neighbours(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_dedup(_table(spark, sf_dir, "documents"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: a page's outcome is that of the document whose number its path
    names: bad if toxic or of low quality."""
    number = F.regexp_extract("url", r"^[^:]*://[^/]*/[a-z]+/([0-9]{1,18})", 1)
    named = pages.select("page_id", number.alias("n")).select("page_id", F.expr("try_cast(nullif(n, '') as bigint)").alias("doc"))
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    return named.where("doc is not null").join(labels.groupBy("doc_id").agg(F.max(bad).alias("bad")), F.col("doc") == F.col("doc_id")).select("page_id", "bad")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    outcomes = page_outcomes(pages.select("page_id", "url"), _table(spark, sf_dir, "labels"))
    rules = [url_reputation.Rule(*r) for r in URL_RULES]
    return url_reputation.filter_urls(pages, outcomes, rules).select("page_id", "host", "path", "rule", "verdict")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(_table(spark, sf_dir, "conversations"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = dp_packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents")).taken()


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.pack_rows(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1,
        "op2_language_id": op2,
        "op3_winnowing": op3,
        "op4_minhash_near_dedup": op4,
        "op5_url_filter": op5,
        "op6_chat_rotation": op6,
        "op7_packing": op7,
        "op8_exact_dedup": op8,
        "op9_source_mixing": op9,
        "op10_packed_matrices": op10,
    }


_OP1_SQL = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
w as (select doc_id, h, unnest(range(0, (length(h) // 2) - 49)) as i from d where length(h) >= 100),
x as materialized (select doc_id, i, hash(substr(h, 2 * i + 1, 100)) as k from w),
y as (select doc_id, i from x where k in (select k from x group by k having count(distinct doc_id) > 1)),
z as (select y.doc_id, i, substr(h, 2 * i + 1, 100) as p from y join d using (doc_id)),
g as (select doc_id, i, min(doc_id) over (partition by p) as m from z),
f as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 50, -1) as fresh from g where m < doc_id),
s as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as k from f),
spans as (select doc_id, k, min(i) as a, max(i) + 50 as b from s group by doc_id, k),
gaps as (select doc_id, k, a, b, coalesce(lag(b) over (partition by doc_id order by k), 0) as p from spans),
cut as (
  select d.doc_id, count(*) as n_spans, sum(b - a) as n_removed,
    string_agg(substr(h, (2 * p + 1)::bigint, (2 * (a - p))::bigint), '' order by k) || substr(any_value(h), (2 * max(b) + 1)::bigint) as rest
  from gaps join d using (doc_id) group by d.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256
from d left join cut using (doc_id)
"""

_OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as materialized (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end) as g
  from w),
n as materialized (select doc_id, count(*) as n from s group by 1),
p as materialized (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as materialized (select x, y from l union all select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
m as (select x, least(x, min(y)) as c from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id) as component_id, coalesce(m.c, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join m on m.x = d.doc_id
"""

_OP5_SQL = r"""
with u as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
l as (
  select *, string_split(name, '.') as ls, regexp_matches(name, '^([0-9.]+|\[.*)$') as address
  from (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') as name from h)),
t as (select *, len(ls) >= 2 and ls[-2] || '.' || ls[-1] in ({suffixes}) as two from l),
p as (
  select page_id, url, host, path, name, case when address then name else array_to_string(ls[-(two::int + 1):], '.') end as suffix,
    case when address then name else array_to_string(ls[-(two::int + 2):], '.') end as domain from t),
o as (
  select page_id, max(bad) as bad from pages
  join (select doc_id, max(greatest(1 - quality, toxic)) as bad from labels group by 1) x
    on x.doc_id = try_cast(nullif(regexp_extract(url, '^[^:]*://[^/]*/[a-z]+/([0-9]{{1,18}})', 1), '') as bigint)
  group by 1),
hs as materialized (
  select name, any_value(domain) as domain, any_value(suffix) as suffix, count(*)::double as n, sum(bad)::double as bad
  from (select page_id, min(name) as name, min_by(domain, name) as domain, min_by(suffix, name) as suffix from p where page_id is not null group by 1)
  join o using (page_id) where bad is not null group by name),
ds as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(bad) as bad from hs group by domain),
ss as (select suffix, sum(n) as n, sum(bad) as bad from ds group by suffix),
q as (
  select 'h' as k, sum(n) as n, sum(bad) as bad, count(*) as c, sum(bad * bad / n) as q, sum(n * n) as n2 from hs
  union all select 'd', sum(n), sum(bad), count(*), sum(bad * bad / n), sum(n * n) from ds
  union all select 's', sum(n), sum(bad), count(*), sum(bad * bad / n), sum(n * n) from ss),
v as (
  select k, n, bad, bad / n as m, case when n - n2 / n > 0 then (q - bad * bad / n - (c - 1) * (bad / n) * (1 - bad / n)) / (n - n2 / n) else 0 end as spread from q),
c as (select k, n, bad, least(greatest(case when spread > 0 then m * (1 - m) / spread - 1 else 200.0 end, 2.0), 200.0) as w from v),
one as (
  select (max(bad) + 1.0) / (max(n) + 2.0) as m0, max(w) filter (k = 'h') as ch, max(w) filter (k = 'd') as cd, max(w) filter (k = 's') as cs from c),
sm as (select suffix, (bad + cs * m0) / (n + cs) as ms from ss, one),
dm as (select domain, (bad + cd * ms) / (n + cd) as md from ds join sm using (suffix), one),
ab as (
  select x.name, ch * coalesce(md, ms, m0) + coalesce(bad, 0) as a, ch * (1 - coalesce(md, ms, m0)) + coalesce(n - bad, 0) as b
  from (select distinct name, domain, suffix from p) x left join (select name, n, bad from hs) hh using (name) left join dm using (domain) left join sm using (suffix), one),
judged as (
  select name, a / (a + b) as mean, greatest(a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0) as low from ab),
r as (
  select page_id, p.host, path, mean, low, (select max_by(column1, length(column1)) from (values {rules}) z(column0, column1)
    where (p.host = split_part(column1, '/', 1) or ends_with(p.host, '.' || split_part(column1, '/', 1)))
      and starts_with(path, substr(column1, instr(column1, '/')))) as rule
  from p join judged using (name))
select page_id, host, path, rule, coalesce((select any_value(column0) from (values {rules}) z(column0, column1) where column1 = rule),
  case when low > 0.5 then 'block' else 'allow' end) as verdict
from r
""".format(suffixes=", ".join(f"'{x}'" for x in url_reputation.SUFFIX_RULES), rules=", ".join(f"('{a}', '{b}')" for a, b in URL_RULES))

_OP6_SQL = """
with t as (
  select conv_id, turn, case when coalesce(trim(role), '') = '' then 'unknown' else trim(role) end as speaker, coalesce(text, '') as text
  from conversations),
p as (select distinct conv_id, speaker as participant from t where speaker <> 'system'),
x as (
  select conv_id, participant, turn, speaker, text, speaker = participant as mine,
    case when speaker = participant then 'assistant' when speaker = 'system' then 'system' else 'user' end as role
  from p join t using (conv_id)),
h as (
  select *, case role when 'assistant' then '<|assistant|>' || chr(10) when 'system' then '<|system|>' || chr(10)
    else '<|user name=' || speaker || '|>' || chr(10) end as head from x),
r as (select *, head || text || '<|end|>' || chr(10) as rendered from h),
o as (
  select *, row_number() over w - 1 as seq, coalesce(sum(length(rendered)) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from r window w as (partition by conv_id, participant order by turn nulls first, speaker, text))
select conv_id, participant, seq::bigint as seq, turn, speaker, role, rendered, mine::int as loss, start::bigint as start, length(rendered)::bigint as length,
  case when mine then (start + length(head))::bigint end as loss_start, case when mine then (length(rendered) - length(head))::bigint end as loss_length
from o
"""

_OP8_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": _OP1_SQL, "op4_minhash_near_dedup": _OP4_SQL, "op5_url_filter": _OP5_SQL, "op6_chat_rotation": _OP6_SQL, "op8_exact_dedup": _OP8_SQL}
