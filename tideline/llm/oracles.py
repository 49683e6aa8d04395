"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP5 = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
frequent as (
  select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines,
       count(*) filter (where k in (select k from frequent))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where k not in (select k from frequent)), '')) as kept_sha256
from keyed group by doc_id
"""


OP6 = r"""
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""

OP10 = r"""
with r as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from r),
m as (
  select *, case
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
    when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule
  from h)
select page_id, host, path, rule,
       case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' else 'allow' end as verdict
from m
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5, "op6_warc": OP6, "op10_url_filter": OP10}
