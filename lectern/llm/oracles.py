"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import secrets, urls
from .quality import RULES

_CUTS = ", ".join(f"('{r}', {i}, {c}::double)" for r, cuts in RULES.items() for i, c in enumerate(cuts))

_OP6 = f"""
with docs as (
  select doc_id, lang, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
wins as (
  select doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') as win
  from docs, lateral (select unnest(generate_series(1, len(w) - 4)) as i)),
hits as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from wins) where n > 1),
reps as (
  select doc_id, count(distinct i + k)::bigint as n_repeat_words
  from hits, (select unnest([0, 1, 2, 3, 4]) as k) group by doc_id),
f as (
  select doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from docs left join reps using (doc_id)),
b as (
  select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
         n_symbols::double / greatest(n_words, 1) as symbols, n_dup_lines::double / greatest(n_lines, 1) as dup_lines,
         n_repeat_words::double / greatest(n_words, 1) as repeats, word_chars::double / greatest(n_words, 1) as word_length
  from f),
long as (unpivot (select doc_id, lang, symbols, dup_lines, repeats, word_length from b where not base_failed)
         on symbols, dup_lines, repeats, word_length into name rule value v),
cuts(rule, i, c) as (values {_CUTS}),
counts as (
  select lang, rule, i, c, count(*) filter (quality = 1 and v > c) as good, count(*) filter (quality <> 1 and v > c) as bad,
         count(*) filter (quality = 1) as n
  from long join labels using (doc_id) join cuts using (rule) where quality is not null group by all),
levels as (select 0.05 / {len(RULES)} / count(*) as level from (select distinct lang from counts)),
tested as (
  select *, (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({0.05 / len(RULES)}) + (n - j) * ln(1 - {0.05 / len(RULES)})))
             from (select unnest(generate_series(0, good)) as j)) as p
  from counts),
passed as (
  select *, bool_and(p <= (select level from levels)) over (partition by lang, rule order by i) as ok from tested),
chosen as (
  select lang, rule, arg_max(c, struct_pack(gain := bad - good, lenient := -i)) as cut
  from passed where ok and bad > good group by lang, rule),
rejected as (
  select distinct doc_id from long join chosen on long.rule = chosen.rule and long.lang is not distinct from chosen.lang where v > cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and doc_id not in (select doc_id from rejected)) as kept
from b
"""

_FIT = " ".join(
    f"when (host = '{h}' or suffix(host, '.{h}')) and prefix(path, '/{p}') then '{rule}'"
    for rule, h, p in sorted(((r, *r.split("/", 1)) for _, r in urls.RULES), key=lambda x: -len(x[0]))
)
_SAYS = " ".join(f"when '{r}' then '{v}'" for v, r in urls.RULES)
_SECOND = ", ".join(f"'{s}.{c}'" for c, labels in urls.SECOND_LEVEL.items() for s in labels.split())


def _strength(children: str) -> str:
    rho = f"(select coalesce(sum(n * pow(k / n - mu, 2) - mu * (1 - mu)) / nullif(sum(mu * (1 - mu) * (n - 1)), 0), 0.0) from {children} where n > 0)"
    return f"(select round(1 / least(greatest({rho}, 1.0 / {urls.MOST_PRIOR + 1}), 0.5) - 1, 6) as m)"


_OP1 = f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
l as (select doc_id as page_id, max((quality = 0 or toxic = 1)::int) as bad from labels group by doc_id having max((quality = 0 or toxic = 1)::int) is not null),
h0 as (select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from p left join l using (page_id) group by host),
h1 as (select host, n, k, bare, string_split(bare, '.') as parts from h0),
h as (select *, case when contains(domain, '.') then substr(domain, strpos(domain, '.') + 1) else domain end as sfx from (
  select *, case when regexp_matches(bare, '^[0-9.]+$') then bare
    else array_to_string(parts[greatest(len(parts) - case when len(parts) > 2 and parts[-2] || '.' || parts[-1] in ({_SECOND}) then 3 else 2 end + 1, 1):], '.') end as domain from h1)),
d as (select domain, sfx, sum(n) as n, sum(k) as k from h group by all),
s0 as (select sfx, sum(n) as n, sum(k) as k from d group by sfx),
s1 as (select *, (select (coalesce(sum(k), 0) + {urls.PRIOR}) / (coalesce(sum(n), 0) + 1) from s0) as mu from s0),
s as (select sfx, (k + m * mu) / (n + m) as mu from s1, {_strength("s1")}),
d1 as (select d.*, s.mu from d join s using (sfx)),
d2 as (select domain, (k + m * mu) / (n + m) as mu from d1, {_strength("d1")}),
h2 as (select h.host, h.n, h.k, d2.mu from h join d2 using (domain)),
t0 as (select host, n, (k + m * mu) / (n + m) as mean, k + m * mu as a, n - k + m * (1 - mu) as b from h2, {_strength("h2")}),
t1 as (select *, ln(a / b) as mode, sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) * {2.0 * urls.WIDE / urls.GRID} as step from t0),
grid as (select *, mode + (i - {urls.GRID // 2}) * step as t from t1, (select unnest(generate_series(0, {urls.GRID})) as i)),
dens as (select host, i, mode, step, exp(a * t - (a + b) * (greatest(t, 0) + ln(1 + exp(-abs(t)))) - a * mode + (a + b) * (greatest(mode, 0) + ln(1 + exp(-abs(mode))))) as w from grid),
cums as (select *, sum(w) over (partition by host order by i) as cum, sum(w) over (partition by host) * {1 - urls.LEVEL} as goal from dens),
quant as (select host, 1 / (1 + exp(-(mode + (i + 0.5 - (cum - goal) / w - {urls.GRID // 2}) * step))) as bound from cums where cum >= goal and cum - w < goal),
rep as (select host, n::bigint as n_labelled, round(mean, 6) as mean, round(bound, 6) as bound from t0 join quant using (host)),
j as (select page_id, host, path, case {_FIT} end as rule from p)
select page_id, host, path, rule, case rule {_SAYS} else case when bound > {urls.LIFT} * (select any_value(mu) from s1) then 'block' else 'allow' end end as verdict, n_labelled, mean, bound
from j join rep using (host)
"""

_OP4 = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
wins as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as win from d, lateral (select unnest(generate_series(1, len(w) - 19)) as i)),
again as (select doc_id, i from wins qualify row_number() over (partition by win order by doc_id, i) > 1),
gone as (select distinct doc_id, i + k as pos from again, (select unnest(generate_series(0, 19)) as k)),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
kept as (select doc_id, string_agg(word, ' ' order by pos) as t, count(*) as n from words where not exists (select 1 from gone where gone.doc_id = words.doc_id and gone.pos = words.pos) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""


def _spans(name: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
{name}_m as (select doc_id, unnest(regexp_extract_all(t, '{p}')) as found, unnest((regexp_split_to_array(t, '{p}'))[1:len(regexp_extract_all(t, '{p}'))]) as before,
  generate_subscripts(regexp_extract_all(t, '{p}'), 1) as k from d),
{name}_s as (select doc_id, found, sum(length(before) + length(found)) over (partition by doc_id order by k) as stop from {name}_m)"""


_ASSIGN = secrets.ASSIGN.replace("'", "''")
_OP9 = f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
{_spans("assign", secrets.ASSIGN)},{_spans("access", secrets.ACCESS)},{_spans("hex", secrets.HEX)},{_spans("token", secrets.TOKEN)},
base as (
  select doc_id, 0 as rank, 'assign' as kind, stop - length(found) as start, stop, regexp_extract(found, '{_ASSIGN}', 2) as value from assign_s where length(regexp_extract(found, '{_ASSIGN}', 2)) >= 12
  union all select doc_id, 1, 'access', stop - length(found), stop, found from access_s union all select doc_id, 2, 'hex', stop - length(found), stop, found from hex_s),
cand as (
  select doc_id, found as value, stop - length(found) as start, stop from token_s
  where regexp_matches(found, '[A-Za-z]') and regexp_matches(found, '[0-9].*[0-9].*[0-9]') and len(list_distinct(string_split(found, ''))) >= 10
    and not regexp_matches(found, '(?i)example|sample|dummy|placeholder|xxxx')),
free as (select * from cand c where not exists (select 1 from base b where b.doc_id = c.doc_id and b.start < c.stop and c.start < b.stop)),
every as (select * from base union all select doc_id, 3, 'owned', start, stop, value from free),
held as (select value, count(distinct md5(t)) as repos, count(distinct coalesce('s' || source, '')) as owners from every join d using (doc_id) group by value),
judged as (select every.*, least(owners, repos) <= {secrets.MOST_OWNERS} and repos <= {secrets.MOST_REPOS} as live from every join held using (value)),
g as (select doc_id, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (live or rank < 3) as spans,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3) as base, count(*) filter (live) as n_live, count(*) filter (not live) as n_copied,
  count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex from judged group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""

ORACLES: dict[str, str] = {"op1_url_filter": _OP1, "op4_substring_dedup": _OP4, "op6_quality_rules": _OP6, "op9_secret_scan": _OP9}
