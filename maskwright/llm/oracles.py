"""SQL for DuckDB that gives the rows of the registered queries, by plainer ways."""

from __future__ import annotations


def _span_rows(kind: str, part: str, pattern: str, group: int, least: int, rank: int) -> str:
    """The matches of one kind with their places in code points."""
    p = pattern.replace("'", "''")
    good = f"length(v[i]) >= {least}"
    if kind == "run":
        good += (
            " and regexp_matches(v[i], '[0-9]') and regexp_matches(v[i], '[A-Za-z]')"
            " and (not regexp_matches(v[i], '[_-]') or regexp_matches(v[i], '[A-Z]') and regexp_matches(v[i], '[a-z]'))"
        )
    return f"""select doc_id, '{kind}' as kind, '{part}' as part, {rank} as rank, t, s, s + length(f[i]) as e from (
        select *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) as s
        from (select *, unnest(range(1, len(f) + 1)) as i from (
            select doc_id, t, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}', 0) as f,
                regexp_extract_all(t, '{p}', {group}) as v from d))) where {good}"""


def secrets_sql() -> str:
    from .linked_secrets import BLANK_LINE, RANK, REACH, STRONG, WEAK

    union = lambda rules: " union all ".join(_span_rows(k, part, p, g, n, RANK[k]) for k, part, _, p, g, n in rules)
    blank = _span_rows("blank", "", BLANK_LINE, 0, 1, 0)
    near = "(select 1 from parts p where p.doc_id = w.doc_id and p.scope = w.scope and abs(p.s - w.s) <= {} and p.part = '{}')"
    secret, identifier = near.format(REACH, "secret"), near.format(REACH, "identifier")
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    strong as materialized ({union(STRONG)}), weak0 as materialized ({union(WEAK)}), blanks as materialized ({blank}),
    weak as (select * from weak0 w where not exists (
        select 1 from strong s where s.doc_id = w.doc_id and s.s < w.e and w.s < s.e)
        and not (w.kind = 'run' and exists (select 1 from weak0 i where i.kind = 'id' and i.doc_id = w.doc_id and i.s < w.e and w.s < i.e))),
    parts as materialized (select x.doc_id, kind, part, rank, s, e, (select count(*) from blanks b where b.doc_id = x.doc_id and b.s < x.s) as scope
        from (select * from strong union all select * from weak) x),
    linked as (select * from parts w where kind in ('id', 'run', 'endpoint') and case part
        when 'identifier' then exists {secret} when 'secret' then exists {identifier}
        else exists {secret} and exists {identifier} end),
    found as (select doc_id, kind, rank, s, e, true as base from strong union all select doc_id, kind, rank, s, e, false from linked),
    listed as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
        count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (base) as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from found group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join listed on listed.doc_id = d.doc_id"""


WINNOWING = r"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from documents),
items as (select item_id, ws, least(len(ws), 10) as n from (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from benchmark) where len(ws) > 0),
windows as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as w
    from (select *, unnest(range(1, len(ws) - n + 2)) as i from items)),
places as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as w from (
    select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from words, (select distinct n from items) where len(ws) >= n)),
found as (select p.doc_id, p.n, p.i, x.item_id from places p join windows x on p.w = x.w and p.n = x.n),
hit as (select doc_id, count(distinct i + k) as n_hit from (select doc_id, i, unnest(range(0, n)) as k from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join hit h on h.doc_id = w.doc_id left join named m on m.doc_id = w.doc_id"""


WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first from p where strlen(h) >= 100 group by h)
select page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha256(p.h) as payload_digest,
    case when first is null or first is not distinct from page_id then 'response' else 'revisit' end as record_type,
    case when first is distinct from page_id then first end as refers_to
from p left join f on f.h = p.h"""


def url_sql(rules) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
with rules(rhost, rpath, verdict) as (values {values}),
u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
d as (select distinct host, path from u),
fits as (select host, path, rhost || rpath as rule, verdict,
        row_number() over (partition by host, path order by length(rhost || rpath) desc, length(rhost) desc, verdict desc) as k
    from d, rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, u.host, u.path, rule, coalesce(verdict, 'allow') as verdict
from u left join fits on fits.host = u.host and fits.path = u.path and k = 1"""


PERSPECTIVES = r"""
with t as (select conv_id, turn, coalesce(cast(floor(turn / 64) as bigint), -1) as part,
        replace(coalesce(role, 'unknown'), '<|', '< |') as speaker, replace(coalesce(text, ''), '<|', '< |') as said from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
r as (select t.conv_id, perspective, part, turn, speaker, said, speaker = perspective as own,
        case when speaker = 'system' then '<|system|>' || chr(10) when speaker = perspective then '<|assistant|>' || chr(10)
             else '<|user name=' || speaker || '|>' || chr(10) end as head,
        said || chr(10) || '<|end|>' || chr(10) as body
    from t join p on p.conv_id is not distinct from t.conv_id),
o as (select *, coalesce(sum(length(head) + length(body)) over w, 0) as before from r
    window w as (partition by conv_id, perspective, part order by turn nulls first, speaker, said rows between unbounded preceding and 1 preceding))
select conv_id, perspective, part, count(*) as n_turns, cast(sum(length(head) + length(body)) as bigint) as n_chars,
    cast(coalesce(sum(length(body)) filter (own), 0) as bigint) as n_mask_chars,
    coalesce(string_agg((before + length(head))::bigint || ':' || (before + length(head) + length(body))::bigint, ',' order by turn nulls first, speaker, said) filter (own), '') as mask,
    sha256(string_agg(head || body, '' order by turn nulls first, speaker, said)) as rendered_sha256
from o group by conv_id, perspective, part"""



def _leaf(n_chars: str) -> str:
    fields = ("cast(doc_id as varchar)", "source", "lang", f"cast({n_chars} as varchar)", "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in fields) + ")"


#: CRC-32 bit by bit: at the first of eight steps a byte enters.
_CRC = """4294967295 - list_reduce(list_prepend(4294967295::bigint, range(8 * length(k))::bigint[]), lambda c, i:
    case when (case when i % 8 = 0 then xor(c, ascii(k[(i // 8 + 1)::int])) else c end) % 2 = 1
         then xor((case when i % 8 = 0 then xor(c, ascii(k[(i // 8 + 1)::int])) else c end) // 2, 3988292384)
         else (case when i % 8 = 0 then xor(c, ascii(k[(i // 8 + 1)::int])) else c end) // 2 end)"""

MERKLE = f"""
with recursive keyed as (select *, cast(doc_id as varchar) as k from documents),
leaf as materialized (select doc_id, lang, {_leaf("n_chars")} as h,
    case when ({_CRC}) % 7 = 0 then {_leaf("(n_chars + 1)")} else {_leaf("n_chars")} end as altered,
    row_number() over (partition by lang order by doc_id nulls first) - 1 as pos, count(*) over (partition by lang) as n from keyed),
tree as (select lang, 0 as lvl, pos, h, n from leaf
    union all select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2
    from tree where n > 1 group by lang, lvl, pos // 2, n),
subs as materialized (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (select 0 as lvl, pos, subroot as h, n from subs
    union all select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from top where n > 1 group by lvl, pos // 2, n),
leaf_steps as (select l.doc_id, l.lang, l.pos as place, s.lvl, (l.pos >> s.lvl) % 2 = 1 as odd, x.h
    from leaf l join (select distinct lang, lvl, n from tree) s on s.lang is not distinct from l.lang and s.n > 1
    left join tree x on x.lang is not distinct from l.lang and x.lvl = s.lvl and x.pos = xor(l.pos >> s.lvl, 1)),
top_steps as (select l.lang, s.lvl, (l.pos >> s.lvl) % 2 = 1 as odd, x.h
    from subs l join (select distinct lvl, n from top) s on s.n > 1
    left join top x on x.lvl = s.lvl and x.pos = xor(l.pos >> s.lvl, 1)),
steps as (select doc_id, lang, place, lvl, odd, h from leaf_steps
    union all select l.doc_id, l.lang, l.pos, 1000 + t.lvl, t.odd, t.h from leaf l join top_steps t on t.lang is not distinct from l.lang),
proofs as (select doc_id, lang, place, list(case when h is null then '-' when odd then 'L' || h else 'R' || h end order by lvl) as ss
    from steps group by doc_id, lang, place)
select l.doc_id, l.h as leaf, s.subroot, r.root,
    sha256(coalesce(list_aggregate(list_transform(p.ss, lambda x: x[2:]), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(list_prepend(l.altered, coalesce(p.ss, [])), lambda a, b: sha256(case b[1] when 'L' then b[2:] || a when 'R' then a || b[2:] else a end)) as folded_root,
    folded_root = r.root as verified
from leaf l join subs s on s.lang is not distinct from l.lang cross join (select h as root from top where n = 1) r
left join proofs p on p.doc_id is not distinct from l.doc_id and p.lang is not distinct from l.lang and p.place = l.pos"""

HARD_NEGATIVES = """
with v as materialized (select vec_id as id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as x
    from embeddings where label is not null and vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (select a.id as anchor_id, a.label as anchor_label, b.id, b.label, cast(list_inner_product(a.x, b.x) as bigint) as score
    from v a join v b on a.id % 100 = 0 and a.id <> b.id),
positives as (select anchor_id, id as positive_id, score as positive_score from scored where label = anchor_label
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as int) as rank, s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)
qualify row_number() over w <= 10"""
