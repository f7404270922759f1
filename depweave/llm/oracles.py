"""DuckDB SQL that gives the rows of the corpus queries, where SQL can express them."""

from depweave.llm.chat import DEFAULT
from depweave.llm.common import UPPER_CHARS

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER_CHARS}', '{UPPER_CHARS.lower()}')"


OP3 = f"""
with d as (select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORDS}) w from documents),
b as (select item_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORDS}) w from benchmark),
bs as (select item_id, w, least(13, len(w)) k from b where len(w) > 0),
bw as (select distinct item_id, k, array_to_string(w[i + 1 : i + k], ' ') g from (select item_id, w, k, unnest(range(len(w) - k + 1)) i from bs)),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') g from (select doc_id, w, k, unnest(range(len(w) - k + 1)) i from d cross join ks where len(w) >= k)),
h as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
p as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from h) group by doc_id),
t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) items from h group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(p.n_hit, 0) as bigint) n_hit, cast(coalesce(t.n_items, 0) as bigint) n_items,
  sha256(coalesce(t.items, '')) items_sha256, coalesce(p.n_hit, 0) > 0 and 20 * coalesce(p.n_hit, 0) >= len(d.w) contaminated
from d left join p on p.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""


def _url_rules(rules: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)


def op4(rules: list[tuple[str, str, str]]) -> str:
    """The pages of the given tables hold no canonical link or refresh, so a url without a rule has no alias."""
    return f"""
with u as (select page_id, row_number() over () n, {_lower("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') path from pages),
r(verdict, host, path) as (values {_url_rules(rules)}),
f as (select u.n, arg_min({{'rule': r.host || r.path, 'verdict': r.verdict}}, (-length(r.host || r.path), r.verdict, r.host || r.path)) best
  from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by u.n)
select u.page_id, u.host, u.path, f.best.rule rule, coalesce(f.best.verdict, 'allow') verdict from u left join f on f.n = u.n
"""


def _escaped(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for mark in DEFAULT.controls():
        out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return out


def _marks() -> str:
    known = " ".join(f"when '{role}' then {len(a) + len(b)}" for role, (a, b) in DEFAULT.turns.items())
    return f"case role {known} else {sum(map(len, DEFAULT.other))} + length({_escaped('role')}) end"


def _states() -> str:
    """The states after a role, as a table of transitions."""
    return ", ".join(f"('{s}', '{r}', '{t}')" for (s, r), t in DEFAULT.transitions.items())


OP5 = f"""
with recursive c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) t(i)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) k from c),
m(state, role, next) as (values {_states()}),
s as (select conv_id, cast(0 as bigint) k, 'start' state from (select distinct conv_id from c)
  union all select s.conv_id, o.k, coalesce(m.next, 'error') from s join o on o.conv_id = s.conv_id and o.k = s.k + 1 left join m on m.state = s.state and m.role = o.role),
e as (select conv_id, arg_max(state, k) state from s group by conv_id)
select o.conv_id, count(*) n_turns, sha256(string_agg(o.role || chr(10) || o.text || chr(10), '' order by k)) turns_sha256,
  cast(coalesce(sum(length(o.text)) filter (o.role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(o.text, '' order by k) filter (o.role = 'assistant'), '')) loss_sha256,
  cast(sum(length({_escaped('o.text')}) + {_marks()}) as bigint) formatted_chars, any_value(e.state) = 'assistant' valid
from o join e on e.conv_id = o.conv_id group by o.conv_id
"""

OP6 = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) pos from d),
k as (select *, {_lower(f"trim(line, {_SPACES})")} key from l),
o as (select key, min(doc_id) owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, o.owner is not null and o.owner <> k.doc_id gone from k left join o on o.key = k.key)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from j group by doc_id
"""

#: For the shape that the given tables have: one article element whose blocks are p and h1, two kinds of references.
OP10 = r"""
with a as (select page_id, url, list_filter(list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>'),
  lambda s: trim(regexp_replace(replace(replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda s: s <> '') blocks from pages)
select page_id, url, array_to_string(blocks, chr(10)) as text, length(array_to_string(blocks, chr(10))) n_chars from a
"""

#: The base of op2: words, symbols, repeated lines and repeated three-word windows.
RULE_STATISTICS = r"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select r, i, array_to_string(w[i + 1 : i + 3], ' ') g from (select r, w, unnest(range(len(w) - 2)) i from d where len(w) >= 3)),
k as (select r, g from g group by 1, 2 having count(*) > 1),
p as (select g.r, count(distinct g.i + o.o) n from g join k on k.r = g.r and k.g = g.g cross join (values (0), (1), (2)) o(o) group by 1),
l as (select r, count(*) - count(distinct line) n from (select r, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  cast(coalesce(l.n, 0) as bigint) n_dup_lines, cast(coalesce(p.n, 0) as bigint) n_repeat_words, len(w) < 50 or 100 * coalesce(p.n, 0) > 50 * len(w) base_failed
from d left join l on l.r = d.r left join p on p.r = d.r
"""

#: Fingerprints made from document numbers: five share all but a few bits.
FINGERPRINTS = "select distinct cast(floor(doc_id / 5) as bigint) % 1000003 * 2654435761 * 256 + case doc_id % 5 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 3 else 56 end fp from {documents}"

#: Links of given fingerprints by comparing all pairs, and what they connect.
FINGERPRINT_COMPONENTS = f"""
with recursive f as ({FINGERPRINTS.format(documents="documents")}), l as (select a.fp u, b.fp v from f a join f b on a.fp <> b.fp and bit_count(xor(a.fp, b.fp)) <= 2),
c(a, b) as (select u, v from l union select c.a, l.v from c join l on l.u = c.b)
select a as fingerprint, least(a, min(b)) root from c group by a
"""
