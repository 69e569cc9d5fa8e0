"""SQL of the repair of conversations, written apart from it: windows, and a recursive query that takes one turn after the other."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]"


def _least(*options: str) -> str:
    """The least of (cost, audit) structs; an absent one is null."""
    return f"list_min(list_filter([{', '.join(options)}], lambda z: z is not null))"


def _then(state: str, cost: str, letter: str) -> str:
    return f"case when {state} is not null then {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || {letter}}} end"


def op12() -> str:
    user = _least("i", _then("n", "2", "'I'"), _then("s", "2", "'I'"), _then("a", "2", "'I'"))
    answer = _least("a", _then("iu", "2", "'I'"))
    stays = lambda state, c: f"case when not gone then {_then(state, f'''(cut::int + case when initial = '{c}' then 0 else 2 end)''', f'''case when initial = '{c}' then 'K' else 'R' end''')} end"
    state = "{'cost': 0, 'audit': ''}"
    none = "cast(null as struct(cost integer, audit varchar))"
    return rf"""
with recursive steps as (
  select list_transform(range(256), lambda b: list_reduce(list_transform(range(8), lambda x: 0::bigint), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) as t
), k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as k
  from conversations, steps
), d as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from k, range(2) r(copy) where k <> 0 and (copy = 0 or k = 3)
), o as (
  select *, left(role, 1) as initial, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn from d
), f as (
  select *,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by rn) > 1 then 'duplicate'
      when regexp_extract(text, '([^\x20\x09-\x0D]){BLANK}*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from o
), g as (
  select *, fault in ('blank', 'duplicate') as gone, fault = 'truncated' as cut, lag(initial) over (partition by conv_id order by rn) || initial as pair from f
), c as (select conv_id, row_number() over () as cid from (select distinct conv_id from conversations)
), x as (select c.cid, g.* from g join c on g.conv_id is not distinct from c.conv_id
), w(cid, rn, n, s, i, a) as (
  select cid, 0::bigint, {state}, {none}, {none}, {none} from c
  union all
  select cid, rn, {_then("n", "3", "'D'")}, {_least(_then("s", "3", "'D'"), f"case when initial = 's' then {stays('n', 's')} end")},
    {_least(_then("iu", "3", "'D'"), stays(_least("n", "s", "ia"), "u"))}, {_least(_then("ia", "3", "'D'"), stays("iu", "a"))}
  from (select *, {answer} as ia from (select w.cid, x.rn, n, s, i, a, {user} as iu, x.initial, x.gone, x.cut from w join x on x.cid = w.cid and x.rn = w.rn + 1))
), e as (
  select cid, {_least("n", "ia")} as best from (select *, {answer} as ia from (select *, {user} as iu from w)) qualify row_number() over (partition by cid order by rn desc) = 1
), l as (
  -- The letters of an audit, each with the number of its turn (of the next one for an insertion) and its place among those that stay.
  select cid, p, letter, count(*) filter (letter <> 'I') over (partition by cid order by p) as rn, count(*) filter (letter <> 'D') over (partition by cid order by p) as place
  from (select cid, unnest(string_split(best.audit, '')) as letter, unnest(range(length(best.audit))) as p from e where best.audit <> '')
), m as (
  select l.*, x.role, x.text, max(case when place = 1 and letter = 'K' and x.initial = 's' then 1 else 0 end) over (partition by l.cid) as lead
  from l left join x on x.cid = l.cid and x.rn = l.rn and letter <> 'I' where letter <> 'D'
), r as (
  select cid, string_agg(case when letter = 'K' then role when (place - 1 - lead) % 2 = 0 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) as said from m group by cid
), n as (
  select cid, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from x group by cid
)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
  cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(best.cost as bigint) as cost, best.audit as audit, sha256(coalesce(said, '')) as repaired_sha256
from c join e using (cid) left join n using (cid) left join r using (cid)
"""
