"""SQL of the bootstrapped extraction, written apart from it: rules are tried on whole texts, and slots get the spans inside them."""

from __future__ import annotations

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
LUHN = "list_sum(list_transform(list_reverse(string_split(d, '')), lambda x, i: case when i % 2 = 1 then x::int else 2 * x::int - case when x::int > 4 then 9 else 0 end end)) % 10 = 0"
PASSES = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(right(p, 3) as int), 0) > 255 or (length(ltrim(p, '0')) = 3 and ltrim(p, '0') > '255'))) = 0",
    "card": f"case when length(d) between 13 and 19 then {LUHN} else false end",
    "phone": "length(d) between 9 and 15",
}
MAKES = {"email": ("^[^@ ]+@[^@ ]+$", 0, 64), "ip": ("^[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){3,}$", 2, 32), "card": ("^[0-9][0-9 -]*$", 12, 19), "phone": (r"^[+(]?[0-9][0-9(). -]*$", 6, 15)}
WORD = r"[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*"
SLOT = rf"{WORD}([\x20\x09-\x0D]+([().-]+[\x20\x09-\x0D]+)*{WORD})*"


def op11(rounds: int = 3, support: int = 5, accept: float = 0.6, final: float = 0.75, longest: int = 96) -> str:
    found = " union all ".join(
        f"select *, {k} as kind, '{kind}' as name from (select row, e - length(m) as s, e, m, {DIGITS.format('m')} as d from (select row, m, sum(length(g) + length(m)) over (partition by row order by i) as e "
        f"from (select row, unnest(regexp_extract_all(text, '{rule}')) as m, unnest(regexp_split_to_array(text, '{rule}')) as g, unnest(range(len(regexp_split_to_array(text, '{rule}')))) as i from t) where m is not null)) where {PASSES[kind]}"
        for k, (kind, rule) in enumerate(RULES.items())
    )
    short = lambda c: f"case when length({c}) <= {longest} then {c} else sha256({c}) end"
    lowered = lambda c: f"list_filter(regexp_split_to_array(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    makes = " + ".join(f"case when regexp_matches(inst, '{p}') and length({DIGITS.format('inst')}) between {lo} and {hi} then {1 << k} else 0 end" for k, (p, lo, hi) in enumerate(MAKES.values()))
    kinds = range(len(RULES))
    out = rf"""
with t as materialized (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
b as materialized ({found}),
s as (
  select row, i, hit, before, after, sum(length(before) + length(hit)) over (partition by row order by i) - length(hit) as s from (
    select row, unnest(regexp_extract_all(text, '{SLOT}')) as hit, unnest(regexp_split_to_array(text, '{SLOT}')) as before,
      unnest(regexp_split_to_array(text, '{SLOT}')[2:]) as after, unnest(range(len(regexp_split_to_array(text, '{SLOT}')))) as i from t) where hit is not null
), c as (
  select row, i, s + length(hit) - length(lead) as s, regexp_replace(lead, '[^A-Za-z0-9)]+$', '') as inst, {lowered("before")} as l, {lowered("after")} as r, mask
  from (select s.*, regexp_replace(hit, '^[^A-Za-z0-9+(@]+', '') as lead, coalesce(mask, 0) as mask
    from s left join (select s.row, s.i, bit_or(1 << kind) as mask from s join b on b.row = s.row and b.s >= s.s and b.e <= s.s + length(hit) group by all) using (row, i))
), d as materialized (
  select row, s, s + length(inst) as e, {short("inst")} as inst, mask, {makes} as makes, [
    '2 ' || {short("coalesce(l[-2], '^') || ' ' || coalesce(l[-1], '^')")}, '1 1 ' || {short("coalesce(l[-1], '^') || ' ' || coalesce(r[1], '$')")}, '1 ' || {short("coalesce(l[-1], '^')")}] as patterns from c
), p as materialized (select pattern, inst, max(mask) as mask, max(makes) as makes from (select inst, mask, makes, unnest(patterns) as pattern from d where inst <> '' and mask in (0, 1, 2, 4, 8)) group by all),
n as (select count(*) as n, {", ".join(f"count(*) filter (mask = {1 << k}) as n{k}" for k in kinds)} from (select inst, max(mask) as mask from p group by inst)),
g as (select pattern, count(*) as n, {", ".join(f"count(*) filter (mask = {1 << k}) as s{k}" for k in kinds)} from p group by pattern),
u as (select pattern, inst, makes from p where mask = 0 and makes > 0),
z0 as (select '' as inst, 0 as kind, 0.0::double as score where false)
"""
    for r in range(1, rounds + 1):
        trust = lambda k: f"round((s{k} + t{k} - n{k}::double / nn * n) / ((1 - n{k}::double / nn) * (n + 1)), 9)"
        told = " union all ".join(f"select pattern, {k} as kind, {trust(k)} as trust from m{r} where n{k} < nn and {trust(k)} >= {accept} and s{k} + u{k} >= {support}" for k in kinds)
        out += f""", m{r} as (
  select g.*, n.n as nn, {", ".join(f"n.n{k}, coalesce(t{k}, 0) as t{k}, coalesce(u{k}, 0) as u{k}" for k in kinds)} from g cross join n left join (
    select pattern, {", ".join(f"sum(score) filter (kind = {k}) as t{k}, count(*) filter (kind = {k} and score >= {final}) as u{k}" for k in kinds)} from u join z{r - 1} using (inst) group by pattern) using (pattern)
), k{r} as ({told}),
z{r} as materialized (
  select inst, kind, score from (select inst, kind, round(1 - exp(sum(ln(1 - least(trust, 0.999999::double)))), 9) as score from u join k{r} using (pattern) where makes & (1 << kind) > 0 group by all)
  qualify row_number() over (partition by inst order by score desc, kind) = 1)
"""
    spans = lambda c: f"string_agg(name || ':' || s || ':' || e, ',' order by kind, s, e) {c}"
    return out + f""", a as (select row, kind, s, e, false as own from d join z{rounds} using (inst) where mask = 0 and makes > 0 and score >= {final} union all select row, kind, s, e, true from b),
o as (select row, {spans('')} as spans, {spans('filter (own)')} as own, {", ".join(f"count(*) filter (own and kind = {k}) as n{k}" for k in kinds)} from (
  select *, case kind when 0 then 'email' when 1 then 'ip' when 2 then 'card' else 'phone' end as name from a) group by row)
select doc_id, {", ".join(f"cast(coalesce(n{k}, 0) as bigint) as n_{kind}" for k, kind in enumerate(RULES))}, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans from t left join o using (row)
"""
