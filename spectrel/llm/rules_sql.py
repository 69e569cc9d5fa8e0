"""SQL of the quality rules for another engine, written apart from ``rules``: the covariance is taken in two blocks of two, with
the determinant and distance of the first block and of what is left of the second (no triangular factor), and steps are unrolled."""

from __future__ import annotations

_PRODUCTS = [(i, j) for i in range(1, 5) for j in range(i, 5)]
_SUMS = ", ".join([f"sum(z{i}) as t{i}" for i in range(1, 5)] + [f"sum(z{i} * z{j}) as t{i}{j}" for i, j in _PRODUCTS])
_NAMES = [f"t{i}" for i in range(1, 5)] + [f"t{i}{j}" for i, j in _PRODUCTS]
_FIELDS = "m1, m2, m3, m4, v11, v12, v22, da, k31, k32, k41, k42, r33, r34, r44, ds, logdet"
_G = "level, g_lang, g_source"

_COUNTS = r"""
w as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text, lang, source,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select rid, unnest(range(len(w) - 2)) as i, w from w where len(w) >= 3),
g as materialized (select rid, i, w[i + 1] as a, w[i + 2] as b, w[i + 3] as c from p),
d as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as k from g) where k > 1),
q as (select rid, count(distinct i + j) as n_repeat_words from d, (select unnest([0, 1, 2]) as j) group by rid),
b as materialized (select rid, doc_id, coalesce('=' || lang, 'null') as k_lang, coalesce('=' || source, 'null') as k_source, cast(len(w) as bigint) as n_words,
  cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(length(text) - length(regexp_replace(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) as bigint) as n_marks,
  cast(length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as bigint) as n_capitals,
  cast(len(list_filter(w, lambda x: length(x) <= 3)) as bigint) as n_short,
  cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words from w left join q using (rid)),
s as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  case when n_words > 0 then floor(1000 * (n_marks * cast(1 as double) / n_words) + 0.5) end as s1,
  case when n_words > 0 then floor(1000 * (n_capitals * cast(1 as double) / n_words) + 0.5) end as s2,
  case when n_words > 0 then floor(1000 * ln(word_chars * cast(1 as double) / n_words) + 0.5) end as s3,
  case when n_words > 0 then floor(1000 * (n_short * cast(1 as double) / n_words) + 0.5) end as s4 from b)"""


def _moments(n: str, factor: float, spread: float) -> str:
    """From n and the sums: means, the first block, its determinant, the regression of the second on it, and what is left."""
    cov = [f"{factor} * (t{i}{j} / {n} - m{i} * m{j})" + (f" + {spread}" if i == j else "") + f" as v{i}{j}" for i, j in _PRODUCTS]
    means = ", ".join(f"t{i} / {n} as m{i}" for i in range(1, 5))
    return f"""(select *, ln(da) + ln(ds) as logdet from (select *, r33 * r44 - r34 * r34 as ds from (
      select *, v33 - (k31 * v13 + k32 * v23) as r33, v34 - (k41 * v13 + k42 * v23) as r34, v44 - (k41 * v14 + k42 * v24) as r44 from (
      select *, (v13 * v22 - v23 * v12) / da as k31, (v23 * v11 - v13 * v12) / da as k32, (v14 * v22 - v24 * v12) / da as k41, (v24 * v11 - v14 * v12) / da as k42 from (
      select *, v11 * v22 - v12 * v12 as da from (select *, {", ".join(cov)} from (select *, {means} from %s)))))))"""


def _distance(source: str) -> str:
    return f"""(select *, (v22 * u1 * u1 - 2 * v12 * u1 * u2 + v11 * u2 * u2) / da + (r44 * u3 * u3 - 2 * r34 * u3 * u4 + r33 * u4 * u4) / ds as d2 from (
      select *, z3 - m3 - (k31 * u1 + k32 * u2) as u3, z4 - m4 - (k41 * u1 + k42 * u2) as u4 from (select *, z1 - m1 as u1, z2 - m2 as u2 from {source})))"""


def _z(i: int) -> str:
    return f"greatest(-16000, least(16000, floor(sqrt(least(n_words, 2500)) * (s{i} - a{i}) + 0.5)))"


def op6(min_group: int = 200, steps: int = 20, starts: int = 5, drawn: int = 6) -> str:
    draws = []
    for k in range((starts - 2) * drawn):
        linear = f"(((z1 * 17046029254387 + z2 * 11817834972767 + z3 * 26858216577363 + z4 * 23546855649369 + {k} * 18658112351221) % 2147483647) + 2147483647) % 2147483647"
        draws.append(f"min(struct_pack(h := ({linear} * {48271 + 2 * k} + {k}) % 2147483647, z1 := z1, z2 := z2, z3 := z3, z4 := z4)) as p{k}")
    begin = ["select *, 0 as start, n_docs as n, " + ", ".join(["cast(0 as double) as m1, cast(0 as double) as m2, cast(0 as double) as m3, cast(0 as double) as m4"] + [f"cast({160000 if i == j else 0} as double) as v{i}{j}" for i, j in _PRODUCTS]) + " from o0"]
    blocks = f"""(select *, ln(da) + ln(ds) as logdet from (select *, v33 * v44 as ds, cast(0 as double) as k31, cast(0 as double) as k32, cast(0 as double) as k41, cast(0 as double) as k42, v33 as r33, v34 as r34, v44 as r44 from (select *, v11 * v22 as da from ({begin[0]}))))"""
    first = [f"select {_G}, start, n_docs, {_FIELDS}, true as moved from {blocks}"]
    first.append(f"select {_G}, 1 as start, n_docs, {_FIELDS}, true as moved from " + _moments("n_docs", 1.0, 900.0) % "o0")
    for s in range(starts - 2):
        own = [f"p{k}" for k in range(s * drawn, (s + 1) * drawn)]
        sums = [f"cast({' + '.join(f'{p}.z{i}' for p in own)} as double) as t{i}" for i in range(1, 5)] + [f"cast({' + '.join(f'{p}.z{i} * {p}.z{j}' for p in own)} as double) as t{i}{j}" for i, j in _PRODUCTS]
        first.append(f"select {_G}, {s + 2} as start, n_docs, {_FIELDS}, true as moved from " + _moments(f"{drawn}.0", 1.0, 10000.0) % f"(select {_G}, n_docs, {', '.join(sums)} from o0)")
    parts = [
        _COUNTS.strip(),
        "c2 as materialized (select k_lang, k_source, count(*) filter (where not base_failed) as n2 from s group by all)",
        "c1 as materialized (select k_lang, sum(n2) as n1, min(n2) as least from c2 group by all)",
        f"""h as materialized (select c2.*, n1, least, case when n2 >= {min_group} then 2 when n1 >= {min_group} then 1 else 0 end as level from c2 join c1 using (k_lang))""",
        f"""r as materialized (select 2 as level, k_lang as g_lang, k_source as g_source, n_words, s1, s2, s3, s4 from s join h using (k_lang, k_source) where not base_failed and n2 >= {min_group}
          union all select 1, k_lang, '', n_words, s1, s2, s3, s4 from s join h using (k_lang, k_source) where not base_failed and least < {min_group} and n1 >= {min_group}
          union all select 0, '', '', n_words, s1, s2, s3, s4 from s where not base_failed and (select min(n1) from c1) < {min_group})""",
        f"a as materialized (select {_G}, " + ", ".join(f"quantile_cont(s{i}, 0.5) as a{i}" for i in range(1, 5)) + f" from r group by {_G})",
        f"z as materialized (select {_G}, " + ", ".join(f"cast({_z(i)} as bigint) as z{i}" for i in range(1, 5)) + f" from r join a using ({_G}))",
        f"o0 as materialized (select {_G}, count(*) as n_docs, {_SUMS}, {', '.join(draws)} from z group by {_G})",
        "e0 as materialized (" + " union all ".join(first) + ")",
    ]
    for k in range(1, steps + 1):
        joined = f"(select z.*, e.* exclude ({_G}) from z join e{k - 1} e using ({_G}) where e.moved)"
        parts += [
            f"b{k} as (select {_G}, start, n_docs, cast(floor(ln(1 + d2) * 256) as int) as bin, count(*) as k, {_SUMS} from {_distance(joined)} group by all)",
            f"f{k} as (select *, least(n_docs, (n_docs + 5) // 2) as half, coalesce(sum(k) over (partition by {_G}, start order by bin rows between unbounded preceding and 1 preceding), 0) as before from b{k})",
            f"t{k} as (select {_G}, start, n_docs, cast(max(half) as double) as n, " + ", ".join(f"cast(coalesce(sum({t}) filter (where before + k <= half), 0) as double) + coalesce(max((half - before) / cast(k as double)) filter (where before < half and before + k > half), 0) * cast(coalesce(max({t}) filter (where before < half and before + k > half), 0) as double) as {t}" for t in _NAMES) + f" from f{k} group by all)",
            f"e{k} as materialized (select n.{_FIELDS.replace(', ', ', n.')}, n.level, n.g_lang, n.g_source, n.start, n.n_docs, abs(n.logdet - e.logdet) > 0.005 as moved from {_moments('n', 2.109, 900.0) % f't{k}'} n join e{k - 1} e using ({_G}, start) where e.moved union all by name select * from e{k - 1} where not moved)",
        ]
    best = f"(select * exclude (rank) from (select *, row_number() over (partition by {_G} order by logdet, start) as rank from e{steps}) where rank = 1)"
    parts += [
        f"n as (select {_G}, cast(count(*) as double) as n, {_SUMS} from {_distance(f'(select z.*, e.* exclude ({_G}) from z join {best} e using ({_G}))')} where d2 <= 11.143 group by all)",
        f"y as materialized (select n.*, a.* exclude ({_G}) from {_moments('n', 1.0645, 900.0) % 'n'} n join a using ({_G}))",
        f"x as (select s.*, y.* exclude ({_G}, n, t1, t2, t3, t4), " + ", ".join(f"{_z(i)} as z{i}" for i in range(1, 5)) + " from s join h using (k_lang, k_source) left join y on y.level = h.level and y.g_lang = case when h.level > 0 then s.k_lang else '' end and y.g_source = case when h.level = 2 then s.k_source else '' end)",
    ]
    return "with " + ",\n".join(parts) + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2 <= 23.51, false) as kept from {_distance("x")}"""
