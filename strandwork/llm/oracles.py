"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations

from .secrets import RULES as SECRET_RULES
from .url_filter import BASE, CANONICAL, DIRECTORY, HEAD, HIDDEN, REFRESH
from .url_filter import RULES as URL_RULES


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(column: str, host: str, path: str) -> str:
    """The longest rule's name or verdict."""
    whens = []
    for verdict, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[0] == "block", r[1:])):
        value = h + p if column == "rule" else verdict
        whens.append(f"when ({host} = {_quoted(h)} or ends_with({host}, {_quoted('.' + h)})) and starts_with({path}, {_quoted(p)}) then {_quoted(value)}")
    return f"(case {' '.join(whens)} end)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract(regexp_extract({url}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract(regexp_extract({url}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*([^?#]*)', 1), '')"


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _address(url: str) -> str:
    path = _let("path", "regexp_extract(rest, '(?s)^[^?]*', 0)", f"{_without_dots('path')} || substr(rest, len(path) + 1)")
    rest = _let("rest", "substr(plain, len(head) + 1)", f"case when contains(rest, '/.') then {path} else rest end")
    head = _let("head", f"regexp_extract(plain, {_quoted(HEAD)}, 0)", f"case when head <> '' then translate(head, '{_UPPER}', '{_LOWER}') || {rest} end")
    return _let("plain", f"regexp_extract({url}, '(?s)^[^#]*', 0)", head)


def _without_dots(path: str) -> str:
    step = "case when x[1] = '..' then case when len(acc) > 1 then acc[1:len(acc) - 1] else acc end when x[1] = '.' then acc else list_concat(acc, x) end"
    walked = f"list_reduce(list_transform(string_split({path}, '/'), lambda p: [p]), lambda acc, x: {step}, cast([] as varchar[]))"
    return f"array_to_string({walked}, '/') || case when regexp_matches({path}, '/[.][.]?$') then '/' else '' end"


def _resolved(t: str, base: str) -> str:
    full = f"""case when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {t} when starts_with({t}, '//') then regexp_extract({base}, '(?s)^.*?:', 0) || {t}
      when starts_with({t}, '/') then regexp_extract({base}, {_quoted(HEAD)}, 0) || {t} when starts_with({t}, '#') then {base} when starts_with({t}, '?') then regexp_extract({base}, '(?s)^[^?]*', 0) || {t}
      when regexp_matches({base}, {_quoted(DIRECTORY)}) then regexp_extract({base}, {_quoted(DIRECTORY)}, 0) || {t} else regexp_extract({base}, {_quoted(HEAD)}, 0) || '/' || {t} end"""
    return _address(f"({full})")


def _targets(kind: tuple[str, str, str]) -> str:
    """The addresses in all tags of a kind."""
    tag, mark, value = map(_quoted, kind)
    return f"list_transform(list_filter(regexp_extract_all(html, {tag}, 0), lambda x: regexp_matches(x, {mark}) and regexp_matches(x, {value})), lambda x: regexp_extract(x, {value}, 1))"


OP5 = f"""with recursive p as (select page_id, url, html, {_host('url')} as host, {_path('url')} as path, {_address('url')} as addr from pages),
  h as (select addr as u, regexp_replace(html, {_quoted(HIDDEN)}, ' ', 'g') as html from p where html is not null and addr is not null and (contains(lower(html), 'canonical') or contains(lower(html), 'http-equiv'))),
  f as (select u, html, {_targets(BASE)}[1] as b from h), x as (select u, html, coalesce({_resolved('b', 'u')}, u) as base from f),
  t as (select u, base, unnest(list_concat({_targets(CANONICAL)}, {_targets(REFRESH)})) as t from x),
  e as (select u, {_resolved('t', 'base')} as v from t), b as (select u, v from e where u <> v union select v, u from e where u <> v),
  reach(node, other) as (select u, u from b union select r.node, b.v from reach r join b on r.other = b.u),
  c as (select node, min(other) as component from reach group by node),
  s as (select component, min({_case('verdict', _host('node'), _path('node'))}) as spread from c group by component),
  a as (select node, spread from c join s using (component) where spread is not null)
  select page_id, host, path, {_case('rule', 'host', 'path')} as rule, coalesce({_case('verdict', 'host', 'path')}, spread, 'allow') as verdict,
  case when {_case('verdict', 'host', 'path')} is not null then 'rule' when spread is not null then 'alias' else 'default' end as via
  from p left join a on a.node = p.addr"""


def _spans(rank: int) -> str:
    rule = SECRET_RULES[rank]
    pattern = _quoted(rule.pattern)
    keep = f"regexp_matches(hit, {_quoted(rule.keep)})" if rule.keep else "true"
    return f"""select n, {rank} as rank, '{rule.kind}' as kind, cast(start as bigint) as start, cast(start + len(hit) as bigint) as stop from (
    select n, hits[i] as hit, list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) as start
    from (select n, hits, gaps, unnest(range(1, len(hits) + 1)) as i from (select n, regexp_extract_all(text, {pattern}, 0) as hits, string_split_regex(text, {pattern}) as gaps from d where regexp_matches(text, {pattern}))))
    where {keep}"""


_BASE = sum(r.base for r in SECRET_RULES)
OP6 = f"""with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
  s as ({' union all '.join(_spans(i) for i in range(len(SECRET_RULES)))}),
  g as (select n, {', '.join(f"count(*) filter (rank = {i}) as n_{r.kind}" for i, r in enumerate(SECRET_RULES) if r.base)},
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < {_BASE}) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from s group by n)
  select doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in SECRET_RULES if r.base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
  from d left join g using (n)"""
