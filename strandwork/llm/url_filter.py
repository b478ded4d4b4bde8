"""URL filter: longest-rule verdicts, spread over redirect and canonical-link aliases.

Every step is a DataFrame expression; aliases are connected components over links between URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_by_count

#: Fixed values: (verdict, host, path) of the standard rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: What only looks like markup: comments and elements whose content is no markup.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<textarea\b.*?(?:</textarea\b|\z)|<title\b.*?(?:</title\b|\z)"
#: Tag, what it must carry, and the address in it.
CANONICAL = (r"(?is)<link\b[^>]*", r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b""", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""")
REFRESH = (r"(?is)<meta\b[^>]*", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""")
BASE = (r"(?is)<base\b[^>]*", r"(?is)\bhref\s*=", CANONICAL[2])
#: The scheme and host of an address, and its directory.
HEAD, DIRECTORY = r"(?s)^.*?://[^/?]*", r"(?s)^.*?://[^/?]*[^?]*/"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits; allow goes before block at a tie.

    ``rules`` is a hand-kept list that becomes one CASE expression, longest rule first.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it names more than once, so that the expression holds the value once."""
    return F.transform(F.array(value), body)[0]


def address(url: Column) -> Column:
    """What a request would ask for: the url without fragment and dot segments, with scheme and host in lower case."""

    def whole(plain: Column) -> Column:
        return _let(F.regexp_extract(plain, HEAD, 0), lambda head: F.when(head != "", F.concat(lower_ascii(head), after(F.substring(plain, F.length(head) + 1, F.length(plain))))))

    def after(rest: Column) -> Column:
        query = lambda path: F.substring(rest, F.length(path) + 1, F.length(rest))
        return F.when(rest.contains("/."), _let(F.regexp_extract(rest, r"(?s)^[^?]*", 0), lambda path: F.concat(_without_dots(path), query(path)))).otherwise(rest)

    return _let(F.regexp_extract(url, r"(?s)^[^#]*", 0), whole)


def _without_dots(path: Column) -> Column:
    """The path with . and .. carried out; above the top there is nothing."""
    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    walked = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(walked, "/"), F.when(path.rlike("/[.][.]?$"), F.lit("/")).otherwise(F.lit("")))


def resolved(target: Column, base: Column) -> Column:
    """The address that ``target`` names on a page whose address is ``base``."""
    return address(_let(target, lambda t: _let(base, lambda b: _full(t, b))))


def _full(target: Column, base: Column) -> Column:
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^.*?:", 0), target))
        .when(target.startswith("/"), F.concat(F.regexp_extract(base, HEAD, 0), target))
        .when(target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^[^?]*", 0), target))
        .when(base.rlike(DIRECTORY), F.concat(F.regexp_extract(base, DIRECTORY, 0), target))
        .otherwise(F.concat(F.regexp_extract(base, HEAD, 0), F.lit("/"), target))
    )


def _targets(html: Column, kind: tuple[str, str, str]) -> Column:
    """The addresses in all tags of a kind, in order."""
    tag, mark, value = kind
    tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: x.rlike(mark) & x.rlike(value))
    return F.transform(tags, lambda x: F.regexp_extract(x, value, 1))


def links(pages: DataFrame) -> DataFrame:
    """(u, v): a page's address and those that the canonical links and refreshes in its html name.

    All such tags count, but for those in comments, scripts, styles, titles and text areas. Relative
    targets are resolved against the page's first base element, or else its address.
    """
    u = address(F.col("url"))
    found = pages.where("url is not null and html is not null").where(
        F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv")
    )
    found = found.select(u.alias("u"), F.regexp_replace("html", HIDDEN, " ").alias("html"))
    base = F.coalesce(resolved(F.get(_targets(F.col("html"), BASE), 0), F.col("u")), F.col("u"))
    found = found.select("u", base.alias("base"), F.explode(F.concat(_targets(F.col("html"), CANONICAL), _targets(F.col("html"), REFRESH))).alias("t"))
    return found.select("u", resolved(F.col("t"), F.col("base")).alias("v")).where("u is not null and v is not null")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, via.

    A url's own rule decides first. Without one, the aliases decide: addresses that redirects
    (``redirects``: u, v), canonical links and refreshes join into one component. If a rule
    allows any alias, the page is allowed; else if a rule blocks any, it is blocked; else it is
    allowed. via: rule, alias or default. Link targets outside ``pages`` count with their own rules.
    A component, or an address, that very many rows share isn't gathered in one task.

    Null, empty and odd urls have empty host and path, no rule and the verdict allow. Repeated rows
    stay. An empty table gives an empty result; further columns are ignored.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("u")).alias("u"), address(F.col("v")).alias("v")))
    groups = connected_components(edges).withColumnRenamed("node", "address")
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", address(F.col("url")).alias("address"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("own"))
    # A component's addresses carry the rules: they cover all its pages, and targets that aren't pages.
    node_host, node_path = host_and_path(F.col("address"))
    _, node_verdict = longest_rule(node_host, node_path, rules)
    spread = groups.groupBy("component").agg(F.min(node_verdict).alias("spread"), F.count("*").alias("n"))  # allow < block: allow has precedence
    spread = cut(spread.where("spread is not null"))
    by_address = join_by_count(groups, spread, "component", "n").where("spread is not null").select("address", "spread")
    rows = judged.groupBy("address").agg(F.count("*").alias("n"))
    out = join_by_count(judged, cut(by_address.join(rows, "address")), "address", "n")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", "spread", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default").alias("via"),
    )
