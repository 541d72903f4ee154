"""URL rules, and block decisions that follow redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators.graph import components

_MOST_RULES = 1000


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, or nulls.  ``rules``: ``(host and path, verdict)``."""
    if len(rules) > _MOST_RULES:
        raise ValueError(f"at most {_MOST_RULES} rules fit into an expression")
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def without_fragment(url: Column) -> Column:
    """The name of a resource: the url up to ``#``, scheme and host lower-cased, a slash behind a bare host."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    at = F.instr(bare, "://")
    tail = F.substring(bare, at + 3 + F.length(host_of(bare)), F.length(bare))
    return F.when(at > 0, F.concat(F.lower(F.substring(bare, F.lit(1), at + 2)), host_of(bare), F.when(F.startswith(tail, F.lit("/")), "").otherwise("/"), tail))


def resolved(base: Column, target: Column) -> Column:
    """``target`` as a page at ``base`` means it: absolute ones as they are, others joined and freed of dot segments.

    Null where the target is relative and the base has no scheme and host.
    """
    origin = F.regexp_extract(base, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    own = F.regexp_extract(F.substring(base, F.length(origin) + 1, F.length(base)), r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    path, tail = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(own, r"(?s)^/(.*/)", 1))
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    steps = F.split(whole, "/")
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    joined = F.concat(origin, F.array_join(kept, "/"), ends, tail)
    same = F.concat(origin, own, F.when(F.startswith(tail, F.lit("?")), tail).otherwise(F.concat(query, tail)))
    relative = F.when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(origin, "^([^:]*:)", 1), target)).when(path == "", same).otherwise(joined)
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target).when(origin != "", relative)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)``: all canonical links and refresh redirects that pages declare, relative ones by the page's address.

    The address is the page's url or its first base tag's.  Tags inside comments and scripts count as well.
    """
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
    base = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    plain = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    url, html = F.col(url_col).cast("string"), F.col(html_col)
    targets = F.concat(*[F.regexp_extract_all(html, F.lit(p), 1) for p in (tag, refresh)])
    some = pages.filter(html.rlike("(?i)canonical|refresh"))  # one look tells that most pages hold neither
    # few pages hold tags: they are written at each step, so that no step repeats the expressions of the one before
    found = cut(some.select(url.alias("_u"), plain(F.regexp_extract(html, base, 1)).alias("_b"), F.explode(targets).alias("_v")))
    if found.isEmpty():
        return found.select(F.col("_u").alias("src"), F.col("_v").alias("dst"))
    placed = cut(found.select("_u", F.when(F.col("_b") == "", F.col("_u")).otherwise(F.coalesce(resolved(F.col("_u"), F.col("_b")), F.col("_u"))).alias("_at"), plain(F.col("_v")).alias("_v")))
    found = cut(placed.select("_u", resolved(F.col("_at"), F.col("_v")).alias("_v")))
    return found.select(without_fragment(F.col("_u")).alias("src"), without_fragment(F.col("_v")).alias("dst")).filter("src is not null and dst is not null and src <> dst")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``.

    A page with a fitting rule gets its verdict.  Other pages take the verdict of their component over
    redirect and canonical links (``edges`` ``(src, dst)`` on urls, by default what the pages declare): blocked
    if a url of the component, a page or only the target of a link, is blocked by a rule and none is allowed
    by one; allowed otherwise.

    - Only urls that take part in links enter the components and the join; the pages' other columns do not.
      A hub that a third of all pages point to is one vertex, joined by its own row.
    - Null urls and urls without ``://`` have an empty host and path and are allowed; repeated rows are judged
      once each; an empty table gives no rows.
    """
    u = F.col(url_col).cast("string")
    host, path = host_of(u), path_of(u)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), without_fragment(u).alias("_n")).withColumns({"rule": rule, "_v": verdict})
    e = cut((edges.select(without_fragment(F.col("src")).alias("src"), without_fragment(F.col("dst")).alias("dst")) if edges is not None else links(pages, url_col, html_col)).distinct())
    if e.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("_v", F.lit("allow")).alias("verdict"))
    member = cut(components(e))
    _, own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    said = member.select("component", own.alias("_o")).groupBy("component").agg(F.max(F.col("_o") == "block").alias("_b"), F.max(F.col("_o") == "allow").alias("_a"))
    blocked = said.filter("_b and not coalesce(_a, false)").select("component")
    aliases = member.join(blocked, "component").select(F.col("node").alias("_n"), F.lit("block").alias("_c"))
    out = judged.join(aliases, "_n", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_v", "_c", F.lit("allow")).alias("verdict"))
