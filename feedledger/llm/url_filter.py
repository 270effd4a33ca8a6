"""URL rules, carried over redirects and canonical links (operator 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.llm.components import components
from feedledger.session import stage

#: (verdict, rule): a rule is a host, then a path from its first slash on.
Rules = Sequence[tuple[str, str]]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Rules) -> Column:
    """Struct (size, allow, rule) of the longest rule that fits, an allowing one at equal length; else null."""
    fits = []
    for verdict, rule in rules:
        own_host, slash, rest = rule.partition("/")
        here = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(rule).alias("rule"))))
    empty = F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")
    return F.greatest(empty, empty, *fits)


def resource(url: Column) -> Column:
    """The url without its fragment, which no server sees; null without a host."""
    return F.when(F.contains(url, F.lit("://")), F.substring_index(url, "#", 1))


def resolve(link: Column, base: Column) -> Column:
    """The absolute url a link on page ``base`` points to; null when there is none."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"(?s)^(.*?):", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    whole = (F.when((link == "") | F.startswith(link, F.lit("#")), F.lit(None).cast("string"))
             .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
             .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
             .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
             .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
             .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link)))
    return resource(whole)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (``source``, ``target``) from canonical links and from redirects by meta refresh."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    tag = (pages.where(F.contains(F.lower(html_col), F.lit("canonical")) | F.contains(F.lower(html_col), F.lit("refresh")))
           .select(F.col(url_col).alias("page_url"), F.explode(tags).alias("tag")))
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(name: str) -> Column:
        found = [F.regexp_extract("tag", rf"(?is)\s{name}{value}", k) for k in (1, 2, 3)]
        return F.concat(*found)

    canonical = F.when(F.lower(attribute("rel")).rlike(r"(^|\s)canonical(\s|$)"), attribute("href"))
    refresh = F.when(F.lower(F.trim(attribute("http-equiv"))) == "refresh",
                     F.regexp_extract(attribute("content"), r"""(?is)url\s*=\s*['"]?([^'"]*)""", 1))
    # Written once, so that each link is taken from its tag once and not at every use.
    links = stage(tag.select("page_url", F.coalesce(canonical, refresh).alias("link")).where("link IS NOT NULL"), "alias-links")
    return (links.select(resource(F.col("page_url")).alias("source"), resolve(F.col("link"), F.col("page_url")).alias("target"))
            .where("source IS NOT NULL AND target IS NOT NULL AND source <> target"))


def judge(pages: DataFrame, rules: Rules, edges: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``blocked_by_alias``.

    A url's own longest rule decides. A url without one is blocked when a url it is an alias of
    is blocked by its own rule, and allowed otherwise; aliases are the connected component over
    canonical links and redirects (``edges``, by default those found in the pages), pages outside
    the table included. An explicit allow takes precedence for its own url; it does not clear
    other aliases. Null urls and urls without ``://`` have empty host and path and no aliases; null
    html has no links; repeated rows are judged each; other columns are ignored.
    """
    edges = alias_edges(pages, url_col, html_col) if edges is None else edges
    members = components(edges, "source", "target")
    rule = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    judged = members.select("node", "component", rule.alias("own"))
    blocked = judged.where(F.col("own").isNotNull() & ~F.col("own.allow")).select("component").distinct()
    tainted = stage(judged.where(F.col("own").isNull()).join(blocked, "component", "left_semi").select("node"), "blocked-aliases")

    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    own = pages.select(F.col(id_col), F.col(url_col).alias("__url"), host.alias("host"), path.alias("path"))
    own = own.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("__node", resource(F.col("__url")))
    alias = F.col("node").isNotNull() & F.col("__best").isNull()
    verdict = F.when(F.col("__best").isNotNull(), F.when(F.col("__best.allow"), "allow").otherwise("block")).when(alias, "block").otherwise("allow")
    return own.join(tainted, F.col("__node") == F.col("node"), "left").select(
        id_col, "host", "path", F.col("__best.rule").alias("rule"), verdict.alias("verdict"), alias.alias("blocked_by_alias"))
