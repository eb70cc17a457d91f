"""Block and allow rules for URLs, carried over to redirect and canonical aliases.

Pages are joined by the redirects and canonical links they declare. Within each connected component an
explicit allow of any member wins over a block of any other, and the result holds for the members
that no rule decides. Built-in functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.graph import components


class Rule(NamedTuple):
    verdict: str  # "block" or "allow"
    name: str  # host, then the path from its first slash


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))

_REST = r"^.*?://"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"


def _after_scheme(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """From behind the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased; else empty."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From behind the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule that fits, else null. A rule fits its host and all subdomains if the
    path starts with the rule's."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        domain, slash, rest = r.name.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def _verdict(rule: Column, rules: tuple[Rule, ...]) -> Column:
    found = F.lit(None).cast("string")
    for r in rules:
        found = F.when(rule == r.name, F.lit(r.verdict)).otherwise(found)
    return found


def _page_key(url: Column) -> Column:
    """What names a page: host and the rest up to a hash; the scheme and fragment do not matter."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.concat(host(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def declared_links(pages: DataFrame) -> DataFrame:
    """(url, target) for every canonical link and refresh redirect in the html of ``pages`` (url, html).

    Targets without a scheme are resolved against the page's own address.
    """
    some = pages.filter(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tag = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = F.col("tag").rlike(r"(?i)^<link\b") & F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")
    refresh = F.col("tag").rlike(r"(?i)^<meta\b") & F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    href = F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    goal = F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    found = tag.select("url", F.when(canonical, href).when(refresh, goal).otherwise(F.lit("")).alias("target")).filter("target <> ''")
    own = F.regexp_extract("url", r"^(?s).*?://[^/?#]*", 0)
    folder = F.regexp_extract(path(F.col("url")), r"^.*/", 0)
    target = F.col("target")
    full = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(own, target))
        .otherwise(F.concat(own, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )
    return found.select("url", full.alias("target"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) per row of ``pages`` (page_id, url, html).

    A page's own rule decides; else its component's: allow if any member is explicitly allowed, block
    if any is blocked; else ``default``. ``edges`` (url, target) adds known redirects. component is null for
    pages without aliases. A null url or one without ``://`` has an empty host and path and the default.
    Repeated rows are judged alike; an empty table gives an empty one.
    """
    links = declared_links(pages)
    if edges is not None:
        links = links.union(edges.select("url", "target").filter(F.col("url").contains("://") & F.col("target").contains("://")))
    node = lambda c: F.xxhash64(_page_key(F.col(c)))
    links = links.select("url", "target", node("url").alias("a"), node("target").alias("b"))
    named = components(links.select("a", "b"))
    ends = links.select(F.col("a").alias("node"), F.col("url").alias("address")).union(links.select("b", "target"))
    ends = ends.withColumn("verdict", _verdict(rule_of(host(F.col("address")), path(F.col("address")), rules), rules))
    allowed, blocked = (F.max(F.when(F.col("verdict") == v, 1).otherwise(0)) for v in ("allow", "block"))
    of_node = ends.groupBy("node").agg(allowed.alias("allowed"), blocked.alias("blocked"))
    joined = named.join(of_node, "node")
    of_component = joined.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    inherited = F.when(F.col("allowed") == 1, F.lit("allow")).when(F.col("blocked") == 1, F.lit("block"))
    aliases = named.join(of_component, "component").select("node", "component", inherited.alias("inherited"))
    own = pages.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        F.when(F.col("url").contains("://"), node("url")).alias("node"),
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(_verdict(F.col("rule"), rules), F.col("inherited"), F.lit(default))
    return own.join(aliases, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
