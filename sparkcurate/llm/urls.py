r"""URL filters over redirect equivalence.

A rule names a host and the start of a path; it fits that host and all its subdomains, and the longest
rule that fits decides. A page that no rule fits takes over what rules say about its aliases: pages
are linked by the canonical address and the redirect they declare, connected components of these
links are aliases of each other, and within a component an explicit allow comes before a block.

Addresses are compared without scheme, fragment, default port and campaign parameters, so different
spellings of one address are one node from the start.

Scale: links are pairs of 128-bit digests; components run by star steps over the edge table and no
component is collected; verdicts are one aggregate per component, and the last joins are plain joins
that adaptive execution splits where a component holds a large share of the pages.

Defined results: a null address, or one without ``://``, has empty host and path, no rule and no
aliases, and is allowed; null html declares no links; pages repeated or with equal addresses are one
node and one row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.operators.components import connected_components
from sparkcurate.session import store

#: (verdict, rule): host, then the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``, else null."""
    found = F.lit(None)
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """An address in comparable form: host, path and the query without campaign parameters."""
    name = F.regexp_replace(host(url), r":(80|443)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)="))
    trail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(name, F.regexp_replace(path(url), "/$", ""), trail))


def declared(url: Column, html: Column) -> Column:
    """Absolute addresses that a page names as its canonical one or redirects to."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")),
        lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    redirect = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")),
        lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_replace(path(url), "[^/]*$", "")

    def whole(target: Column) -> Column:
        return (
            F.when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
        )

    found = F.filter(F.concat(canonical, redirect), lambda t: t != "")
    return F.when(url.contains("://") & html.isNotNull(), F.transform(found, whole)).otherwise(
        F.array().cast("array<string>")
    )


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_of``: every page with its rule and verdict.
    ``alias_of`` is the digest that names its component, null where a page has no address."""
    address_of = lambda c: F.md5(address(c))
    rows = store(
        pages.select(
            F.col(page_id).alias("page_id"), F.col(url).alias("url"), address_of(F.col(url)).alias("node"),
            declared(F.col(url), F.col(html)).alias("targets"),
        ),
        "url-rows",
    )
    links = rows.select("node", F.explode("targets").alias("target")).select(
        F.col("node").alias("a"), address_of(F.col("target")).alias("b"), "target"
    ).filter("b is not null")
    edges = links.select("a", "b")
    seen = rows.select("node", "url").unionByName(links.select(F.col("b").alias("node"), F.col("target").alias("url")))
    seen = seen.filter("node is not null")
    ruled = lambda c: rule(host(c), path(c), rules)
    linked = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    component = connected_components(linked, edges)
    says = seen.select("node", ruled(F.col("url")).verdict.alias("verdict")).filter("verdict is not null").join(
        component, "node", "left"
    )
    said = says.groupBy(F.coalesce("component", "node").alias("alias_of")).agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked")
    )
    # Pages without an address have no alias and stay out of the joins, where they would all share one key.
    addressed = rows.filter("node is not null").join(component, "node", "left")
    judged = addressed.withColumn("alias_of", F.coalesce("component", "node")).join(said, "alias_of", "left").unionByName(
        rows.filter("node is null"), allowMissingColumns=True
    )
    own = ruled(F.col("url"))
    method = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise(default)
    return judged.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), own.rule.alias("rule"),
        F.coalesce(own.verdict, method).alias("verdict"), "alias_of",
    )
