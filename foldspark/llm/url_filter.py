"""URL rules with redirect equivalence.

Main path: DataFrame functions only (no Python runs on the executors).

1. Every url is split into host and path and matched with the rule table. A rule
   fits its host and all subdomains when the url's path starts with the rule's
   path; the longest fitting rule decides.
2. Redirect and canonical-link edges make urls aliases of one another. Connected
   components over these edges are found by star contraction.
3. A url without a rule of its own is blocked when a block rule fits any alias in
   its component and is allowed otherwise. A rule that fits the url itself always
   decides for it, so an explicit allow is never overruled by a blocked alias.
4. The wider classes, in which a url is also one with its address without query, ``.html`` and closing slash,
   are found beside these. No page states that such addresses are one page, so they are reported and decide nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm.common import connected_components, stored

#: The rules the query applies: (host, path, verdict). Fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased)
    and path (from there up to ``?``, ``#`` or end). Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    has = F.coalesce(at, F.lit(0)) > 0
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """All domain suffixes of a host, itself included: a.b.c, b.c, c."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_rules(urls: DataFrame, rules: DataFrame, key: str, most_rules: int = 10_000) -> DataFrame:
    """``key, rule, rule_verdict`` for each row of ``urls`` (``key, host, path``) that a rule fits.

    ``rules`` is ``(host, path, verdict)``. Up to ``most_rules`` rules, a counted
    and therefore proven bound, are one literal in the projection: no join, no
    shuffle. Longer lists join on the domain suffix: rules group by host, urls
    explode their suffixes and a partial ``max`` picks the longest rule. Both ways give
    the same rows. Longest means most characters of host and path together; equal
    lengths cannot both fit with different texts of one host, and between a longer
    host and a longer path the longer host wins. Null hosts or paths of rules are
    skipped; of repeated rules with both verdicts, allow wins.
    """
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(
        F.min("verdict").alias("verdict"))
    ranked = rules.select("host", F.struct(
        (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"),
        F.col("path").alias("path"), F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("verdict")).alias("r"))
    small = ranked.limit(most_rules + 1).collect()
    if not small:
        return urls.select(key, F.lit(None).cast("string").alias("rule"),
                           F.lit(None).cast("string").alias("rule_verdict")).where("false")
    if len(small) <= most_rules:
        best = None
        for host, r in sorted(small, key=lambda x: (-x.r.n, -x.r.h, x.r.rule)):
            hit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(r.path)
            value = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("rule_verdict"))
            best = F.when(hit, value) if best is None else best.when(hit, value)
        return urls.select(key, best.alias("b")).where("b is not null").select(
            key, "b.rule", "b.rule_verdict")
    wide = urls.select(key, "path", F.explode(host_suffixes(F.col("host"))).alias("host"))
    fit = wide.withColumnRenamed("path", "p").join(ranked, "host").where(F.col("p").startswith(F.col("r.path")))
    return fit.groupBy(key).agg(F.max("r").alias("r")).select(
        key, F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def judge(urls: DataFrame, edges: DataFrame, rules: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for each row of ``urls`` (``page_id, url``).

    ``edges`` is ``(src, dst)``: a redirect or a canonical link from one url to
    another. Ends that are no page still pass decisions on. Null urls have empty
    host and path, no component and are allowed; rows are kept as they come, repeated
    page_ids too; other columns are not read. ``variants`` are edges ``(src, dst)`` that only the column
    ``variant_component`` follows, besides ``edges``; no verdict does.
    """
    urls = urls.select("page_id", F.col("url"))
    comp = stored(_components(edges), "url-components")
    # decisions are taken per distinct url, so a url on many pages is judged once
    nodes = urls.select("url").where("url is not null").unionByName(comp.select(F.col("node").alias("url"))).distinct()
    host, path = split_url(F.col("url"))
    nodes = nodes.join(comp.withColumnRenamed("node", "url"), "url", "left").select(
        "url", host.alias("host"), path.alias("path"), F.coalesce("component", "url").alias("component"))
    nodes = stored(nodes, "url-nodes")
    ruled = match_rules(nodes, rules, "url")
    bad = ruled.where("rule_verdict = 'block'").join(nodes.select("url", "component"), "url").select(
        "component", F.lit(True).alias("alias_blocked")).distinct()
    verdicts = nodes.join(ruled, "url", "left").join(bad, "component", "left").select(
        F.col("url"), "rule", "component",
        F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias(
            "verdict"))
    classes = ["component"]
    if variants is not None:
        wide = _components(edges.select("src", "dst").unionByName(variants.select("src", "dst")))
        verdicts = verdicts.join(wide.select(F.col("node").alias("url"), F.col("component").alias("variant_component")),
                                 "url", "left").withColumn("variant_component", F.coalesce("variant_component", "url"))
        classes.append("variant_component")
    known = urls.where("url is not null").join(verdicts, "url").select(
        "page_id", *[c.alias(n) for c, n in zip(split_url(F.col("url")), ("host", "path"))], "rule", "verdict",
        *classes)
    void = F.lit(None).cast("string")
    return known.unionByName(urls.where("url is null").select(
        "page_id", F.lit("").alias("host"), F.lit("").alias("path"), void.alias("rule"),
        F.lit("allow").alias("verdict"), *[void.alias(c) for c in classes]))


def _components(edges: DataFrame) -> DataFrame:
    edges = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    return connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "url-aliases")


def page_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` edges that crawled pages state.

    Of each page: the target of ``<link rel="canonical" href>``, the target of a
    ``<meta http-equiv="refresh">`` redirect, and the same address over https, without ``www.`` or
    ``m.`` and without the fragment, which no server sees. Path and query stay whole: what a page
    with another query or file name is, only that page can state. Only absolute targets (with
    ``://``) count.
    """
    html, url = F.col("html"), F.col("url")
    tag = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canon = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    fresh = F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    host, path = split_url(url)
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    plain = F.when(F.instr(url, "://") > 0, F.concat(
        F.lit("https://"), F.regexp_replace(host, r"^(www|m)\.", ""), path, F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)))
    return pages.where("url is not null").select(
        url.alias("src"), F.explode(F.array_distinct(F.array(canon, fresh, plain))).alias("dst")
    ).where(F.col("dst").contains("://") & (F.col("dst") != F.col("src"))).distinct()


def page_variants(pages: DataFrame) -> DataFrame:
    """``(src, dst)``: every url and the address that servers often send its variants to: https, no ``www.`` or
    ``m.``, no query, fragment, ``.html`` or closing slash. A guess from the address alone."""
    host, path = split_url(F.col("url"))
    return pages.where(F.instr("url", "://") > 0).select(F.col("url").alias("src"), F.concat(
        F.lit("https://"), F.regexp_replace(host, r"^(www|m)\.", ""),
        F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/+$", "")).alias("dst")).where("src <> dst").distinct()


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
