"""Block and allow decisions on URLs, carried along redirects and canonical links.

A URL's own decision comes from the longest rule that fits it. Pages name
other URLs as the same resource by a canonical link or a redirect in their
html; connected components over these links are classes of aliases. A URL
without a rule of its own takes the decision of its class: allow if any of its
aliases has an allowing rule, else block if any has a blocking one, else allow.
A rule of its own always decides. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolmark.llm.components import connected_components
from spoolmark.llm.tables import Workspace

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
_GOES = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(
        F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), _CAPITALS, _CAPITALS.lower()
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of (verdict, host, path) as (verdict, rule), or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    by_length = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow"))
    for verdict, name, start in by_length:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        made = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        found = F.when(fits, made).otherwise(found)
    return found


def _target(url: Column, found: Column) -> Column:
    """An extracted address as a whole URL, relative to ``url``; null if there is none."""
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    return (
        F.when(F.coalesce(found, F.lit("")) == "", None)
        .when(F.instr(found, "://") > 0, found)
        .when(found.startswith("//"), F.concat(F.lit("http:"), found))
        .when(found.startswith("/"), F.concat(F.lit("http://"), host_of(url), found))
        .otherwise(
            F.concat(
                F.lit("http://"), host_of(url), F.when(folder == "", "/").otherwise(folder), found
            )
        )
    )


def _node(url: Column) -> Column:
    """Names a URL whatever its scheme and fragment."""
    tail = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.sha2(F.concat(host_of(url), tail), 256))


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and redirect of ``pages`` (url, html)."""
    html, url = F.col("html"), F.col("url")
    low = F.lower(html)
    canonical = F.when(
        low.contains("canonical"), F.regexp_extract(F.regexp_extract(html, _LINK, 0), _HREF, 1)
    )
    redirect = F.when(
        low.contains("http-equiv"), F.regexp_extract(F.regexp_extract(html, _META, 0), _GOES, 1)
    )
    targets = F.array(_target(url, canonical), _target(url, redirect))
    links = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", targets.alias("t"))
    return links.select("url", F.explode(F.array_compact("t")).alias("target"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url, html).

    ``rules`` is a short list of (allow or block, host, path). A null url or one
    without ``://`` has an empty host and path and no rule; a null html has no
    links; repeated rows are judged alike; an empty table gives no rows;
    further columns are ignored.
    """
    work = Workspace(pages.sparkSession, "url-filter")
    url = F.col("url").cast("string")
    host, path = host_of(F.coalesce(url, F.lit(""))), path_of(F.coalesce(url, F.lit("")))
    judged = pages.select(F.col("page_id").cast("bigint"), url.alias("url"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if "html" in pages.columns:
        found = alias_links(pages.select(url.alias("url"), F.col("html").cast("string")))
    else:
        found = pages.sparkSession.createDataFrame([], "url STRING, target STRING")
    found = work.keep(found.distinct(), "aliases")
    ends = found.select("url").union(found.select("target")).toDF("url").distinct()
    ends = ends.select(
        _node(F.col("url")).alias("node"),
        rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict"),
    )
    links = found.select(_node(F.col("url")).alias("a"), _node(F.col("target")).alias("b"))
    members = work.keep(connected_components(links, work), "members")
    classes = (
        ends.join(members, "node")
        .groupBy("component")
        .agg(F.min("verdict").alias("inherited"))  # allow comes before block
    )
    by_node = members.join(classes, "component").select("node", "inherited")
    return (
        judged.withColumn("node", _node(F.col("url")))
        .join(by_node, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("own.rule").alias("rule"),
            F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"),
        )
    )
