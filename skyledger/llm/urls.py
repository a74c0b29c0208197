"""URL filters: block and allow rules, carried over redirects and canonical links to aliases."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, rest = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + rest)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Of equally long ones, block wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def url_node(url: Column) -> Column:
    """What two spellings of one address share: fragment dropped, scheme dropped, host in lower case."""
    return F.when(F.contains(url, F.lit("://")), F.concat(url_host(url), F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)))


def _resolved(target: Column, url: Column) -> Column:
    """The address that a link of a page at url leads to: whole, from //, from the host's root, from ? or relative to the page's folder."""
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(url_path(url), r"^(.*/)?", 1)
    steps = F.split(F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("")).otherwise(folder), path), "/")
    # "." stays where it is, ".." takes the last step away, but not the root
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    ends = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.concat(F.lit("/"), F.array_join(walked, "/"), ends), "^/+", "/")
    own = F.concat(F.lit("http://"), url_host(url))
    return (
        F.when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(path == "", F.concat(own, url_path(url), rest))
        .otherwise(F.concat(own, whole, rest))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): address nodes joined by the canonical links and refresh redirects in a page's markup, all of them.

    Relative targets are read from the page's own address. Pages without an address, targets of other schemes
    than http (mailto: and the like) and those that lead to their own page give no edge.
    """
    body = F.col(f"`{html}`")

    def targets(tag: str, attribute: str, word: str) -> Column:
        tags = F.regexp_extract_all(body, F.lit(tag), F.lit(0))
        found = F.transform(tags, lambda t: F.regexp_extract(t, rf"(?i)\b{attribute}\s*=\s*[\"']?([^\"'>\s]+)", 1))
        return F.when(F.contains(F.lower(body), F.lit(word)), found)

    canonical = targets(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", "href", "canonical")
    refresh = targets(r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", "url", "refresh")
    none = F.array().cast("array<string>")
    found = pages.select(F.col(f"`{url}`").alias("url"), F.explode(F.concat(F.coalesce(canonical, none), F.coalesce(refresh, none))).alias("to")).where("to <> ''")
    to = _resolved(F.col("to"), F.col("url"))
    return found.select(url_node(F.col("url")).alias("u"), F.when(to.rlike("^(?i)https?://"), url_node(to)).alias("v")).where("u <> v")


def judge_urls(pages: DataFrame, scratch: Scratch, rules: Sequence[Rule], edges: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with _host, _path, _rule and _verdict.

    A page's own rule decides. Without one, its aliases do (addresses reached over edges, each judged by
    its own rule): allow if any is allowed, else block if any is blocked; without any, allow.
    The rules travel in the plan, as expressions: they are configuration, of a size that does not grow with the pages.
    A null address, or one without ://, has an empty host and path and no alias. No page is dropped, repeated ones neither; columns of
    pages keep their names and values, but those of the four names are replaced. An empty table gives none.
    """
    kept = [c for c in pages.columns if c not in ("_host", "_path", "_rule", "_verdict")]
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    judged = whole.withColumn("own", matched_rule(F.col("host"), F.col("path"), rules))
    shown = [*[F.col(f"page.`{c}`") for c in kept], F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("own.rule").alias("_rule")]
    verdict = F.col("own.verdict")
    edges = None if edges is None else scratch.cut(edges.select("u", "v").distinct())
    if edges is None or edges.isEmpty():
        return judged.select(*shown, F.coalesce(verdict, F.lit("allow")).alias("_verdict"))
    label = connected_components(edges, scratch)
    node_url = F.concat(F.lit("http://"), F.col("node"))
    said = label.select("component", matched_rule(url_host(node_url), url_path(node_url), rules)["verdict"].alias("said"))
    groups = said.groupBy("component").agg(F.min("said").alias("said"))  # allow sorts before block
    told = scratch.cut(label.join(groups.where("said is not null"), "component").select("node", "said"))
    # pages with a rule of their own, and those without an address, need no join
    alone = judged.where(verdict.isNotNull() | url_node(F.col(f"page.`{url}`")).isNull())
    asked = judged.where(verdict.isNull() & url_node(F.col(f"page.`{url}`")).isNotNull())
    joined = asked.join(told, url_node(F.col(f"page.`{url}`")) == F.col("node"), "left")
    decided = joined.select(*shown, F.coalesce(F.col("said"), F.lit("allow")).alias("_verdict"))
    return decided.unionByName(alone.select(*shown, F.coalesce(verdict, F.lit("allow")).alias("_verdict")))
