"""URL filter by path-template trees.

Per host, the distinct urls are walked down segment by segment. A segment becomes a wildcard if it looks generated
(it has a digit or is very long), or if its node has many children for its urls. The urls that curated rules decide
are the labelled ones: each template counts how many of its urls are good. Sibling branches whose share of good urls
is statistically the same as their parent's pool are merged. A template passes if its purity, smoothed towards the
same template on all hosts and that towards all labelled urls, reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import attach_groups, stage

#: (verdict, rule): host and path prefix of a rule in one string, as the contract names them.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A node is variable with so many different children, if they are at least that part of its urls.
CHILDREN, SPREAD = 12, 0.2
#: Segments of this length look generated.
LONG = 24
#: Rows that the wider level counts for, the z score up to which branches are similar, the purity that passes.
WEIGHT, SIMILAR, PURE = 4.0, 1.96, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equal length, the longer host wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1]))
    rule = verdict = F.lit(None).cast("string")
    for decision, text in reversed(ordered):
        own, prefix = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _generated(segment: Column) -> Column:
    return segment.rlike("[0-9]") | (F.length(segment) >= LONG)


def _step(at: Column, segment: Column, made: Column) -> Column:
    """(template, parent, literal) one segment further: the parent takes over the template so far with this literal
    replaced, or extends itself."""
    longer = F.concat(at["template"], F.lit("/"), F.when(made, F.lit("*")).otherwise(segment))
    parent = F.when(made, F.concat(at["parent"], F.lit("/*"))).otherwise(F.concat(at["template"], F.lit("/*")))
    return F.struct(longer.alias("template"), parent.alias("parent"), (at["literal"] | ~made).alias("literal"))


def templates(urls: DataFrame, children: int = CHILDREN, spread: float = SPREAD) -> DataFrame:
    """Distinct (host, path, ...) rows -> the same with ``template`` and ``parent``.

    The parent has a wildcard in place of the last literal segment. Level by level down to the last segment, so that
    each node is judged by its generalised prefix; a level is one aggregation and one join, and ends up in a staged
    table. A node with fewer urls than ``children`` can have no variable node below it, so its urls are read to their
    end at once, and only the others go on.
    """
    start = F.struct(F.lit("").alias("template"), F.lit("").alias("parent"), F.lit(False).alias("literal"))
    current = urls.withColumns({"segments": F.split(F.regexp_replace("path", "^/", ""), "/", -1), "at": start})
    done, level = [], 0
    while True:
        segment = F.try_element_at("segments", F.lit(level + 1))
        here = current.withColumn("segment", segment).withColumn("node", F.col("at.template"))
        kids = here.where("segment IS NOT NULL").groupBy("host", "node", "segment").agg(F.count("*").alias("urls"))
        nodes = kids.groupBy("host", "node").agg(F.count("*").alias("kids"), F.sum("urls").alias("urls"))
        wide = ((F.col("kids") >= children) & (F.col("kids") >= spread * F.col("urls"))).alias("wide")
        nodes = nodes.where(F.col("urls") >= children).select(F.col("host").alias("_host"), F.col("node").alias("_node"), wide)
        here = here.join(nodes, (F.col("host") == F.col("_host")) & (F.col("node") == F.col("_node")), "left")
        rest = F.aggregate(F.slice("segments", level + 1, F.size("segments")), F.col("at"), lambda at, x: _step(at, x, _generated(x)))
        further = _step(F.col("at"), F.col("segment"), _generated(F.col("segment")) | F.col("wide"))
        last = F.col("wide").isNull() | (F.size("segments") <= level + 1)
        here = here.withColumn("at", F.when(F.col("segment").isNull(), F.col("at")).when(F.col("wide").isNull(), rest).otherwise(further)).withColumn("last", last)
        here = stage(here.drop("segment", "node", "_host", "_node", "wide"), "url-level")
        done.append(here.where("last"))
        current = here.where("not last").drop("last")
        level += 1
        if current.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done).withColumns({"template": F.col("at.template"), "parent": F.when(F.col("at.literal"), F.col("at.parent")).otherwise(F.col("at.template"))})
    return found.drop("segments", "at", "last")


def purities(found: DataFrame, weight: float = WEIGHT, similar: float = SIMILAR) -> DataFrame:
    """(host, template, parent, labelled, good) rows -> (host, template, merged, purity): one row per template.

    Sums are of whole urls, so that the order of additions cannot change a result.
    """
    own = found.groupBy("host", "template", "parent").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    own = stage(own, "url-templates")
    pool = own.groupBy("host", "parent").agg(F.sum("labelled").alias("pool_labelled"), F.sum("good").alias("pool_good"))
    rate = F.try_divide("pool_good", "pool_labelled")
    off = F.abs(F.col("good") - F.col("labelled") * rate)
    alike = (F.col("labelled") == 0) | (off <= similar * F.sqrt(F.col("labelled") * rate * (1 - rate)))
    own = own.join(pool, ["host", "parent"]).withColumn("merged", F.when(alike, F.col("parent")).otherwise(F.col("template")))
    branch = own.groupBy("host", "merged").agg(F.sum("labelled").alias("branch_labelled"), F.sum("good").alias("branch_good"))
    wide = own.groupBy("template").agg(F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
    total = own.agg(F.sum("labelled"), F.sum("good")).first()
    base = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    # A common template such as /en/* stands on very many hosts; this small table is broadcast by its size, else split.
    out = own.join(branch, ["host", "merged"]).join(wide, "template")
    prior = (F.col("all_good") + weight * base) / (F.col("all_labelled") + weight)
    return out.select("host", "template", "merged", ((F.col("branch_good") + weight * prior) / (F.col("branch_labelled") + weight)).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, pure: float = PURE, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    A rule's verdict stands; else the template's purity decides (allow from ``pure`` on). Null urls and urls without
    :// have an empty host and path and the template of those. Of rules of one length the one with the longer host wins;
    a purity at the bar allows. Without labelled urls all purities are 0.5. Urls of any length and depth are read
    whole. Repeated rows each give a row; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = stage(rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("key")), "url-rows")
    urls = rows.groupBy("host", "path", "key", "ruled").agg(F.count("*").alias("copies"))
    urls = stage(urls.select("*", F.col("ruled").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("ruled") == "allow", F.lit(False)).cast("int").alias("good")), "url-distinct")
    found = templates(urls, **options)
    scored = found.join(purities(found), ["host", "template"]).select("key", "copies", "merged", "purity")
    out = attach_groups(rows, stage(scored, "url-scored"), "key", "copies", rows.count())
    decided = F.coalesce("ruled", F.when(F.col("purity") >= pure, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", decided.alias("verdict"), F.col("merged").alias("template"), "purity")
