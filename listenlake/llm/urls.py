"""URL filters by a path-template tree (operator 6), with DataFrame functions only.

Rules come first; the longest that fits decides. Other urls are judged by a
tree of path templates per host:

1. Runs of digits become wildcards, and so do all children of a node that has
   more than ``max_children`` different ones. Levels are walked from the host
   down; a subtree of ``max_children`` paths or fewer can't have such a node
   and leaves the walk, so depth is not limited.
2. The labelled branches below a node are ordered by their smoothed share of
   bad labels. Neighbours in that order whose shares don't differ (two-sided
   test of two proportions) are merged and judged together.
3. The purity of a template is its share of good labels, drawn towards that of
   the labels around it: from the host down, each folder's labels outside the
   next one are added to ``prior`` labels of the purity found so far, so no
   label counts twice. A template is rejected under ``min_purity``. One
   without labels of its own must show more: the upper bound of the interval of
   purity (Wilson, ``z``) at its deepest folder with labels has to be under
   ``min_purity`` too. In it, the labels of one child weigh less the more they
   are, as they are alike: n count as n / (1 + (n - 1) * likeness). So a label
   alone never rejects another template, and a single folder does so only
   with 11 labels or more. A host without labels rejects nothing.

A null url, or one without ``://``, has an empty host and path; repeated rows
are judged alike; labels may be null; an empty table gives no rows. Input
columns named like the new ones stay, and the new ones get a longer name. Sums
are taken per host and path before any shuffle, and a path with many rows is
dealt to several tasks. Nodes are told apart by 128-bit digests of their paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import drop_since, fresh, join_spread, made, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TemplateRules:
    """``z``: standard errors by which the shares of merged neighbours may differ, and of the bound; ``prior``: labels that the surroundings count as; ``likeness``: correlation of the labels of one child."""

    max_children: int = 50
    z: float = 1.96
    min_purity: float = 0.35
    prior: float = 2.0
    likeness: float = 0.05


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of (host, path, verdict) rules that fits, as text, and its verdict; a list short enough for one expression."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def general(path: Column) -> Column:
    """A path without its first slash, runs of digits generalised."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*")


def templates(paths: DataFrame, max_children: int) -> DataFrame:
    """host, general, template of the distinct rows (host, general)."""
    rows = paths.select("host", "general", F.lit("").alias("done"), F.split("general", "/").alias("rest"))
    finished, mark = [], made()
    while True:
        child = rows.groupBy("host", "done", F.get("rest", F.lit(0)).alias("child")).agg(F.count("*").alias("n"))
        below = stored(child.groupBy("host", "done").agg(F.count("*").alias("children"), F.sum("n").alias("rows")), "nodes")
        known = join_spread(rows, below.withColumn("paths", F.col("rows")), ["host", "done"], "rows")
        step = F.when(F.col("children") > max_children, "*").otherwise(F.get("rest", F.lit(0)))
        few = F.col("paths") <= max_children
        done = F.concat_ws("/", "done", F.when(few, F.array_join("rest", "/")).otherwise(step))
        rest = F.when(few, F.array().cast("array<string>")).otherwise(F.slice("rest", 2, 1 << 30))
        walked = stored(known.select("host", "general", done.alias("done"), rest.alias("rest")), "walk")
        finished.append(walked.where("size(rest) = 0").select("host", "general", F.col("done").alias("template")))
        rows = walked.where("size(rest) > 0")
        if rows.isEmpty():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    out = stored(out, "templates")
    drop_since(out.sparkSession, mark, (out,))
    return out


def weighed(part: Column, n: Column, likeness: float) -> Column:
    """``part`` of the ``n`` labels of one child, by what they count for; in millionths, so that sums don't depend on their order."""
    return F.floor(part * 1000000.0 / (1.0 + (n - 1.0) * likeness))


def purity_of(path: Column, prior: float) -> Column:
    """Purity at the end of ``path``: (good, labels) of the nodes from the host down; null without any."""
    first = F.struct(F.get(path, F.lit(0))["good"].alias("good"), F.get(path, F.lit(0))["labels"].alias("labels"), F.lit(0.5).alias("around"))

    def down(a: Column, x: Column) -> Column:
        around = (a["good"] - x["good"] + prior * a["around"]) / (a["labels"] - x["labels"] + prior)
        return F.struct(x["good"].alias("good"), x["labels"].alias("labels"), around.alias("around"))

    return F.aggregate(F.slice(path, 2, 1 << 30), first, down, lambda a: (a["good"] + prior * a["around"]) / (a["labels"] + prior))


def upper_bound(good: Column, n: Column, z: float) -> Column:
    """Upper end of the Wilson interval of good / n."""
    share = good / n
    return (share + z * z / (2 * n) + z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def path_nodes(template: Column) -> Column:
    """Digests of the folders of a template, from the host down; the last one is its own."""

    def digests(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.concat(d.cast("string"), F.lit(":"), F.md5(F.array_join(F.slice(parts, F.lit(1), d), "/").cast("binary"))))

    # The template is split once, outside the function of each depth.
    return F.get(F.transform(F.array(F.split(F.substring(template, 2, 1 << 30), "/")), digests), F.lit(0))


def judged_templates(leaves: DataFrame, rules: TemplateRules) -> DataFrame:
    """host, template, purity and bound (the purity itself for templates with labels; both null without labels) of the rows host, template (a digest), nodes, bad, good."""
    # Exploded rows carry neither the template nor all its nodes: a path of d segments gives d small rows.
    above = F.concat(F.array(F.lit(None).cast("string")), F.slice("nodes", F.lit(1), F.size("nodes") - 1))
    walk = leaves.select("host", "template", "bad", "good", (F.size("nodes") - 1).alias("end"), "nodes", above.alias("above"))
    walk = walk.select("host", "template", "bad", "good", "end", F.posexplode(F.arrays_zip("nodes", "above")).alias("depth", "at"))
    walk = stored(walk.select("host", "template", "bad", "good", "end", "depth", F.col("at.nodes").alias("node"), F.col("at.above").alias("parent")), "branches")
    last = F.col("depth") == F.col("end")
    n, own = F.col("bad") + F.col("good"), F.col("own_bad") + F.col("own_good")
    nodes = walk.groupBy("host", "node").agg(F.first("parent").alias("parent"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum(F.when(last, F.col("bad")).otherwise(0)).alias("own_bad"), F.sum(F.when(last, F.col("good")).otherwise(0)).alias("own_good"), F.count("*").alias("rows")).where("bad + good > 0")
    nodes = stored(nodes, "labelled")
    below = nodes.groupBy("host", F.col("parent").alias("node")).agg(*(F.sum(weighed(x, n, rules.likeness)).alias(name) for x, name in ((n, "below"), (F.col("good"), "good_below"))))
    zero = F.lit(0).cast("bigint")
    alone = [F.when(own > 0, weighed(x, own, rules.likeness)).otherwise(zero) for x in (own, F.col("own_good"))]
    nodes = nodes.join(below, ["host", "node"], "left").withColumn("weight", F.coalesce("below", zero) + alone[0]).withColumn("good_weight", F.coalesce("good_below", zero) + alone[1])
    # A node has max_children children at most, so the windows are small.
    order = Window.partitionBy("host", "parent").orderBy("share", "node")
    nodes = nodes.withColumn("share", (F.col("bad") + 1.0) / (n + 2.0)).withColumn("bad_before", F.lag("bad").over(order)).withColumn("n_before", F.lag(n).over(order))
    both = (F.col("bad") + F.col("bad_before") + 1.0) / (n + F.col("n_before") + 2.0)
    differ = F.abs(F.col("bad") / n - F.col("bad_before") / F.col("n_before")) > rules.z * F.sqrt(both * (1 - both) * (F.lit(1.0) / n + F.lit(1.0) / F.col("n_before")))
    merged = nodes.withColumn("branch", F.sum(F.coalesce(differ.cast("int"), F.lit(0))).over(order))
    pool = Window.partitionBy("host", "parent", "branch")
    bound = upper_bound(F.sum("good_weight").over(pool) / 1000000.0, F.sum("weight").over(pool) / 1000000.0, rules.z)
    pure = stored(merged.select("host", "node", "rows", F.sum("good").over(pool).cast("double").alias("pool_good"), F.sum(n).over(pool).cast("double").alias("labels"), bound.alias("bound")), "purity")
    met = join_spread(walk.select("host", "template", "bad", "good", "depth", "node"), pure, ["host", "node"], "rows")
    step = F.when(F.col("labels").isNotNull(), F.struct("depth", F.col("pool_good").alias("good"), "labels", "bound"))
    paths = met.groupBy("host", "template").agg(F.max(n).alias("own"), F.array_sort(F.collect_list(step)).alias("path"))
    found = paths.select("host", "template", "own", purity_of(F.col("path"), rules.prior).alias("purity"), F.get("path", F.size("path") - 1)["bound"].alias("bound"))
    return found.select("host", "template", "purity", F.when(F.col("own") > 0, F.col("purity")).otherwise(F.col("bound")).alias("bound"))


def template_verdicts(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """host, general, rows, template, purity, bound and verdict of every path, from rows of host, general and bad (true, false or null)."""
    seen = stored(pages.groupBy("host", "general").agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")), "paths")
    found = templates(seen, rules.max_children)
    named = stored(seen.join(found, ["host", "general"]).withColumn("leaf", F.md5(F.col("template").cast("binary"))), "named")
    leaves = named.groupBy("host", "leaf").agg(F.first("template").alias("text"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    judged = judged_templates(leaves.select("host", F.col("leaf").alias("template"), path_nodes(F.col("text")).alias("nodes"), "bad", "good"), rules).withColumnRenamed("template", "leaf")
    verdict = F.when((F.col("purity") < rules.min_purity) & (F.col("bound") < rules.min_purity), "block").otherwise("allow")
    return stored(named.select("host", "general", "rows", "template", "leaf").join(judged, ["host", "leaf"]).drop("leaf").withColumn("verdict", verdict), "verdicts")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", labels: Column | None = None, template_rules: TemplateRules = TemplateRules()) -> DataFrame:
    """``pages`` with url_host, url_path, url_rule, url_template and url_verdict. ``labels``: true for bad; by default the verdicts of the rules serve as labels."""
    names = [fresh(pages, x) for x in ("url_host", "url_path", "url_rule", "url_template", "url_verdict")]
    work = [fresh(pages, x) for x in ("url_ruled", "host", "general", "bad")]
    host, path, rule, template, verdict = names
    ruled, tree_host, tree_path, bad = work
    found_host, found_path = host_and_path(F.col(url))
    known = pages.withColumn(host, found_host).withColumn(path, found_path)
    found_rule, found_verdict = by_rules(F.col(host), F.col(path), rules)
    known = known.withColumn(rule, found_rule).withColumn(ruled, found_verdict).withColumn(tree_host, F.col(host)).withColumn(tree_path, general(F.col(path)))
    known = known.withColumn(bad, labels if labels is not None else F.col(ruled) == "block")
    tree = template_verdicts(known.select(F.col(tree_host).alias("host"), F.col(tree_path).alias("general"), F.col(bad).alias("bad")), template_rules)
    judged, rows = fresh(known, "judged"), fresh(known, "tree_rows")
    tree = tree.select(F.col("host").alias(tree_host), F.col("general").alias(tree_path), F.col("rows").alias(rows), F.col("template").alias(template), F.col("verdict").alias(judged))
    joined = join_spread(known.drop(bad), tree, [tree_host, tree_path], rows)
    return joined.withColumn(verdict, F.coalesce(ruled, judged, F.lit("allow"))).select(*pages.columns, *names)
