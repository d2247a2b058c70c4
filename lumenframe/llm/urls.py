"""URL filters by a tree of path templates for each host.

Urls are cut into host and path segments.  Per host the segments form a tree, built level by level from
counts.  At a node with more than FAN distinct children, children with under MIN_SHARE of the node's urls
are one wildcard; at one with more than FEW children, where at least half of the urls have a child of
their own, so are those children.  The branches that are left are merged while their shares of bad labels
don't differ by more than Z standard errors.  Segments that all urls of a node share are passed at once, so
the levels are those of the tree's branchings, and the tree goes on until no node has two urls that differ.
A template is rejected if its labelled purity, smoothed towards the global share, reaches REJECT with at
least MIN_LABELS labels.

Explicit rules come first: a rule `host/path` fits its host and all subdomains where the path
starts with `/path`; the longest fitting rule decides, of equally long ones the last in order.

Null urls and urls without `://` have an empty host and path, and are judged like any other.  Empty
segments are left out of templates.  Long urls are used whole.  Of branches that are equally close the
cleaner ones are merged first, then those first in order.  Repeated rows count each, and are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import cut

FAN, MIN_SHARE, FEW = 32, 0.02, 8
Z = 1.64
PRIOR_WEIGHT, MIN_LABELS, REJECT = 4.0, 5, 0.5
SALTS = 16
WILD, END = "*", ""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null; equal lengths in order of the text."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, tail = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        found = F.when(fits & path.startswith(slash + tail), F.lit(rule)).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The segments of a path; the signs that templates use for themselves are escaped."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.replace(F.replace(s, F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C")))


def merge_branches(branches: list[tuple[str, int, int]]) -> dict[str, str]:
    """Merges (segment, bad, labelled) branches of one node; a merged branch is named by its segments.

    In order of their share of bad labels, neighbours are merged while they differ by at most Z
    standard errors; the closest pair goes first.  Branches without labels stay as they are.
    """
    groups = sorted(([[s], b, n] for s, b, n in branches if n), key=lambda g: (g[1] / g[2], g[0]))

    def apart(x: list, y: list) -> float:
        p = (x[1] + y[1] + 1) / (x[2] + y[2] + 2)
        return abs(x[1] / x[2] - y[1] / y[2]) / math.sqrt(p * (1 - p) * (1 / x[2] + 1 / y[2]))

    while len(groups) > 1:
        k = min(range(len(groups) - 1), key=lambda i: (apart(groups[i], groups[i + 1]), i))
        if apart(groups[k], groups[k + 1]) > Z:
            break
        x, y = groups[k], groups.pop(k + 1)
        groups[k] = [x[0] + y[0], x[1] + y[1], x[2] + y[2]]
    return {s: "|".join(sorted(g[0])) for g in groups for s in g[0]}


def _name_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for host, tmpl, kids in zip(*(batch.column(c).to_pylist() for c in ("host", "tmpl", "kids")), strict=True):
            named = merge_branches([(k["seg"], k["bad"], k["labelled"]) for k in kids if k["seg"] != END])
            for k in kids:
                for column, value in zip(out, (host, tmpl, k["seg"], named.get(k["seg"], k["seg"])), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["host", "tmpl", "seg", "name"])


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def shared_start(lo: Column, hi: Column) -> Column:
    """The segments that the first and the last of some lists in order, and so all of them, begin with."""
    differ = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), False).cast("int")
    return F.slice(lo, F.lit(1), F.when(differ > 0, differ - 1).otherwise(F.size(lo)))


def templates(urls: DataFrame) -> DataFrame:
    """(host, segs, tmpl, bad, labelled) for every distinct host and list of segments.

    urls has host, segs, and bad: 1, 0 or null where there is no label.  tmpl is the list of the template's
    segments.  A url that ends at a branching has END as its last segment there.
    """
    nothing = F.array().cast("array<string>")
    shapes = urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), F.count("bad").alias("labelled"))
    shapes = cut(shapes.withColumn("tmpl", nothing).withColumn("rest", F.col("segs")).withColumn("salt", F.pmod(F.hash("segs"), F.lit(SALTS))))
    columns = ["host", "segs", "n", "bad", "labelled"]
    done = None
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "labelled")]
    while True:
        ends = [F.min("rest").alias("lo"), F.max("rest").alias("hi")]
        nodes = shapes.groupBy("host", "tmpl", "salt").agg(*ends).groupBy("host", "tmpl").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nodes = _salted(nodes.select("host", "tmpl", shared_start(F.col("lo"), F.col("hi")).alias("start"), (F.col("lo") == F.col("hi")).alias("alike")))
        passed = shapes.join(nodes, ["host", "tmpl", "salt"]).withColumn("tmpl", F.concat("tmpl", "start")).withColumn("rest", F.slice("rest", F.size("start") + 1, F.size("rest")))
        passed = cut(passed.drop("start"), shapes)
        finished = passed.filter("alike").select(*columns, "tmpl")
        shapes = passed.filter("not alike").drop("alike").withColumn("seg", F.coalesce(F.get("rest", F.lit(0)), F.lit(END)))
        kids = shapes.groupBy("host", "tmpl", "seg", "salt").agg(*sums).groupBy("host", "tmpl", "seg").agg(*sums)
        wide = kids.groupBy("host", "tmpl").agg(F.count("*").alias("fan"), F.sum("n").alias("all"), F.count_if((F.col("n") == 1) & (F.col("seg") != END)).alias("single")).filter(F.col("fan") > FEW)
        rare = ((F.col("fan") > FAN) & (F.col("n") < MIN_SHARE * F.col("all"))) | ((F.col("n") == 1) & (2 * F.col("single") >= F.col("all")))
        kept = kids.withColumn("salt", F.pmod(F.hash("seg"), F.lit(SALTS))).join(_salted(wide), ["host", "tmpl", "salt"], "left").filter(~(F.coalesce(rare, F.lit(False)) & (F.col("seg") != END)))
        # What is left of a node has at most FAN + 1 / MIN_SHARE branches.
        branches = kept.groupBy("host", "tmpl").agg(F.collect_list(F.struct("seg", "bad", "labelled")).alias("kids"))
        names = _salted(branches.mapInArrow(_name_branches, "host string, tmpl array<string>, seg string, name string"))
        shapes = shapes.join(names, ["host", "tmpl", "seg", "salt"], "left").withColumn("tmpl", F.concat("tmpl", F.array(F.when(F.col("seg") == END, F.col("seg")).otherwise(F.coalesce("name", F.lit(WILD))))))
        shapes = shapes.withColumn("rest", F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1)))).drop("name")
        shapes = cut(shapes)
        finished = finished.unionByName(shapes.filter(F.col("seg") == END).select(*columns, "tmpl"))
        done = finished if done is None else done.unionByName(finished)
        shapes = shapes.filter(F.col("seg") != END).drop("seg")
        if shapes.isEmpty():
            return done.withColumn("tmpl", F.concat_ws("", F.transform("tmpl", lambda s: F.concat(F.lit("/"), s))))


def rejected(shapes: DataFrame) -> DataFrame:
    """(host, tmpl, purity, n) of templates whose smoothed share of bad labels is REJECT or more."""
    prior = shapes.agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("prior"))
    by = shapes.groupBy("host", "tmpl", F.pmod(F.hash("segs"), F.lit(SALTS)).alias("salt")).agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")])
    by = by.groupBy("host", "tmpl").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")])
    purity = (F.col("bad") + PRIOR_WEIGHT * F.lit(prior.first()["prior"] or 0.0)) / (F.col("labelled") + PRIOR_WEIGHT)
    return by.withColumn("purity", purity).filter((F.col("labelled") >= MIN_LABELS) & (F.col("purity") >= REJECT)).select("host", "tmpl", "purity", "n")


def judge(urls: DataFrame, rules: dict[str, str], url: str = "url", bad: str = "bad") -> DataFrame:
    """Adds host, path, rule, template, purity and verdict (allow or block) to every row.

    bad is 1 or 0 for labelled urls, else null.  Columns that have those names are replaced.
    """
    host, path = host_and_path(F.col(url))
    mine = ("host", "path", "rule", "template", "purity", "verdict", "segs")
    base = urls.drop(*[c for c in urls.columns if c.lower() in mine]).withColumn("host", host).withColumn("path", path)
    base = base.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    shapes = cut(templates(base.select("host", "segs", F.col(bad).cast("long").alias("bad"))))
    # One row for each shape; both salts below spread the shapes of one host.
    refused = _salted(rejected(shapes))
    known = shapes.withColumn("salt", F.pmod(F.hash("segs"), F.lit(SALTS))).join(refused.drop("n"), ["host", "tmpl", "salt"], "left").select("host", "segs", F.col("tmpl").alias("template"), "purity")
    said = F.create_map(*[F.lit(x) for rule in rules.items() for x in rule]) if rules else F.create_map().cast("map<string,string>")
    verdict = F.coalesce(F.element_at(said, F.col("rule")), F.when(F.col("purity").isNotNull(), "block").otherwise("allow"))
    return base.join(known, ["host", "segs"], "left").withColumn("verdict", verdict).drop("segs")
