"""URL filters: per-host path-template trees, templates rejected by smoothed labelled purity.

1. A url is cut into host and path.  Listed rules (domain, path prefix, verdict) come first: a
   rule fits its domain and all subdomains, the longest rule wins.
2. The path's segments are generalised by shape (numbers, hex strings, file extensions kept),
   and urls are counted per (host, shape): from here on work is on shapes, not pages.
3. The tree of each host is walked level by level; only levels are walked at which some host has
   several branches that may be renamed (``branching_levels``).  Rare children of a parent with many become
   the wildcard ``*`` if they have fewer than ``MIN_LABELS`` labels.  Children with more, rare or
   not, are put in order of their share of bad labels; neighbours whose shares do not differ
   significantly (a two-proportion test) merge into one branch, named ``a|b`` (``a|+n`` if more
   than ``MAX_CHILDREN``).  Other children with too few labels stay apart.
4. A template's purity is (bad + 1) / (labelled + 2).  At ``reject`` or more its pages are
   blocked.  Templates without labels stand at one half and are allowed.

Labels are urls with a known verdict; by default those that a listed rule decides.

Built from DataFrame functions alone.  A template that holds a large share of all pages is
joined by a bounded broadcast, all others by shuffle.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed unless labels say otherwise.  Repeated rows count and are judged each.  An empty table
gives no rows.  Only the id and url columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, join_on_hot_key, materialise

#: (domain, path prefix, verdict) of the registered query's contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"))
MAX_CHILDREN, RARE_CHILD = 30, 0.05
SIMILAR_Z, MIN_LABELS = 1.96, 5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):      # the longest is tested first
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name, verdict = F.when(fits, domain + prefix).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def path_shape(path: Column) -> Column:
    """The path's segments with variable ones replaced by their shape.  The marks of merged names are
    written as in a url's escapes, so no segment looks like one."""
    def shape(s):
        s = F.regexp_replace(F.regexp_replace(s, r"\|", "%7C"), r"\*", "%2A")
        return F.regexp_replace(F.regexp_replace(s, r"^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]{15,}", "{x}"), r"\d+", "{n}")
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), shape)


def shape_key(host: Column, segments: Column) -> Column:
    return F.concat_ws("/", host, F.array_join(segments, "/"))


def merge_level(shapes: DataFrame, depth: int) -> DataFrame:
    """``shapes`` (shape, host, segs, n, bad, labelled) with the segment at ``depth`` of each
    host's tree generalised."""
    at = shapes.where(F.size("segs") > depth).withColumns(
        {"parent": F.concat_ws("/", "host", F.array_join(F.slice("segs", 1, depth), "/")), "child": F.get("segs", F.lit(depth))})
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "labelled")]
    children = at.groupBy("parent", "child").agg(*sums)
    parents = children.groupBy("parent").agg(F.count(F.lit(1)).alias("fan"), F.sum("n").alias("p_n"))
    sized = materialise(children.join(parents, "parent").withColumn(
        "rare", (F.col("fan") > MAX_CHILDREN) & (F.col("n") < RARE_CHILD * F.col("p_n"))), "children")
    labelled = sized.where(F.col("labelled") >= MIN_LABELS).withColumn("share", F.col("bad") / F.col("labelled"))
    # equal shares never differ: one row each, with the counts of its first and last child
    counts = F.struct("bad", "labelled")
    steps = labelled.groupBy("parent", "share").agg(F.min_by(counts, "child").alias("c"), F.max_by(counts, "child").alias("last"))
    by_share = Window.partitionBy("parent").orderBy("share")
    steps = steps.withColumn("b", F.lag("last").over(by_share))
    pooled = (F.col("c.bad") + F.col("b.bad")) / (F.col("c.labelled") + F.col("b.labelled"))
    spread = pooled * (1 - pooled) * (1 / F.col("c.labelled") + 1 / F.col("b.labelled"))
    apart = F.col("share") - F.col("b.bad") / F.col("b.labelled")
    branches = (steps.withColumn("starts", F.coalesce(apart * apart > SIMILAR_Z * SIMILAR_Z * spread, F.lit(True)).cast("int"))
                .select("parent", "share", F.sum("starts").over(by_share).alias("branch")))
    members = materialise(labelled.join(branches, ["parent", "share"]).select("parent", "child", "branch"), "branches")
    sizes = members.groupBy("parent", "branch").agg(F.count(F.lit(1)).alias("size"), F.min("child").alias("least"))
    many = F.col("size") > MAX_CHILDREN
    names = (members.join(sizes.where(~many), ["parent", "branch"]).groupBy("parent", "branch")
             .agg(F.array_join(F.array_sort(F.collect_list("child")), "|").alias("name"))
             .union(sizes.where(many).select("parent", "branch", F.concat("least", F.lit("|+"), (F.col("size") - 1).cast("string")))))
    merged = (members.join(names, ["parent", "branch"]).select("parent", "child", "name").where("child <> name")
              .union(sized.where(F.col("rare") & (F.col("labelled") < MIN_LABELS)).select("parent", "child", F.lit("*"))))
    segs = F.when(F.col("name").isNotNull(), F.transform(
        "segs", lambda s, i: F.when(i == depth, F.col("name")).otherwise(s)))
    return (at.join(merged, ["parent", "child"], "left")
            .select("shape", "host", F.coalesce(segs, "segs").alias("segs"), "n", "bad", "labelled")
            .union(shapes.where(F.size("segs") <= depth).select("shape", "host", "segs", "n", "bad", "labelled")))


def branching_levels(shapes: DataFrame) -> list[int]:
    """The depths at which a host may have a parent whose children are renamed: more than
    ``MAX_CHILDREN`` segments, or two that share enough labels.  Parents of one host merge, never those
    of two, so the segments of a host's whole level bound what any parent has.  The list is as long as
    the deepest level that branches, not as the longest url."""
    segments = shapes.select("host", "labelled", F.posexplode("segs").alias("depth", "child"))
    children = segments.groupBy("host", "depth", "child").agg(F.sum("labelled").alias("labelled"))
    levels = children.groupBy("host", "depth").agg(
        F.count(F.lit(1)).alias("fan"), F.count_if(F.col("labelled") >= MIN_LABELS).alias("known"))
    some = levels.where((F.col("fan") > MAX_CHILDREN) | (F.col("known") > 1)).select("depth").distinct()
    return sorted(r.depth for r in some.collect())


def template_verdicts(urls: DataFrame, reject: float = 0.9) -> DataFrame:
    """(shape, n, template, purity, verdict) of every (host, path shape) of ``urls``.

    ``urls`` has host, path and label: "block", "allow" or null (unknown)."""
    segs = path_shape(F.col("path"))
    shapes = materialise(urls.select("host", segs.alias("segs"), "label").groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == "block").cast("long")).alias("bad"),
        F.count("label").alias("labelled")).select(
        shape_key(F.col("host"), F.col("segs")).alias("shape"), "host", "segs", "n",
        F.coalesce("bad", F.lit(0).cast("long")).alias("bad"), "labelled"), "shapes")
    for depth in branching_levels(shapes):
        shapes = materialise(merge_level(shapes, depth), "shapes")
    template = shape_key(F.col("host"), F.col("segs"))
    by_template = shapes.groupBy(template.alias("template")).agg(
        ((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("purity"))
    return (shapes.select("shape", "n", template.alias("template")).join(by_template, "template")
            .select("shape", "n", "template", "purity",
                    F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("method")))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
               reject: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row."""
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"),
                         url_path(F.col(url_col)).alias("path"))
    rule, says = listed_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "label": says})
    lookup = materialise(template_verdicts(ruled.select("host", "path", "label"), reject), "templates")
    total = lookup.agg(F.sum("n")).first()[0] or 0
    rows = ruled.withColumn("shape", shape_key(F.col("host"), path_shape(F.col("path"))))
    return join_on_hot_key(rows, lookup, "shape", "n", total).select(
        "page_id", "host", "path", "rule", F.coalesce("label", "method").alias("verdict"), "template", "purity")
