"""URL filters: rules, and for what no rule judges a tree of path templates.

The urls that a rule judges are the labelled ones. Per host, a path is a way down a tree: a segment that is a number, a hash, a date or a long mixed token is
its kind of wildcard at once; where a branch has many different children that few urls share, they become one wildcard; children whose
labelled shares do not differ from those of their siblings by Z standard errors are merged. What remains are templates; each has a purity, its
share of blocked urls smoothed by ALPHA urls towards its parent's, and that towards its own parent's, up to the host and PRIOR; it is rejected at REJECT or more. So a branch without
labelled urls is judged by the nearest node above it that has some.

A url that is null or has no ``://`` has an empty host and path; repeated rows are counted and judged as often as they stand.
Of a path's segments the first LEVELS have nodes of their own, the rest are one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import scratch, stored

LEVELS, MANY, SHARED, Z, ALPHA, PRIOR, REJECT = 4, 24, 8, 1.96, 4.0, 0.5, 0.8
RESULT = ("host", "path", "rule", "verdict", "template", "purity")
#: (verdict, host, start of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Kinds of variable segments, the first that fits; the ending of a file name stays.
KINDS = (
    ("<number>", r"^[0-9]+$"),
    ("<date>", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("<uuid>", r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
    ("<hash>", r"^[0-9a-fA-F]{16,}$"),
    ("<mixed>", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_=-]{12,}$"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    has = F.coalesce(at > 0, F.lit(False))
    lower = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def shape(segment: Column) -> Column:
    stem, end = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 2)
    kind = F.when(F.lit(False), "")
    for name, form in KINDS:
        kind = kind.when(stem.rlike(form), F.concat(F.lit(name), end))
    return kind.otherwise(segment)


def segments(path: Column, levels: int = LEVELS) -> Column:
    """Shapes of the non-empty segments; what comes after levels of them is joined to one."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), shape)
    return F.when(F.size(parts) <= levels, parts).otherwise(F.concat(F.slice(parts, 1, levels), F.array(F.array_join(F.slice(parts, levels + 1, 1 << 30), "/"))))


def templates(shapes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """shapes (host, shape array, n, blocked, allowed) with the column template: '/'-joined path of merged nodes."""
    tree = stored(shapes.withColumn("template", F.lit("")), "templates")
    for level in range(levels + 1):
        segment = F.get("shape", F.lit(level))
        here = tree.where(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed")))
        total = here.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("blocked").alias("all_b"), F.sum(F.col("blocked") + F.col("allowed")).alias("all_l"))
        seen = F.col("blocked") + F.col("allowed")
        share = F.col("all_b") / F.col("all_l")
        rest_l, rest_b = F.col("all_l") - seen, F.col("all_b") - F.col("blocked")
        error = F.sqrt(share * (1 - share) * (1 / seen + 1 / rest_l))
        alike = (seen > 0) & (rest_l > 0) & (F.abs(F.col("blocked") / seen - rest_b / rest_l) <= Z * error)
        node = F.when((F.col("children") >= MANY) & (F.col("all_n") < SHARED * F.col("children")), F.lit("*")).when(alike, F.lit("{alike}")).otherwise(F.col("segment"))
        nodes = here.join(total, ["host", "template"]).select("host", "template", "segment", F.concat("template", F.lit("/"), node).alias("deeper"))
        tree = stored(tree.withColumn("segment", segment).join(nodes, ["host", "template", "segment"], "left").withColumn("template", F.coalesce("deeper", "template")).drop("segment", "deeper"), "templates")
    return tree


def purities(tree: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, template, purity): the blocked share of a template's labelled urls, smoothed towards that of the node above it by ALPHA urls, and so on up to the host, whose own is smoothed towards
    PRIOR. A template without labelled urls has its parent's purity."""
    each = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l"))
    parts = F.split("template", "/", levels + 2)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    ways = each.select("host", "template", "b", "l", F.posexplode(above).alias("level", "node"))
    nodes = ways.groupBy("host", "level", "node").agg(F.sum("b").alias("node_b"), F.sum("l").alias("node_l"))
    way = ways.join(nodes, ["host", "level", "node"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "node_b", "node_l"))).alias("way"))
    down = F.aggregate("way", F.lit(float(PRIOR)), lambda p, x: (x["node_b"] + ALPHA * p) / (x["node_l"] + ALPHA))
    return way.select("host", "template", down.alias("purity"))


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of keep (but for those that have a result's name), host, path, rule (null if none fits), verdict (allow or block), template and purity double (of the url's template; null for
    urls that a rule judges)."""
    keep = tuple(c for c in keep if c not in RESULT)
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = pages.select(host.alias("host"), path.alias("path"), *(F.col(f"`{c}`") for c in keep))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("template", segments(F.col("path")))
    shapes = rows.groupBy("host", F.col("template").alias("shape")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "allow").alias("allowed"))
    with scratch(pages.sparkSession) as kept:
        tree = templates(shapes)
        of = kept(tree.select("host", "shape", "template").join(purities(tree), ["host", "template"]).select("host", F.col("shape").alias("_shape"), F.col("template").alias("_template"), "purity"))
    open_ = rows.where("rule is null").withColumnRenamed("template", "_shape")
    judged = open_.join(of, ["host", "_shape"], "left").select(*keep, "host", "path", "rule", F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("verdict"), F.col("_template").alias("template"), "purity")
    by_rule = rows.where("rule is not null").select(*keep, "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    return by_rule.unionByName(judged)
