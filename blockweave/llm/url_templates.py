"""URL verdicts by rules and by a tree of path templates for each host.

A path's segments are generalised by shape (numbers, hex, dates, mixed ids become
wildcards that keep their file ending); from there on only (host, template) counts
are worked on, so a host with a third of all urls is a few rows for each of its
templates; rows of a host, node or template that has many stay where they are and meet
its one row there.  Level by level, children of a node that have too little to tell them from
their pooled siblings are merged into ``*``: their share of urls that end there and
their share of rejected labels must lie within the Hoeffding bound of both counts, and
the node must have several children.  What lies deeper than ``depth`` is one tail.

A template's purity is its share of allowed labels, smoothed by its host's share, and
that by the same template's share on all hosts, and that by ``prior``.  Templates below
``reject`` are blocked.  Labels are the verdicts of the rules, or a column of the caller.

Rules come first: a rule fits its host and all hosts below it if the path starts as
the rule's does, and the longest one that fits wins.

Defined results: a null url, or one without ``://``, has an empty host and path and is
judged like others of that host.  Repeated rows each count and get a result.  An empty
table gives an empty result.  ``judge`` gives its own columns only, so no column can
clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import cut, join_hot

#: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEPTH, CHILDREN, ALPHA = 4, 8, 0.05
PRIOR, REJECT, STRENGTH = 0.6, 0.4, 5.0
_AZ, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _AZ, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that fits, as host and path, and its verdict; nulls without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A segment with its variable part as a wildcard."""
    ending = F.regexp_extract(segment, r"(\.[a-z]{2,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[a-z]{2,5}$", "")
    mark = (
        F.when(stem.rlike(r"^[0-9]+$"), "<n>")
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
        .when(stem.rlike(r"^[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "<hex>")
        .when(stem.rlike(r"[0-9]") & (F.length(stem) >= 6), "<id>")
    )
    return F.when(mark.isNotNull(), F.concat(mark, ending)).otherwise(segment)


def segments(path: Column, depth: int) -> Column:
    """Generalised segments down to the depth; all that is deeper is one tail."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    top = F.transform(F.slice(parts, 1, depth), shape)
    return F.when(F.size(parts) > depth, F.concat(top, F.array(F.lit("**")))).otherwise(top)


def merge_level(rows: DataFrame, level: int, least: int, alpha: float) -> DataFrame:
    """Rows (host, seg, n, good, bad) with similar children of level's nodes merged into ``*``."""
    prefix = F.slice("seg", 1, level)
    keyed = cut(rows).withColumn("prefix", F.concat_ws("/", prefix)).withColumn("child", F.when(F.size("seg") > level, F.get("seg", F.lit(level)))).withColumn("ends", F.when(F.size("seg") == level + 1, F.col("n")).otherwise(0))
    inner = keyed.where("child is not null")
    nodes = cut(inner.groupBy("host", "prefix", "child").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("n", "good", "bad", "ends")]))
    pool = nodes.groupBy("host", "prefix").agg(F.count("*").alias("w"), F.count("*").alias("children"), *[F.sum(c).alias("p_" + c) for c in ("n", "good", "bad", "ends")])
    both = join_hot(nodes, pool, ["host", "prefix"], "w")

    def alike(part: str, size: Column, p_size: Column) -> Column:
        rest = p_size - size
        bound = F.sqrt(F.lit(0.5) * F.log(F.lit(2 / alpha))) * (1 / F.sqrt(size) + 1 / F.sqrt(rest))
        return (size <= 0) | (rest <= 0) | (F.abs(F.col(part) / F.greatest(size, F.lit(1)) - (F.col("p_" + part) - F.col(part)) / F.greatest(rest, F.lit(1))) <= bound)

    labelled, p_labelled = F.col("good") + F.col("bad"), F.col("p_good") + F.col("p_bad")
    safe = F.when((F.col("n") > 0) & (F.col("p_n") > F.col("n")), alike("ends", F.col("n").cast("double"), F.col("p_n").cast("double"))).otherwise(True)
    pure = F.when((labelled > 0) & (p_labelled > labelled), alike("bad", labelled.cast("double"), p_labelled.cast("double"))).otherwise(True)
    merge = (F.col("children") >= least) & ~F.col("child").startswith("<") & (F.col("child") != "**") & safe & pure
    out = join_hot(inner, both.select("host", "prefix", "child", merge.alias("merge"), "rows"), ["host", "prefix", "child"], "rows")
    out = out.unionByName(keyed.where("child is null").withColumn("merge", F.lit(False)))
    seg = F.when(F.col("merge"), F.concat(prefix, F.array(F.lit("*")), F.slice("seg", level + 2, 99))).otherwise(F.col("seg"))
    return out.select("host", "shape", seg.alias("seg"), "n", "good", "bad")


def templates(urls: DataFrame, *, depth: int = DEPTH, least: int = CHILDREN, alpha: float = ALPHA, prior: float = PRIOR, strength: float = STRENGTH) -> DataFrame:
    """(host, shape, label) -> host, shape, n, template, urls, good, bad, purity; label is allow, block or null.

    n counts the shape's urls, the other numbers are the template's.
    """
    rows = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == "allow", 1)).alias("good"), F.count(F.when(F.col("label") == "block", 1)).alias("bad"))
    rows = cut(rows.withColumn("seg", F.col("shape")))
    for level in range(depth):
        rows = merge_level(rows, level, least, alpha)
    rows = cut(rows.withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "seg"))))
    here = cut(rows.groupBy("host", "template").agg(F.count("*").alias("rows"), *[F.sum(c).alias("own_" + c) for c in ("good", "bad", "n")]))
    sums = lambda by: here.groupBy(by).agg(F.count("*").alias("w"), F.sum("own_good").alias(f"{by}_good"), F.sum("own_bad").alias(f"{by}_bad"))
    tree = join_hot(cut(join_hot(here, sums("template"), ["template"], "w")), sums("host"), ["host"], "w")
    smooth = lambda good, bad, base: (F.col(good) + strength * base) / (F.col(good) + F.col(bad) + strength)
    general = smooth("template_good", "template_bad", F.lit(prior))
    purity = smooth("own_good", "own_bad", smooth("host_good", "host_bad", general))
    tree = tree.select("host", "template", F.col("own_n").alias("urls"), F.col("own_good").alias("good"), F.col("own_bad").alias("bad"), purity.alias("purity"), "rows")
    return join_hot(rows.select("host", "shape", "n", "template"), tree, ["host", "template"], "rows")


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, label: Column | None = None, reject: float = REJECT, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None).cast("string") if label is None else label).alias("given"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    slim = slim.withColumns({"rule": name, "by_rule": verdict, "shape": segments(F.col("path"), options.get("depth", DEPTH))})
    found = templates(slim.withColumn("label", F.coalesce("given", "by_rule")), **options)
    out = join_hot(slim, found.select("host", "shape", "template", "purity", "n"), ["host", "shape"], "n")
    own = F.when(F.col("purity") < reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "template", "purity")
