"""URL filter by a path-template tree.

Each URL becomes a host and a path of segments.  Segments that look variable (numbers, hex,
dates) become wildcards at once, so a host shrinks to its distinct templates by map-side
aggregation.  Level by level, a branching point with many rare children generalises them too.
At every level, sibling branches whose rates do not differ merge.  A branch that has
labels of its own is rejected when its smoothed share of bad visits is high; the estimate of a
small template leans on its host, that of a small host on the labels as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import LOWER, UPPER


@dataclass(frozen=True)
class TreeRules:
    """Numbers of the tree; ``seeds`` mark hosts whose URLs count as labelled bad."""

    many: int = 16  # children from which a branching point may be variable
    rare: float = 0.25  # children per visit from which it is
    z: float = 2.0  # rates closer than so many standard errors merge
    prior: float = 4.0  # visits that the parent's rate counts for
    reject: float = 0.5
    #: Tokens of host or path that label a URL as bad.
    seeds: tuple[str, ...] = ("ads", "adult", "bets", "casino", "porn", "spam", "viagra", "warez", "xxx")


#: Rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule (verdict, name) that fits, as a struct; null if none does."""
    out = None
    for verdict, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _shape(segment: Column) -> Column:
    """A segment, or its wildcard where it looks variable."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "<n>")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("<n>."), F.regexp_extract(segment, r"\.([A-Za-z]+)$", 1)))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
        .when(segment.rlike(r"^[0-9a-fA-F-]{12,}$"), "<hex>")
        .otherwise(segment)
    )


def _segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _shape)


def templates(paths: DataFrame, rules: TreeRules) -> DataFrame:
    """Distinct (host, segments) with visits, labelled and bad, and the template each belongs to.

    ``paths`` has one row per distinct host and segment list.  Each level is written once:
    it is read again by the next one, and a plan of all levels would double at each.  A path
    leaves the loop when too few others share its start for any later level to be variable.
    """
    t = stable(paths.withColumn("template", F.lit("")))
    done, level = [], 0
    while not t.isEmpty():
        level += 1
        part = F.try_element_at("segments", F.lit(level))
        here = t.where(part.isNotNull()).groupBy("host", "template", part.alias("part")).agg(F.sum("visits").alias("n"), F.count(F.lit(1)).alias("paths"))
        plain = ~F.col("part").startswith("<")
        node = here.groupBy("host", "template").agg(F.sum("paths").alias("below"), F.count_if(plain).alias("children"), F.sum(F.when(plain, F.col("n"))).alias("through"))
        node = node.where(F.col("below") >= rules.many)
        wide = F.coalesce((F.col("children") >= rules.many) & (F.col("children") >= rules.rare * F.col("through")), F.lit(False))
        t = t.join(node.select("host", "template", wide.alias("wide")), ["host", "template"], "left")
        name = F.when(F.col("wide") & ~part.startswith("<"), F.lit("<*>")).otherwise(part)
        rest = F.array_join(F.slice("segments", level, F.greatest(F.size("segments") - level + 1, F.lit(0))), "/")
        longer = F.concat("template", F.lit("/"), F.when(F.col("wide").isNull(), rest).otherwise(name))
        t = t.withColumn("template", F.when(part.isNull(), F.col("template")).otherwise(longer))
        t = stable(t.withColumn("open", F.col("wide").isNotNull() & part.isNotNull()).drop("wide"))
        done.append(t.where("not open").drop("open"))
        t = t.where("open").drop("open")
    return reduce(DataFrame.unionByName, done) if done else t


def _starred(branch: Column, level: int) -> Column:
    """The branch with ``*`` as segment ``level``; null if it has no such segment."""
    parts = F.split(branch, "/")  # the first is empty
    return F.when(F.size(parts) > level, F.array_join(F.transform(parts, lambda s, i: F.when(i == level, "*").otherwise(s)), "/"))


def merge(leaf: DataFrame, rules: TreeRules) -> DataFrame:
    """``leaf`` with ``branch``: level by level, siblings (same host, all other segments equal)
    whose rates do not differ from their pooled one get one name.  Only templates of a host
    with equally many segments can be siblings, so levels end where the last such pair ends."""
    leaf = leaf.withColumn("branch", F.col("template"))
    pairs = leaf.groupBy("host", F.size(F.split("template", "/")).alias("n")).count().where("count > 1")
    deepest = (pairs.agg(F.max("n")).first()[0] or 0) - 1
    for level in range(1, max(1, deepest) + 1):
        b = leaf.groupBy("host", "branch").agg(*[F.sum(c).alias(c) for c in ("visits", "labelled", "bad")])
        b = b.withColumn("shape", _starred(F.col("branch"), level))
        # a sibling without labels has no rate of its own: it neither enters a pool that has labels nor takes its verdict
        own = F.col("labelled") > 0
        pool = b.where("shape is not null").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("siblings"), F.sum("labelled").alias("pool_labelled"), F.sum(F.when(own, F.col("visits")).otherwise(0)).alias("pool_visits"), F.sum("bad").alias("pool_bad"))
        b = b.join(pool, ["host", "shape"])
        rate = (F.col("pool_bad") + 1) / (F.col("pool_visits") + 2)
        far = F.abs(F.col("bad") - F.col("visits") * rate) > rules.z * F.sqrt(F.col("visits") * rate * (1 - rate))
        joins = ~((F.col("pool_labelled") > 0) & (~own | far)) & ((F.col("siblings") > 1) | F.lit(level == 1))
        leaf = leaf.join(b.where(joins).select("host", "branch", "shape"), ["host", "branch"], "left")
        leaf = stable(leaf.withColumn("branch", F.coalesce("shape", "branch")).drop("shape"))
    return leaf


def judge(t: DataFrame, rules: TreeRules) -> DataFrame:
    """Template verdicts: host, template, branch (the merged template), purity, reject.

    Rates are bad visits over all visits: a visit without a label counts as not bad.
    """
    leaf = t.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("visits", "labelled", "bad")])
    leaf = merge(leaf, rules)
    merged = leaf.groupBy("host", "branch").agg(*[F.sum(c).alias(c) for c in ("visits", "labelled", "bad")])
    host = merged.groupBy("host").agg(*[F.sum(c).alias(f"host_{c}") for c in ("visits", "labelled", "bad")])
    total = host.agg(F.sum("host_labelled").alias("labelled"), F.sum("host_bad").alias("bad")).first()
    whole_rate = F.lit((total["bad"] or 0) / max(total["labelled"] or 0, 1))
    host_rate = (F.col("host_bad") + rules.prior * whole_rate) / (F.col("host_visits") + rules.prior)
    purity = (F.col("bad") + rules.prior * host_rate) / (F.col("visits") + rules.prior)
    merged = merged.join(host, "host").withColumn("purity", purity)
    # without a label of its own, a branch is not rejected
    merged = merged.withColumn("reject", (F.col("purity") >= rules.reject) & (F.col("labelled") > 0))
    return leaf.select("host", "template", "branch").join(merged.select("host", "branch", "purity", "reject"), ["host", "branch"])


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, tree: TreeRules = TreeRules(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, url, host, path, rule, verdict, template, purity.

    * A null URL, or one without ``://``, has an empty host and path; no rule fits it, and the
      tree allows it unless empty hosts are labelled bad.
    * A rule (verdict, domain, path start) beats the tree; of several that fit the longest wins.
    * Labels of the tree: URLs that an allow rule names are good; URLs with a seed token are
      bad.  A visit without label counts against rejection, a branch without labels is allowed.
    * Repeated rows are judged one by one and count as visits; other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segments", _segments(F.col("path")))
    words = F.split(F.concat("host", F.lit("/"), F.translate("path", UPPER, LOWER)), r"[^a-z0-9]+")
    bad = F.arrays_overlap(words, F.array(*[F.lit(s) for s in tree.seeds])) if tree.seeds else F.lit(False)
    good = F.coalesce(F.col("hit.verdict") == "allow", F.lit(False))
    counted = rows.select("host", "segments", bad.cast("long").alias("bad"), (bad | good).cast("long").alias("labelled"))
    counted = counted.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("visits"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    tagged = templates(counted, tree)
    found = tagged.select("host", "segments", "template").join(judge(tagged, tree), ["host", "template"])
    out = rows.join(found.select("host", "segments", "template", "branch", "purity", "reject"), ["host", "segments"], "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("reject"), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.col("branch").alias("template"), "purity")
