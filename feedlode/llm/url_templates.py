"""URL filter: rules first, then a tree of path templates per host.

Level by level, the path segments below a node are generalised: segments of one shape (letters,
digits) of which a node has many become a wildcard, and literal segments whose labels do not
differ from their siblings' beyond chance become one branch. The rules' verdicts are the labels.
A template is rejected if its smoothed share of blocked pages is high; its own counts are
smoothed towards the same template on all hosts and towards its host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import UPPER, LOWER, fresh_name, table
from feedlode.session import cut_lineage

#: Distinct segments of one shape below a node from which on they are a wildcard.
MANY = 8
#: Segments from which on a path that is alone below its node is not followed: it has no
#: siblings to be generalised or compared with.
DEPTH = 6
#: Siblings differ from the others at this many standard errors.
DIFFERENT = 2.0
#: Weight of what a share is smoothed towards, in pages.
PRIOR = 4.0
#: Smoothed share of blocked pages from which on a template is rejected.
REJECT = 0.6


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits the host or a domain above it."""
    if not rules:
        return F.lit(None).cast("struct<name: string, verdict: string>")
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        inside = (host == rule.host) | host.endswith(f".{rule.host}")
        fits.append(F.when(inside & path.startswith(rule.path),
                           F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _shape(segment: Column) -> Column:
    """Runs of digits as 9, of letters as a: ``825.html`` is ``9.a``."""
    return F.regexp_replace(F.regexp_replace(segment, "[0-9]+", "9"), r"\p{L}+", "a")


def _one_level(nodes: DataFrame, level: int) -> DataFrame:
    """Add one generalised segment to the template of every path that has one at this level."""
    segment = F.get("segments", F.lit(level))
    nodes = nodes.withColumn("segment", segment).withColumn("shape", _shape(segment))
    node = ["host", "template"]
    children = (nodes.where("segment IS NOT NULL").groupBy(*node, "shape", "segment")
                .agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")))
    shapes = children.groupBy(*node, "shape").agg(
        (F.count("*") >= MANY).alias("wild"), F.sum("a").alias("shape_a"), F.sum("b").alias("shape_b"))
    totals = shapes.where("NOT wild").groupBy(*node).agg(
        F.sum("shape_a").alias("all_a"), F.sum("shape_b").alias("all_b"))
    # A literal child against its literal siblings: difference of shares of blocked pages.
    n = F.col("a") + F.col("b")
    rest = F.col("all_a") + F.col("all_b") - n
    pooled = F.col("all_b") / (n + rest)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / rest))
    gap = F.abs(F.col("b") / n - (F.col("all_b") - F.col("b")) / rest)
    unlike = F.coalesce((n > 0) & (rest > 0) & (error > 0) & (gap > DIFFERENT * error), F.lit(False))
    token = (F.when(F.col("wild"), F.concat(F.lit("{"), "shape", F.lit("}")))
             .when(unlike, F.col("segment")).otherwise(F.lit("~")))
    tokens = (children.join(shapes.select(*node, "shape", "wild"), [*node, "shape"])
              .join(totals, node, "left").select(*node, "segment", token.alias("token")))
    return (nodes.join(tokens, [*node, "segment"], "left")
            .withColumn("template", F.when(F.col("token").isNull(), F.col("template"))
                        .otherwise(F.concat("template", F.lit("/"), "token")))
            .drop("segment", "shape", "token"))


def _close_single(nodes: DataFrame, level: int) -> DataFrame:
    """Paths that alone go on below their node at this level get one branch for what is deeper."""
    deeper = F.size("segments") > level
    single = (nodes.where(deeper).groupBy("host", "template").agg(F.count("*").alias("n"))
              .where("n = 1").select("host", "template", F.lit(True).alias("single")))
    alone = deeper & F.col("single").isNotNull()
    marked = nodes.join(single, ["host", "template"], "left").withColumn("alone", alone)
    return (marked.withColumn("template", F.when(F.col("alone"), F.concat("template", F.lit("/**")))
                              .otherwise(F.col("template")))
            .withColumn("segments", F.when(F.col("alone"), F.slice("segments", 1, level)).otherwise(F.col("segments")))
            .drop("single", "alone"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template, allowed, blocked) from one row per host and path with its labels.

    Every step aggregates per node and segment before anything moves, so that a hot host is a
    matter of its distinct segments; what each level has found is written before the next.
    It ends where no path has a further segment, or none that it shares a node with another.
    """
    spark = paths.sparkSession
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    nodes = cut_lineage(paths.withColumn("segments", segments).withColumn("template", F.lit("")), spark)
    level = 0
    while level < (nodes.agg(F.max(F.size("segments"))).first()[0] or 0):
        if level >= DEPTH:
            nodes = cut_lineage(_close_single(nodes, level), spark)
        nodes = cut_lineage(_one_level(nodes, level), spark)
        level += 1
    return nodes.drop("segments")


def _smoothed(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + PRIOR * prior) / (labelled + PRIOR)


def purity(found: DataFrame) -> DataFrame:
    """(host, template, share): smoothed share of blocked among labelled pages."""
    leaves = found.groupBy("host", "template").agg(
        F.sum("blocked").alias("b"), (F.sum("blocked") + F.sum("allowed")).alias("n"))
    leaves = cut_lineage(leaves)
    # One number for all pages; without a labelled page one half.
    overall = F.lit(leaves.agg((F.sum("b") + 1) / (F.sum("n") + 2)).first()[0] or 0.5)
    pooled = leaves.groupBy("template").agg(F.sum("b").alias("tb"), F.sum("n").alias("tn"))
    hosts = leaves.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("n").alias("hn"))
    all_rows = leaves.join(pooled, "template").join(hosts, "host")
    prior = (_smoothed(F.col("tb"), F.col("tn"), overall) + _smoothed(F.col("hb"), F.col("hn"), overall)) / 2
    return all_rows.select("host", "template", _smoothed(F.col("b"), F.col("n"), prior).alias("share"))


def judge(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url") -> DataFrame:
    """All columns of the pages, and host, path, rule, verdict, template and share.

    Columns of these names are replaced. A null url or one without ``://`` has empty host and
    path, fits no rule and shares the template of all such pages. Repeated rows and equal urls
    get equal verdicts. Without any labelled page the share is one half, so all are allowed.
    """
    rules = RULES if rules is None else rules
    names = ["host", "path", "rule", "verdict", "template", "share"]
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in names or c == url])
    link = F.col(f"`{url}`")
    h, p, fit = (fresh_name(x, base.columns) for x in ("found_host", "found_path", "found_rule"))
    known = base.withColumns({h: host_of(link), p: path_of(link)})
    known = known.withColumn(fit, longest_rule(F.col(h), F.col(p), rules))
    paths = known.groupBy(F.col(h).alias("host"), F.col(p).alias("path")).agg(
        F.count_if(F.col(f"{fit}.verdict") == "allow").alias("allowed"),
        F.count_if(F.col(f"{fit}.verdict") == "block").alias("blocked"))
    found = templates(paths)
    judged = found.join(purity(found), ["host", "template"]).select(
        F.col("host").alias(h), F.col("path").alias(p), F.col("template").alias("template"), "share")
    kept = [c for c in base.columns if c.lower() not in names]
    verdict = F.coalesce(F.col(f"{fit}.verdict"), F.when(F.col("share") >= REJECT, "block").otherwise("allow"))
    return known.join(judged, [h, p]).select(
        *[F.col(f"`{c}`") for c in kept], F.col(h).alias("host"), F.col(p).alias("path"),
        F.col(f"{fit}.name").alias("rule"), verdict.alias("verdict"), "template", "share")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "template", "share")
