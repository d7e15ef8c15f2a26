"""Operator 8: URL filters by rules and by a path-template tree of each host.

1. Rules: a rule (host, path prefix) fits its host and all subdomains; the longest rule that fits decides.
2. Templates: the path's segments that look like values (numbers, hashes, dates, ids) become `*`. Level by level, a
   node's children that are many and rare become `*` too, except those whose labelled share of bad pages differs
   significantly from the others'; these become `*` with that share, in steps of 1 / STEPS. Children whose labelled shares of bad
   pages do not differ significantly are merged into one branch.
3. A template whose purity, (bad + STRENGTH * prior) / (labelled + STRENGTH), reaches REJECT is rejected. The prior is
   that of its parent's other pages, smoothed alike by those of the parent's parent, up to the host, whose prior
   is PRIOR; so a small template follows its section or host, and no page counts twice.

All of it is grouping and joining on (host, template) counts; no host is ever gathered in one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import ACCEPT, QualityModel, fit, score_quality
from .shared import cut, held_out, table

#: Steps of the shares by which rare children that differ from the others are pooled.
STEPS = 20
#: A node of more than FANOUT children makes `*` of those that hold less than RARE of its pages.
FANOUT, RARE = 16, 0.02
STRENGTH, PRIOR, REJECT = 4.0, 0.5, 0.75
#: Children are merged while the difference of neighbouring shares is below so many standard errors.
SIMILAR = 1.64
_VALUE = r"(?i)(^|[-_.])(\d+|[0-9a-f]{8,}|[a-z]*\d[a-z0-9]*\d[a-z0-9]*)(?=$|[-_.])"


@dataclass(frozen=True)
class Rule:
    """block or allow a host with its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def of(verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<n, rule, verdict> of the longest rule that fits, or null. Of equal texts, block wins."""
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def segments_of(path: Column) -> Column:
    """The path's segments, values as `*`; a trailing slash is no segment of its own."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, _VALUE, "$1*"))


def templates(urls: DataFrame) -> DataFrame:
    """Templates of the shapes in `urls` (host, shape array<string>, n, bad, good): (host, shape, template, n, bad, good, purity), one row for each shape.

    One pass for each level at which a node branches, up to the last at which two shapes still share one: what all shapes of a node (host, template so far) have in
    common is passed over at once, as in a radix tree; then its children are generalised and merged. A shape alone at its node keeps its other segments as they
    are. Passes grow with branchings on one path, not with segments."""
    node = ["host", "template"]
    smooth = lambda bad, labelled, prior: (bad + STRENGTH * prior) / (labelled + STRENGTH)
    tree = cut(urls.withColumn("template", F.lit("")).withColumn("prior", F.lit(PRIOR)).withColumn("rest", F.col("shape")))
    finished = []
    while True:
        # The least and the greatest of a node's shapes have in common what all have.
        edges = tree.groupBy(*node).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False)).cast("int")
        edges = edges.select(*node, F.when(differ == 0, F.size("low")).otherwise(differ - 1).alias("common"), "low")
        passed = F.when(F.col("common") > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("low", F.lit(1), F.col("common")), "/"))).otherwise(F.col("template"))
        tree = cut(tree.join(edges, node).withColumns({"template": passed, "rest": F.slice("rest", F.col("common") + 1, F.size("rest"))}).drop("low", "common"))
        segment = F.get("rest", F.lit(0))
        ends = F.size("rest") == 0
        # What ends at a node is one more child of it.
        here = tree.groupBy(*node).agg(
            F.count("*").alias("shapes"), F.sum("bad").alias("node_bad"), F.sum(F.col("bad") + F.col("good")).alias("node_labelled"),
            F.sum(F.when(ends, F.col("bad")).otherwise(0)).alias("end_bad"), F.sum(F.when(ends, F.col("bad") + F.col("good")).otherwise(0)).alias("end_labelled"),
        )
        rows = cut(tree.join(here, node))
        done = ends | (F.col("shapes") == 1)
        before = smooth(F.col("node_bad") - F.col("end_bad"), F.col("node_labelled") - F.col("end_labelled"), F.col("prior"))
        purity = F.when(F.col("shapes") == 1, smooth(F.col("bad"), F.col("bad") + F.col("good"), F.col("prior"))).otherwise(smooth(F.col("end_bad"), F.col("end_labelled"), before))
        whole = F.when(ends, F.col("template")).otherwise(F.concat("template", F.lit("/"), F.array_join("rest", "/")))
        finished.append(rows.where(done).select("host", "shape", whole.alias("template"), "n", "bad", "good", purity.alias("purity")))
        tree = rows.where(~done).drop("shapes", "end_bad", "end_labelled")
        if tree.isEmpty():
            break
        kids = tree.select("host", "template", segment.alias("segment"), "n", "bad", "good")
        kids = kids.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("all"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
        rare = (F.col("kids") > FANOUT) & (F.col("n") < RARE * F.col("all"))
        own, others = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")
        share, beside = (F.col("bad") + 0.5) / (own + 1), (F.col("all_bad") - F.col("bad") + 0.5) / (others + 1)
        # Where no other child is labelled, the labelled ones stay apart from those that nothing is known of.
        differs = (own > 0) & ((others == 0) | (F.abs(share - beside) > SIMILAR * F.sqrt(share * (1 - share) / own + beside * (1 - beside) / F.greatest(others, F.lit(1)))))
        pooled = F.when(differs, F.concat(F.lit("*"), F.format_number(F.round(share * STEPS) / STEPS, 2))).otherwise("*")
        named = kids.join(nodes, node).withColumn("name", F.when(rare, pooled).otherwise(F.col("segment")))
        named = cut(named.select("host", "template", "segment", "name", "n", "bad", "good"))
        branch = cut(named.groupBy("host", "template", "name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
        # After generalising, a node has at most FANOUT + 1 / RARE + STEPS + 1 children: a bounded window.
        labelled = F.col("bad") + F.col("good")
        order = Window.partitionBy("host", "template").orderBy("share", "name")
        branch = branch.where(labelled > 0).withColumn("share", (F.col("bad") + 0.5) / (labelled + 1)).withColumn("labelled", labelled)
        gap = F.col("share") - F.lag("share").over(order)
        error = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("labelled") + F.lag(F.col("share") * (1 - F.col("share")) / F.col("labelled")).over(order))
        branch = branch.withColumn("starts", F.coalesce(gap > SIMILAR * error, F.lit(True)).cast("int"))
        branch = branch.withColumn("group", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = branch.groupBy("host", "template", "group").agg(F.array_sort(F.collect_list("name")).alias("names"), F.sum("bad").alias("branch_bad"), F.sum("labelled").alias("branch_labelled"))
        merged = merged.select("host", "template", "branch_bad", "branch_labelled", F.explode("names").alias("name"), F.when(F.size("names") > 1, F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}"))).otherwise(F.element_at("names", 1)).alias("branch"))
        names = named.select("host", "template", "segment", "name").join(merged, ["host", "template", "name"], "left").select("host", "template", "segment", F.coalesce("branch", "name").alias("branch"), F.coalesce("branch_bad", F.lit(0)).alias("branch_bad"), F.coalesce("branch_labelled", F.lit(0)).alias("branch_labelled"))
        tree = cut(
            tree.withColumn("segment", segment)
            .join(names, ["host", "template", "segment"])
            .select("host", "shape", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), F.concat("template", F.lit("/"), "branch").alias("template"), "n", "bad", "good", smooth(F.col("node_bad") - F.col("branch_bad"), F.col("node_labelled") - F.col("branch_labelled"), F.col("prior")).alias("prior"))
        )
    return cut(reduce(DataFrame.union, finished))


def judge_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, template, purity, rule and verdict of each row of `pages`.

    verdict is the rule's; without a rule, block where the template is rejected, else allow. Purity is learned from
    labelled pages: those in `labels` (id, bad 0 or 1) and those that a rule allows (good). A block rule is a policy on a part of a site and says nothing on the
    rest, so it labels none. A page labelled more than once counts as bad if one label says so. A null url, or one without
    ://, has an empty host and path and is allowed; repeated rows are judged alike; other columns are not looked at."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", segments_of(F.col("path")))
    bad = F.when(F.col("fit.verdict") == "allow", 0)
    if labels is not None:
        known = labels.groupBy(F.col(id_col).alias("page_id")).agg(F.max("bad").cast("int").alias("label"))
        rows = rows.join(known, "page_id", "left")
        bad = F.greatest(bad, F.col("label"))
    rows = cut(rows.withColumn("bad", bad).select("page_id", "host", "path", "fit", "shape", "bad"))
    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"), F.sum(F.coalesce(1 - F.col("bad"), F.lit(0))).alias("good"))
    found = templates(counts).select("host", "shape", "template", "purity")
    verdict = F.coalesce(F.col("fit.verdict"), F.when((F.col("host") != "") & (F.col("purity") >= REJECT), "block").otherwise("allow"))
    return rows.join(found, ["host", "shape"], "left").select("page_id", "host", "path", "template", "purity", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


RULES = [Rule.of("block", "com/en/"), Rule.of("allow", "example.com/en/7"), Rule.of("allow", "net/de/"), Rule.of("block", "example.net/de/8"), Rule.of("block", "org/es/")]


def page_text(html: Column) -> Column:
    """The text of a page's first article, or of the whole page without one, with tags as spaces; null without html."""
    article = F.regexp_extract(html, r"(?si)<article\b[^>]*>(.*?)</article>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.when(article != "", article).otherwise(html), r"<[^>]*>", " "), r"\s+", " "))


def content_labels(pages: DataFrame, model: QualityModel | None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, bad) of the pages that a quality model is sure of: 1 where their text is poor, 0 where it is good, as sure as ACCEPT. Pages without html say nothing."""
    rows = pages.where(F.col(html_col).isNotNull()).select(id_col, page_text(F.col(html_col)).alias("text"))
    bad = F.when(F.col("score") <= 1 - ACCEPT, 1).when(F.col("score") >= ACCEPT, 0)
    return score_quality(rows, model).select(id_col, bad.alias("bad")).where("bad is not null")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by their own text: the quality model is learned from documents, and no list of words is used."""
    pages = table(spark, sf_dir, "pages")
    model = fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return judge_urls(pages, RULES, labels=content_labels(pages, model))
