"""URL filter: explicit rules first, then a tree of path templates per host.

The tree has one level for each path segment, as deep as the paths go. A segment
that many rows of its branch share stays literal, all others become a wildcard.
At every level sibling branches whose labelled shares, over all rows below them,
do not differ by a two-proportion test are merged; the segments below a merged
branch are counted together. A template is rejected when its Laplace-smoothed
share of bad labels is high.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_ascii
from tallyframe.session import materialise


@dataclass(frozen=True)
class UrlRule:
    action: str
    host: str
    path: str


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class TreeOptions:
    min_rows: int = 5  # a literal segment has at least so many rows, a smaller branch is not split; ...
    min_share: float = 0.02  # ... and this share of its branch, so a branch has at most 1 / min_share + 1 children
    z: float = 1.96  # siblings closer than this are merged
    bad_share: float = 0.8  # smoothed purity from which a template is rejected


def located(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    shape = r"^([^/?#]*)([^?#]*)"
    return fold_ascii(F.regexp_extract(rest, shape, 1)), F.regexp_extract(rest, shape, 2)


def ruled(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, null without one; equal lengths go by list order."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        action = F.when(fits, F.lit(r.action)).otherwise(action)
    return rule, action


END = "/"  # stands for the end of a path, as no segment holds it


def _branches(rows: DataFrame, options: TreeOptions) -> DataFrame:
    """The branches below each ``branch`` of ``rows``: child, the branch it was merged into, rows, purity, template.

    A branch has at most 1 / min_share + 2 children, whatever the number of rows.
    """
    counts = rows.groupBy("branch", "template", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad_rows")
    )
    totals = counts.groupBy("branch").agg(F.sum("n").alias("total"))
    literal = (F.col("n") >= options.min_rows) & (F.col("n") >= options.min_share * F.col("total"))
    children = counts.join(totals, "branch").withColumn(
        "child", F.when((F.col("segment") == END) | literal, F.col("segment")).otherwise("*")
    ).groupBy("branch", "template", "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad_rows")])
    siblings = Window.partitionBy("branch").orderBy((F.col("bad_rows") + 1) / (F.col("labelled") + 2), "child")
    n, k = F.col("labelled"), F.col("bad_rows")
    n0, k0 = F.lag(n).over(siblings), F.lag(k).over(siblings)
    pooled = (k + k0 + 1) / (n + n0 + 2)
    far = F.abs((k + 1) / (n + 2) - (k0 + 1) / (n0 + 2)) > options.z * F.sqrt(
        pooled * (1 - pooled) * (1 / (n + 2) + 1 / (n0 + 2))
    )
    runs = children.withColumn("cut", F.coalesce(far, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("cut").over(siblings.rowsBetween(Window.unboundedPreceding, 0))
    )
    run = Window.partitionBy("branch", "run")
    names = F.array_sort(F.collect_list("child").over(run))
    shown = F.array_join(F.transform(names, lambda c: F.when(c == END, "").otherwise(c)), "|")
    name = F.when(F.size(names) > 1, F.concat(F.lit("/{"), shown, F.lit("}"))).when(
        F.col("child") == END, "").otherwise(F.concat(F.lit("/"), shown))
    return runs.select(
        "branch", "child", F.md5(F.concat_ws("/", "branch", names)).alias("merged"), F.sum("n").over(run).alias("rows_below"),
        ((F.sum("bad_rows").over(run) + 1) / (F.sum("labelled").over(run) + 2)).alias("purity"),
        F.concat("template", name).alias("named"),
    )


def _placed(rows: DataFrame, options: TreeOptions) -> DataFrame:
    """Rows with ``host`` and ``segments``, each with template and purity of the branch in which its path ends.

    A level reads and writes only the rows whose paths go on in branches worth splitting.
    """
    fields = [c for c in rows.columns if c != "segments"]
    left = materialise(
        rows.withColumns({"branch": F.col("host"), "template": F.col("host"), "segment": F.get("segments", F.lit(0))})
        .withColumn("segment", F.coalesce("segment", F.lit(END))), "url-level"
    )
    ended, level = [], 0
    while level == 0 or not left.isEmpty():
        level += 1
        branches = materialise(_branches(left, options), "url-branches")
        wild = branches.where("child = '*'").select(
            "branch", *[F.col(c).alias(f"w_{c}") for c in ("merged", "rows_below", "purity", "named")])
        own = branches.withColumnRenamed("child", "segment")
        found = left.drop("template").join(own, ["branch", "segment"], "left").join(wild, "branch", "left")
        following = F.coalesce(F.get("segments", F.lit(level)), F.lit(END))
        moved = materialise(found.select(
            *fields, "segments", *[F.coalesce(c, f"w_{c}").alias(c) for c in ("merged", "rows_below", "purity", "named")],
            F.col("segment").alias("was"), following.alias("segment"),
        ).withColumnsRenamed({"merged": "branch", "named": "template"}), "url-level")
        done = (F.col("was") == END) | (F.col("rows_below") < options.min_rows)
        ended.append(moved.where(done).select(*fields, "template", "purity"))
        left = moved.where(~done).drop("was", "rows_below", "purity")
    return reduce(DataFrame.unionByName, ended)


def url_filter(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: Sequence[UrlRule] = RULES,
    options: TreeOptions = TreeOptions(),
) -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url).

    ``labels`` (page_id, bad 0/1) are the labelled rows; without them the rules
    label the rows that they fit, and templates pass what they have learnt on to
    rows that no rule fits. Everything is joins and grouped counts; template
    joins are plain equi-joins whose hot keys AQE splits. A path of any length is
    followed while at least ``min_rows`` rows share its branch. Slashes at the end
    of a path do not count. Siblings of equal share are ordered by their name.

    Null urls and urls without ``://`` have an empty host and path and are
    allowed unless labelled otherwise. Repeated rows and page_ids are judged
    each; several labels of one page count by their maximum, null labels not at
    all. Columns other than page_id and url are not read. No rows, no result.
    """
    host, path = located(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"))
    if labels is None:
        bad = F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
        rows = rows.withColumn("bad", bad)
    else:
        known = labels.where("page_id is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
        rows = rows.join(known, "page_id", "left")
    bare = F.regexp_replace("path", "^/|/++$", "")
    segments = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "/"))
    verdicts = _placed(rows.withColumn("segments", segments), options)
    learnt = F.when(F.col("purity") >= options.bad_share, F.lit("block")).otherwise(F.lit("allow"))
    return verdicts.select(
        "page_id", "host", "path", "rule", F.coalesce("action", learnt).alias("verdict"), "template", "purity"
    )
