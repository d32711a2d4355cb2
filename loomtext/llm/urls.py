"""URL filter: a tree of path templates for each host, with built-in DataFrame functions only.

Paths are taken once each with their page and label counts. Level by level, a node's segments become branches: a
segment's digits are its variable part, and a shape seen with VARIED values or more is one branch (`#`); where a node has
MANY branches or more, those whose labels don't differ from the other branches' (two-proportion z under Z) merge into
`*`. A template's purity is its share of good labels, smoothed towards its host's, and that towards the whole table's;
templates under PURITY are rejected. Fixed rules come first: the longest that fits a url decides.

Every level is a table in the shared folder; nodes are aggregated with map-side partial sums and joined back. Keys with
very many rows, such as a host that has a third of the pages, are joined by a broadcast list: there are at most MOST_HOT of them,
since each has more than a MOST_HOT-th of the rows. A segment's own `*` and backslash are written with a backslash before.

Defined results: a null url or one without `://` has empty host and path and is judged by that template; unlabelled
templates take their host's smoothed purity; labels without a page are unused, and several labels of a page all count;
repeated rows get equal results; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import spill, table

#: (verdict, host, path prefix): fixed rules of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Levels of a tree; what follows is one last segment.
DEPTH = 8
VARIED, MANY, Z = 3, 12, 1.64
#: A key is hot with more than this share of the rows (one in so many), and more than HOT_ROWS.
MOST_HOT, HOT_ROWS = 20_000, 1000
SMOOTHING, PURITY = 4.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _rate(bad, n, towards):
    return (bad + SMOOTHING * towards) / (n + SMOOTHING)


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, how: str) -> DataFrame:
    """rows with the facts of their key; facts has a row a key, with `_rows`, how many rows have it, which is dropped."""
    if total <= HOT_ROWS:
        return rows.join(facts.drop("_rows"), keys, how)
    hot = F.col("_rows") > max(HOT_ROWS, total // MOST_HOT)
    few, others = F.broadcast(facts.filter(hot).drop("_rows")), facts.filter(~hot).drop("_rows")
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(others, keys, how))


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """paths (host, path, n, good, bad), one row each -> the same with template."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", depth)
    rows = spill(paths.withColumns({"_parts": F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(parts), "template": F.lit("")}), "tree")
    levels, total = rows.agg(F.max(F.size("_parts")), F.count(F.lit(1))).first()
    plain = lambda c: F.regexp_replace(c, r"([*\\])", r"\\$1")
    for level in range(levels or 0):
        rows = rows.withColumn("_part", F.get("_parts", F.lit(level)))
        rows = rows.withColumn("_shape", F.regexp_replace("_part", "[0-9]+", "#"))
        shapes = rows.filter("_part is not null").groupBy("host", "template", "_shape").agg(
            F.count_distinct("_part").alias("_values"), F.count(F.lit(1)).alias("_rows"), F.sum("good").alias("_good"), F.sum("bad").alias("_bad")
        )
        nodes = shapes.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_branches"), F.sum("_good").alias("_all_good"), F.sum("_bad").alias("_all_bad"))
        seen, other = F.col("_good") + F.col("_bad"), F.col("_all_good") + F.col("_all_bad") - F.col("_good") - F.col("_bad")
        p = _rate(F.col("_all_bad"), F.col("_all_good") + F.col("_all_bad"), F.lit(0.5))
        gap = _rate(F.col("_bad"), seen, p) - _rate(F.col("_all_bad") - F.col("_bad"), other, p)
        z = F.abs(gap) / F.sqrt(p * (1 - p) * (1 / (seen + SMOOTHING) + 1 / (other + SMOOTHING)))
        alike = (F.col("_branches") >= MANY) & (z < Z)
        merged = shapes.join(nodes, ["host", "template"]).select("host", "template", "_shape", "_rows", (F.col("_values") >= VARIED).alias("_varied"), alike.alias("_alike"))
        name = F.when(F.col("_alike"), "*").when(F.col("_varied"), plain("_shape")).otherwise(plain("_part"))
        rows = _joined(rows, merged, ["host", "template", "_shape"], total, "left")
        grown = F.when(F.col("_part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name))
        rows = spill(rows.withColumn("template", grown).drop("_part", "_shape", "_varied", "_alike"), "tree")
    return rows.drop("_parts")


def judge_templates(paths: DataFrame, purity: float = PURITY) -> DataFrame:
    """(host, template, n, good, bad, purity, verdict) of paths with their templates."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    each = paths.groupBy("host", "template").agg(*sums)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("_host_good"), F.sum("bad").alias("_host_bad"))
    whole = paths.agg(F.sum("good"), F.sum("bad")).first()
    base = ((whole[1] or 0) + 1) / ((whole[0] or 0) + (whole[1] or 0) + 2)
    host = _rate(F.col("_host_bad"), F.col("_host_good") + F.col("_host_bad"), F.lit(base))
    pure = 1 - _rate(F.col("bad"), F.col("good") + F.col("bad"), host)
    found = each.join(hosts, "host").withColumn("purity", F.round(pure, 6)).drop("_host_good", "_host_bad")
    return found.withColumn("verdict", F.when(F.col("purity") < purity, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Judge every row. labels: (id, good boolean). Gives id, host, path, rule, verdict, template, purity."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    marks = labels.filter("good is not null").groupBy("id").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counted = urls.join(marks, "id", "left").groupBy("host", "path")
    paths = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    placed = templates(paths)
    sizes = placed.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_rows"))
    judged = judge_templates(placed).select("host", "template", "purity", F.col("verdict").alias("_verdict")).join(sizes, ["host", "template"])
    known = _joined(placed.select("host", "path", "template", F.col("n").alias("_n")), judged, ["host", "template"], placed.count(), "inner")
    fixed = rule_of(F.col("host"), F.col("path"), rules)
    facts = spill(known.withColumnRenamed("_n", "_rows"), "judged")
    out = _joined(urls, facts, ["host", "path"], urls.count(), "inner").withColumn("_rule", fixed)
    return out.select("id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_verdict").alias("verdict"), "template", "purity")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), labels).withColumnRenamed("id", "page_id")
