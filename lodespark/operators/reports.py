"""Renderers: rows to lines of text in common formats. Everything is an expression; a caller writes the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exposition(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """name, line: samples in the Prometheus text format; null labels are left out."""
    esc = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.concat_ws(",", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}="'), esc(c), F.lit('"'))) for c in labels))
    line = F.concat(F.col(name), F.lit("{"), pairs, F.lit("} "), F.col(value).cast("string"))
    return metrics.select(F.col(name).alias("name"), line.alias("line"))


def metric_kind(name: Column) -> Column:
    """counter for names that contain _total, else gauge."""
    return F.when(F.contains(name, F.lit("_total")), "counter").otherwise("gauge")


def rule_id(issue: Column, length: int = 40) -> Column:
    """A rule's id: the issue in lower case, blanks as hyphens, cut to ``length``."""
    return F.substring(F.replace(F.lower(issue), F.lit(" "), F.lit("-")), 1, length)


def sarif_level(severity: Column) -> Column:
    """error for critical and high, else warning."""
    return F.when(F.lower(severity).isin("critical", "high"), "error").otherwise("warning")


def sarif_rules(findings: DataFrame, issue: str, severity: str, order: str) -> DataFrame:
    """rule_id, name, level, results: each rule once, named as it was first seen."""
    f = findings.where(F.col(issue).isNotNull()).withColumn("rule_id", rule_id(F.col(issue)))
    g = f.groupBy("rule_id").agg(F.min_by(issue, order).alias("name"), F.max(F.when(sarif_level(F.col(severity)) == "error", 1).otherwise(0)).alias("e"), F.count("*").alias("results"))
    return g.select("rule_id", "name", F.when(F.col("e") == 1, "error").otherwise("warning").alias("level"), "results")


def bar(part: Column, width: int = 30) -> Column:
    """A share from 0 to 1 as a bar of ``width`` places."""
    n = F.floor(F.least(F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n))


def mermaid_edges(nodes: DataFrame, scope: str, path: str, parent: str, label: str) -> DataFrame:
    """scope, line: one flowchart line for each node with its parent; roots stand alone."""
    ident = lambda c: F.concat(F.lit("n"), F.replace(F.col(c), F.lit("."), F.lit("_")))
    text = F.replace(F.coalesce(F.col(label), F.lit("")), F.lit('"'), F.lit("'"))
    node = F.concat(ident(path), F.lit('["'), text, F.lit('"]'))
    return nodes.select(scope, F.when(F.col(parent) == "", node).otherwise(F.concat(ident(parent), F.lit(" --> "), node)).alias("line"))


def indented(nodes: DataFrame, scope: str, path: str, label: str) -> DataFrame:
    """scope, place, line: a tree as an indented list, in depth-first order."""
    depth = F.size(F.split(path, r"\.")) - 1
    order = F.transform(F.split(path, r"\."), lambda x: x.cast("int"))
    w = Window.partitionBy(scope).orderBy("_o")
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), F.coalesce(F.col(label), F.lit("")))
    return nodes.withColumn("_o", order).select(scope, F.row_number().over(w).alias("place"), line.alias("line"))


def html_row(cells: list[Column]) -> Column:
    """A table row; markup within cells is escaped, null cells are empty."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in cells), F.lit("</tr>"))
