"""Directed graphs as edge tables: degrees, bounded reachability, cycles, orphans, prefix resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.storage import stored


def edges(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """src, dst: each edge once, without loops and nulls."""
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src != dst").distinct()


def degrees(graph: DataFrame) -> DataFrame:
    """node, fan_in, fan_out, centrality. Each edge is read once and combined before the one shuffle."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    e = graph.select(F.explode(ends).alias("e")).select("e.*")
    g = e.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return g.withColumn("centrality", F.col("fan_in") + F.col("fan_out"))


def hubs(graph: DataFrame, n: int) -> DataFrame:
    """The n nodes of highest centrality, then fan_in, fan_out and name, all descending."""
    return degrees(graph).orderBy(*[F.desc(c) for c in ("centrality", "fan_in", "fan_out", "node")]).limit(n)


def reachable(graph: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, node, depth: nodes reached from each start over one or more edges, at the least depth.

    A start on a cycle reaches itself. Each round joins only what the last round found and drops what
    was reached before; rounds are written to the shared folder, so lineage does not grow. Without
    ``max_depth`` it ends when a round finds nothing new.
    """
    frontier = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("node", F.col("start"))
    reached: DataFrame | None = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(graph, frontier["node"] == graph["src"]).select("start", F.col("dst").alias("node")).distinct()
        if reached is not None:
            found = found.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        found = stored(found.withColumn("depth", F.lit(depth)), "reach")
        if found.isEmpty():
            break
        reached = found if reached is None else reached.unionByName(found)
        frontier = found.select("start", "node")
    if reached is None:
        return frontier.select("start", "node", F.lit(0).alias("depth")).limit(0)
    return reached


def trimmed(graph: DataFrame) -> DataFrame:
    """The edges left when nodes without an edge in or out are dropped again and again; every cycle stays whole.

    Most of a sparse graph goes in a few rounds of semi-joins; what is left lies on cycles or on ways between them.
    """
    left, n = stored(graph, "trim"), -1
    while (now := left.count()) != n:
        n = now
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = stored(kept, "trim")
    return left


def cycle_nodes(graph: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, length: nodes on a cycle with the length of their shortest one. Only what ``trimmed`` leaves is searched."""
    core = trimmed(graph)
    return reachable(core, core.select("src").distinct(), max_depth).where("start = node").select("node", F.col("depth").alias("length"))


def orphans(nodes: DataFrame, graph: DataFrame, node: str) -> DataFrame:
    """Nodes that are neither end of any edge."""
    ends = graph.select(F.col("src").alias(node)).union(graph.select(F.col("dst").alias(node)))
    return nodes.where(F.col(node).isNotNull()).select(node).distinct().join(ends, node, "left_anti")


def prefixes(name: Column, dot: str = ".") -> Column:
    """All dotted prefixes of a name, the name itself last."""
    parts = F.split(name, rf"\{dot}")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), dot))


def resolve_longest(names: DataFrame, name: str, targets: DataFrame, target: str) -> DataFrame:
    """name, resolved: the longest dotted prefix of each different name that is a target, null if none is."""
    each = names.where(F.col(name).isNotNull()).select(name).distinct().withColumn("_p", F.explode(prefixes(F.col(name))))
    known = targets.where(F.col(target).isNotNull()).select(F.col(target).alias("_p")).distinct().withColumn("_t", F.col("_p"))
    return each.join(known, "_p", "left").groupBy(name).agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.length("_t"))).alias("resolved"))


def branch_token(i: Column) -> Column:
    """Ordinal 0, 1, 2 ... as a, b ... z, aa, ab ... zz, aaa ...: letters count from 1 in base 26, for any whole number. Null and negative ordinals give null."""
    step = lambda a: F.struct((F.floor((a["n"] - 1) / 26)).cast("long").alias("n"), F.concat(F.char(F.lit(97) + (a["n"] - 1) % 26), a["t"]).alias("t"))
    begin = F.struct((i.cast("long") + 1).alias("n"), F.lit("").alias("t"))
    # 14 letters name every 64-bit ordinal
    spelt = F.aggregate(F.sequence(F.lit(1), F.lit(14)), begin, lambda a, _: F.when(a["n"] > 0, step(a)).otherwise(a))
    return F.when(i >= 0, spelt["t"])


def preorder(paths: DataFrame, scope: str, path: str) -> DataFrame:
    """Adds ``place``: each node's place from 1 in depth-first order of its tree, by its Dewey label."""
    key = F.transform(F.split(path, r"\."), lambda x: x.cast("int"))
    return paths.withColumn("_o", key).withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy("_o"))).drop("_o")
