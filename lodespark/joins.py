"""Joins whose strategy follows from a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.storage import stored

#: The most rows, and bytes, of a side that is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def width(df: DataFrame) -> Column:
    """About how many bytes a row takes: the length of texts and nested values, 8 for each other column."""
    out = F.lit(0)
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        text = c if kind in ("string", "binary") else F.to_json(F.struct(c)) if kind in ("array", "map", "struct") else None
        out = out + (F.lit(8) if text is None else F.coalesce(F.octet_length(text), F.lit(0)) + 16)
    return out.cast("long")


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a ``right`` that is usually small to a ``left`` that may have hot keys.

    ``right`` is counted and measured first (partial sums, nothing moves). Up to ``max_rows`` and
    ``BROADCAST_BYTES`` it is broadcast, so hot keys cost nothing; beyond that a shuffled join is left to Spark, whose adaptive execution
    splits skewed partitions of ``left``.
    """
    rows, size = right.agg(F.count("*"), F.coalesce(F.sum(width(right)), F.lit(0))).collect()[0]
    small = rows <= max_rows and size <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores, for work in Python that follows.

    Where a scan has enough partitions, as any large one has, it is returned as it is. Fewer mean a few
    small files; their rows are dealt out evenly, whatever their keys.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the place from 1 of each row in the order of ``column``, whose values are all different; no window spans the table.

    Rows are range-sorted and stored; each partition counts from where the ones before it end.
    """
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row within its partition
    rows = stored(df.repartitionByRange(column).sortWithinPartitions(column).withColumns({"_p": F.spark_partition_id(), "_i": low}), "ranked")
    begin, total = [], 0
    for r in sorted(rows.groupBy("_p").agg(F.count("*").alias("n")).collect()):  # one row a partition
        begin.append((r["_p"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(begin, "_p int, _begin long")
    return rows.join(F.broadcast(starts), "_p").withColumn(name, F.col("_begin") + F.col("_i") + 1).drop("_p", "_i", "_begin")
