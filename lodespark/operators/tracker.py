"""Tracking keys across runs in closed form, and two-state merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.joins import lookup, ranked


def track(presence: DataFrame, key: str, run: str) -> DataFrame:
    """key, run_count, first_run, last_run, status over the runs in which a key is present.

    Status is ``open`` for a key first seen in the last run, ``still_open`` if present in every run
    since its first, else ``potentially_resolved``, for good. Presence counts once a run. Only counts and extremes
    of run ordinals are aggregated, which combines before the shuffle; runs are numbered over the few
    different ones. Null keys and runs are left out.
    """
    seen = presence.where(F.col(key).isNotNull() & F.col(run).isNotNull()).select(key, run).distinct()
    runs = ranked(seen.select(run).distinct(), run, "ord")
    last = runs.agg(F.max("ord")).collect()[0][0] or 0
    ordered = lookup(seen, runs, [run], "inner")
    t = ordered.groupBy(key).agg(F.count("*").alias("run_count"), F.min("ord").alias("first_ord"), F.min(run).alias("first_run"), F.max(run).alias("last_run"))
    status = F.when(F.col("run_count") == F.lit(last) - F.col("first_ord") + 1, F.when(F.col("run_count") == 1, "open").otherwise("still_open")).otherwise("potentially_resolved")
    return t.select(key, "run_count", "first_run", "last_run", status.alias("status"))


def merge(previous: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, status, run_count after one more run: the full outer merge of a state (key, status, run_count) with the keys present.

    Open keys that are present stay open and count one run more; absent ones may be resolved; any
    other status stays.
    """
    p, n = previous.withColumn("_was", F.lit(True)), present.select(key).distinct().withColumn("_is", F.lit(True))
    j = p.join(n, key, "full_outer")
    live = F.col("status").isin("open", "still_open")
    status = F.when(F.col("_was").isNull(), "open").when(live & F.col("_is").isNotNull(), "still_open").when(live, "potentially_resolved").otherwise(F.col("status"))
    count = F.coalesce("run_count", F.lit(0)) + F.when(F.col("_is").isNotNull(), 1).otherwise(0)
    return j.select(key, status.alias("status"), count.cast("long").alias("run_count"))


def keep_most(tracked: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with most runs; of equals those first seen first, then by key. Each task keeps its own n."""
    return tracked.orderBy(F.desc("run_count"), "first_run", key).limit(n)


def keep_latest(tracked: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with most runs; of equals those seen last, then by key descending: the order of the store that keeps 500."""
    return tracked.orderBy(F.desc("run_count"), F.desc("last_run"), F.desc(key)).limit(n)


def union_by_precedence(stores: list[DataFrame], norm_key: str) -> DataFrame:
    """Rows of several stores, one for each norm_key: from the first store that has it."""
    out = None
    for i, s in enumerate(stores):
        part = s.withColumn("_store", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(norm_key).orderBy("_store", *[c for c in stores[0].columns if c != norm_key])
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_store")
