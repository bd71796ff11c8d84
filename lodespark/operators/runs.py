"""Runs compared with each other, and what their traces show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_runs(runs: DataFrame) -> DataFrame:
    """Each run_id once; of differing rows the one loaded last."""
    rest = [c for c in runs.columns if c != "run_id"]
    return runs.where("run_id is not null").groupBy("run_id").agg(F.max_by(F.struct(*rest), "loaded_at").alias("r")).select("run_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def last_runs(runs: DataFrame, n: int, per: str = "repo") -> DataFrame:
    """The last n runs of each repo by time."""
    w = Window.partitionBy(per).orderBy(F.desc("ts"), F.desc("run_id"))
    return runs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def compare(runs: DataFrame, per: str = "repo") -> DataFrame:
    """Totals, mean duration and pass rates of each repo's runs; rates in percent with one decimal."""
    rate = lambda c: F.round(F.count_if(F.col(c)) * 100.0 / F.count("*"), 1)
    return runs.groupBy(per).agg(
        F.count("*").alias("n_runs"),
        F.sum("findings_count").alias("findings"),
        F.sum("patches_applied").alias("applied"),
        F.sum("patches_blocked").alias("blocked"),
        F.round(F.avg("duration_seconds") + 1e-9, 2).alias("avg_duration"),
        rate("tests_passed").alias("tests_rate"),
        rate("safety_gates_passed").alias("gates_rate"),
    )


def trend(runs: DataFrame, value: str, per: str = "repo") -> DataFrame:
    """per, trend: the sums of the first half of the runs (n div 2) and of the rest: increasing, decreasing, stable; insufficient below two."""
    w = Window.partitionBy(per).orderBy("ts", "run_id")
    counted = runs.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(per)))
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    v = F.coalesce(value, F.lit(0))
    s = counted.groupBy(per).agg(F.max("_n").alias("_n"), F.sum(F.when(early, v).otherwise(0)).alias("_a"), F.sum(F.when(early, 0).otherwise(v)).alias("_b"))
    label = F.when(F.col("_n") < 2, "insufficient_data").when(F.col("_b") > F.col("_a"), "increasing").when(F.col("_b") < F.col("_a"), "decreasing").otherwise("stable")
    return s.select(per, label.alias("trend"))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def widest_gap(rows: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """key, n, max_gap_s of keys with a pause of more than ``seconds`` between rows in order."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = (micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)) / 1e6
    g = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_g", gap).groupBy(key).agg(F.count("*").alias("n"), F.max("_g").alias("max_gap_s"))
    return g.where(F.col("max_gap_s") > seconds)


def loops(rows: DataFrame, key: str, phase: str, ts: str, tie: str, last: int = 10, most: int = 2) -> DataFrame:
    """key, phases of keys with at least ``last`` rows whose last ones show at most ``most`` different phases."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    recent = rows.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last)
    g = recent.groupBy(key).agg(F.countDistinct(phase).alias("phases"), F.count("*").alias("_n"))
    return g.where((F.col("_n") == last) & (F.col("phases") <= most)).select(key, "phases")


def call_edges(traces: DataFrame, enter: str = "call_enter", leave: tuple[str, ...] = ("call_exit", "call_error")) -> DataFrame:
    """caller, callee, calls: who was entered while whom was open, by the depth of the stack at each entry.

    An entry at depth d belongs to the last entry at depth d - 1 before it in the same run. Entries are
    matched per run and depth pair, so a run with many traces is split by depth.
    """
    calls = traces.where((F.col("phase") == enter) & F.col("run_id").isNotNull() & F.col("function_name").isNotNull() & F.col("stack_depth").isNotNull())
    calls = calls.select("trace_id", "run_id", "ts", "function_name", "stack_depth").dropDuplicates(["trace_id"])
    own = calls.withColumn("level", F.col("stack_depth") - 1).withColumn("opens", F.lit(False))
    up = calls.withColumn("level", F.col("stack_depth")).withColumn("opens", F.lit(True))
    w = Window.partitionBy("run_id", "level").orderBy("ts", "trace_id", "opens").rowsBetween(Window.unboundedPreceding, -1)
    caller = F.last(F.when(F.col("opens"), F.col("function_name")), ignorenulls=True).over(w)
    edges = own.unionByName(up).withColumn("caller", caller).where("not opens and caller is not null")
    return edges.groupBy("caller", F.col("function_name").alias("callee")).agg(F.count("*").alias("calls"))


def profile_calls(records: DataFrame, top: int = 20) -> DataFrame:
    """The functions with most time: calls, total, mean, extremes. Repeated records count once."""
    once = records.where("function_name is not null").dropDuplicates(["record_id"])
    g = once.groupBy("function_name").agg(
        F.sum("call_count").alias("calls"), F.sum("total_time_ms").alias("_t"), F.max("max_time_ms").alias("max_ms"), F.min("min_time_ms").alias("min_ms")
    )
    return g.orderBy(F.desc(F.round("_t", 3)), "function_name").limit(top).select("function_name", "calls", F.round("_t", 3).alias("total_ms"), F.round(F.col("_t") / F.nullif(F.col("calls"), F.lit(0)), 3).alias("avg_ms"), "max_ms", "min_ms")
