"""Tracker, feedback, run and trace queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import feedback, runs, tracker
from lodespark.plans.catalog import CORE
from lodespark.sources.tables import table

NOW = "2024-02-01 00:00:00"


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "user_id", "ts", "event_type").where("event_type = 'error'").withColumn("day", F.to_date("ts"))


_TRACK = """with p as (select distinct user_id, ts::date d from events where event_type = 'error' and user_id is not null and ts is not null),
 r as (select d, row_number() over (order by d) o from (select distinct d from p)),
 t as (select user_id, count(*) run_count, min(o) fo, min(d) first_run, max(d) last_run from p join r using (d) group by 1),
 s as (select user_id, run_count, first_run, last_run, case when run_count = (select max(o) from r) - fo + 1 then case when run_count = 1 then 'open' else 'still_open' end else 'potentially_resolved' end status from t) """


@CORE.query("tracker_status", _TRACK + "select user_id, run_count, first_run::varchar first_run, last_run::varchar last_run, status from s")
def tracker_status(spark: SparkSession, sf: str) -> DataFrame:
    """each user's errors tracked over days."""
    t = tracker.track(_errors(spark, sf), "user_id", "day")
    return t.withColumns({c: F.col(c).cast("string") for c in ("first_run", "last_run")})


@CORE.query("persistent_findings", _TRACK + "select user_id, run_count from s where run_count >= 3")
def persistent_findings(spark: SparkSession, sf: str) -> DataFrame:
    """keys present in at least three runs."""
    return tracker.track(_errors(spark, sf), "user_id", "day").where("run_count >= 3").select("user_id", "run_count")


@CORE.query("tracker_cap", _TRACK + "select user_id, run_count, first_run::varchar first_run from s order by run_count desc, s.first_run, user_id limit 50")
def tracker_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty keys with most runs."""
    kept = tracker.keep_most(tracker.track(_errors(spark, sf), "user_id", "day"), "user_id", 50)
    return kept.select("user_id", "run_count", F.col("first_run").cast("string").alias("first_run"))


@CORE.query(
    "tracker_two_run_merge",
    """with a as (select user_id, count(*) run_count from events where event_type = 'error' and ts < '2024-01-15' group by 1), b as (select distinct user_id from events where event_type = 'error' and ts >= '2024-01-15')
    select coalesce(a.user_id, b.user_id) user_id, case when a.user_id is null then 'open' when b.user_id is not null then 'still_open' else 'potentially_resolved' end status,
    (coalesce(a.run_count, 0) + (b.user_id is not null)::int)::bigint run_count from a full join b on a.user_id = b.user_id""",
)
def tracker_two_run_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A state merged with the keys of one more run."""
    e = _errors(spark, sf)
    before = e.where("ts < '2024-01-15'").groupBy("user_id").agg(F.count("*").alias("run_count")).withColumn("status", F.lit("open"))
    return tracker.merge(before, e.where("ts >= '2024-01-15'"), "user_id")


@CORE.query(
    "union_precedence",
    r"""with u as (select 0 s, claim, branch, confidence from claim_updates union all select 1, claim, branch, confidence from claim_snapshots),
    n as (select *, lower(regexp_replace(claim, '^\s+|\s+$', '', 'g')) k from u where claim is not null)
    select k claim_key, min(s) store, count(*) copies from n where k <> '' group by 1""",
)
def union_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each claim of two stores, from the first that has it."""
    from lodespark.functions.text import norm

    a = table(spark, sf, "claim_updates", "claim").withColumn("store", F.lit(0))
    b = table(spark, sf, "claim_snapshots", "claim").withColumn("store", F.lit(1))
    keyed = a.unionByName(b).withColumn("claim_key", norm("claim")).where("claim_key is not null and claim_key != ''")
    return keyed.groupBy("claim_key").agg(F.min("store").alias("store"), F.count("*").alias("copies"))


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("value") > 50, 1.0).when(F.col("value") < 10, -0.5).otherwise(0.0)
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("score", score).withColumn("node_key", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))


_FB = "(select *, case when value > 50 then 1.0::double when value < 10 then -0.5::double else 0.0::double end score, event_type || ':' || user_id node_key from events)"


@CORE.query(
    "decay_weighted_mean",
    f"""select event_type, round(sum(score * power(0.5, d / 30.0)) / sum(power(0.5, d / 30.0)), 6) wavg, sum(score * power(0.5, d / 30.0)) / sum(power(0.5, d / 30.0)) < -0.2 skip
    from (select *, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 86400000000.0 d from {_FB}) group by 1""",
)
def decay_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Half-life weighted mean of feedback at a given moment."""
    days = (F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp")) - runs.micros(F.col("ts"))) / 86_400e6
    m = _feedback(spark, sf).groupBy("event_type").agg(feedback.decayed_mean(F.col("score"), days).alias("m"))
    return m.select("event_type", F.round("m", 6).alias("wavg"), (F.col("m") < -0.2).alias("skip"))


@CORE.query(
    "ema_confidence",
    "select user_id, count(*) n, round(list_reduce(list_prepend(0.5::double, list((value > 10)::int::double order by ts, event_id)), lambda a, x: 0.7 * a + 0.3 * x), 6) ema from events where value is not null and user_id is not null group by 1",
)
def ema_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """exponential moving average of success in order of time."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "value").withColumn("x", (F.col("value") > 10).cast("double"))
    return feedback.moving_average(e, "user_id", ["ts", "event_id"], "x").withColumn("ema", F.round("ema", 6))


@CORE.query("confidence_update", f"select event_id, round(greatest(0, least(1, value / 100 * 0.7 + score * 0.3)), 6)::double confidence from {_FB}")
def confidence_update(spark: SparkSession, sf: str) -> DataFrame:
    """one feedback step on a confidence."""
    return _feedback(spark, sf).select("event_id", F.round(feedback.updated_confidence(F.col("value") / 100, F.col("score")), 6).alias("confidence"))


@CORE.query("feedback_stats", f"select node_key, count(*) n, round(avg(score), 6) mean from {_FB} group by 1 order by n desc, node_key limit 10")
def feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The ten keys with most feedback."""
    return _feedback(spark, sf).groupBy("node_key").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean")).orderBy(F.desc("n"), "node_key").limit(10)


@CORE.query(
    "reflection_rates",
    f"select count(*) total, round(count(*) filter (score > 0) / count(*), 6) success_rate, round(count(*) filter (score < 0) / count(*), 6) false_positive_rate, count(distinct ts::date) as days from {_FB}",
)
def reflection_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Success and failure rates over all feedback."""
    return feedback.reflection(_feedback(spark, sf), "node_key", "score", "ts")[0]


@CORE.query(
    "reflection_worst",
    f"select node_key, round(m, 2) average_feedback, n occurrences from (select node_key, avg(score) m, count(*) n from {_FB} group by 1 order by m, node_key limit 5) where m < 0",
)
def reflection_worst(spark: SparkSession, sf: str) -> DataFrame:
    """The worst keys by mean feedback."""
    return feedback.reflection(_feedback(spark, sf), "node_key", "score", "ts")[1]


@CORE.query("learning_policy", f"select split_part(node_key, ':', 1) issue_type, count(*) n, case when avg(score) > 0.4 then 'boost' when avg(score) < -0.4 then 'skip' else 'keep' end \"action\" from {_FB} group by 1 having count(*) >= 3")
def learning_policy(spark: SparkSession, sf: str) -> DataFrame:
    """What feedback teaches about each type."""
    return feedback.learned(_feedback(spark, sf), "node_key", "score")


@CORE.query(
    "window_dedup_300s",
    """with recursive o as (select event_id, coalesce('=' || user_id, '-') || chr(31) || coalesce('=' || event_type, '-') g, epoch_us(ts) us,
      row_number() over (partition by user_id, event_type order by ts, event_id) k from events where ts is not null),
    f as (select g, us, min(k) k from o group by all),
    n as (select o.event_id, o.g, o.k, f.k nxt from o asof left join f on o.g = f.g and o.us + 300000000 < f.us),
    w(event_id, g, nxt) as (select event_id, g, nxt from n where k = 1 union all select n.event_id, n.g, n.nxt from w join n on n.g = w.g and n.k = w.nxt)
    select event_id from w union all select event_id from events where ts is null""",
)
def window_dedup_300s(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each burst of equal events."""
    return feedback.within_seconds(table(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "event_id").select("event_id")


@CORE.query("keep_first", "select user_id, event_type, arg_min(event_id, (ts, event_id)) event_id from events group by all")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and type."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    return feedback.first_of(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@CORE.query("last_n_per_key", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 50")
def last_n_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The last fifty events of each user."""
    return feedback.last_n(table(spark, sf, "events", "event_id", "ts", "user_id"), ["user_id"], ["ts", "event_id"], 50).select("user_id", "event_id")


_RUNS = "(select * from (select *, row_number() over (partition by run_id order by loaded_at desc) k from runs where run_id is not null) where k = 1)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.distinct_runs(table(spark, sf, "runs"))


@CORE.query(
    "run_compare",
    f"""select repo, count(*) n_runs, sum(findings_count)::bigint findings, sum(patches_applied)::bigint applied, sum(patches_blocked)::bigint blocked, round(avg(duration_seconds) + 1e-9, 2) avg_duration,
    round(count(*) filter (tests_passed) * 100.0::double / count(*), 1) tests_rate, round(count(*) filter (safety_gates_passed) * 100.0::double / count(*), 1) gates_rate from {_RUNS} group by 1""",
)
def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Each repo's runs summed up."""
    return runs.compare(_runs(spark, sf))


@CORE.query("recent_runs", f"select repo, run_id from (select *, row_number() over (partition by repo order by ts desc, run_id desc) j from {_RUNS}) where j <= 25")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The last 25 runs of each repo."""
    return runs.last_runs(_runs(spark, sf), 25).select("repo", "run_id")


@CORE.query(
    "run_trend",
    f"""with c as (select repo, coalesce(patches_applied, 0) v, row_number() over (partition by repo order by ts, run_id) i, count(*) over (partition by repo) n from {_RUNS}),
    s as (select repo, max(n) n, sum(case when i <= n // 2 then v else 0 end) a, sum(case when i <= n // 2 then 0 else v end) b from c group by 1)
    select repo, case when n < 2 then 'insufficient_data' when b > a then 'increasing' when b < a then 'decreasing' else 'stable' end trend from s""",
)
def run_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Whether later runs apply more patches."""
    return runs.trend(_runs(spark, sf), "patches_applied")


@CORE.query("runs_per_mode", rf"select lower(trim(run_mode, ' ')) mode, count(*) n, round(avg(duration_seconds) + 1e-9, 2) avg_duration from {_RUNS} group by 1")
def runs_per_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and mean duration by mode."""
    return _runs(spark, sf).groupBy(F.lower(F.trim("run_mode")).alias("mode")).agg(F.count("*").alias("n"), F.round(F.avg("duration_seconds") + 1e-9, 2).alias("avg_duration"))


@CORE.query("run_messages", f"select repo, sum(coalesce(len(errors), 0))::bigint errors, sum(coalesce(len(warnings), 0))::bigint warnings from {_RUNS} group by 1")
def run_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and warnings by repo."""
    n = lambda c: F.sum(F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))).cast("long").alias(c)
    return _runs(spark, sf).groupBy("repo").agg(n("errors"), n("warnings"))


_ONE_TRACE = "(select * from (select *, row_number() over (partition by trace_id order by received_at) k from traces where trace_id is not null) where k = 1)"


@CORE.query(
    "gap_detect",
    """with g as (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6 g from events where user_id is not null and ts is not null)
    select user_id, count(*) n, max(g) max_gap_s from g group by 1 having max(g) > 30""",
)
def gap_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Users with a pause of more than 30 seconds."""
    return runs.widest_gap(table(spark, sf, "events", "event_id", "ts", "user_id"), "user_id", "ts", "event_id", 30)


@CORE.query(
    "loop_detect",
    """select run_id, count(distinct phase) phases from (select *, row_number() over (partition by run_id order by ts desc, trace_id desc) j from (select distinct trace_id, run_id, phase, ts from traces where run_id is not null)) where j <= 10
    group by 1 having count(*) = 10 and count(distinct phase) <= 2""",
)
def loop_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose last ten traces show few phases."""
    t = table(spark, sf, "traces", "trace_id", "run_id", "phase", "ts").distinct()
    return runs.loops(t, "run_id", "phase", "ts", "trace_id", most=2)


@CORE.query(
    "call_stack_edges",
    """with c as (select distinct trace_id, run_id, ts, function_name f, stack_depth d from traces where phase = 'call_enter' and run_id is not null and function_name is not null and stack_depth is not null),
    u as (select trace_id, run_id, ts, f, d - 1 l, false o from c union all select trace_id, run_id, ts, f, d, true from c),
    e as (select f callee, o, last_value(case when o then f end ignore nulls) over (partition by run_id, l order by ts, trace_id, o rows between unbounded preceding and 1 preceding) caller from u)
    select caller, callee, count(*) calls from e where not o and caller is not null group by all""",
)
def call_stack_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Caller and callee pairs rebuilt from the stack depths of entries."""
    return runs.call_edges(table(spark, sf, "traces", "trace_id", "run_id", "phase", "ts", "function_name", "stack_depth"))


@CORE.query(
    "profile_calls",
    """with o as (select * from (select *, row_number() over (partition by record_id) k from perf_records where function_name is not null) where k = 1),
    g as (select function_name, sum(call_count)::bigint calls, sum(total_time_ms) t, max(max_time_ms) max_ms, min(min_time_ms) min_ms from o group by 1)
    select function_name, calls, round(t, 3) total_ms, round(t / nullif(calls, 0), 3) avg_ms, max_ms, min_ms from g order by round(t, 3) desc, function_name limit 20""",
)
def profile_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty functions with most time."""
    return runs.profile_calls(table(spark, sf, "perf_records"))


@CORE.query("phase_histogram", f"select phase, count(*) n, round(sum(duration_ms) filter (not isnan(duration_ms) and duration_ms >= 0), 2) total_ms from {_ONE_TRACE} group by 1")
def phase_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Traces and time by phase, each trace once."""
    t = table(spark, sf, "traces", "trace_id", "phase", "duration_ms").where("trace_id is not null").groupBy("trace_id").agg(F.min("phase").alias("phase"), F.max("duration_ms").alias("d"))
    good = F.when(~F.isnan("d") & (F.col("d") >= 0), F.col("d"))
    return t.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum(good), 2).alias("total_ms"))


@CORE.query(
    "anomaly_rules",
    """select run_id, count(*) > 10 many_claims, count(distinct branch) > 5 many_branches, coalesce(max(c) > 2, false) repeated
    from (select run_id, branch, count(claim) over (partition by run_id, claim) c from claim_reports) group by 1 having many_claims or many_branches or repeated""",
)
def anomaly_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with too many claims, branches or repeats."""
    c = table(spark, sf, "claim_reports", "run_id", "claim", "branch")
    most = c.where("claim is not null").groupBy("run_id", "claim").agg(F.count("*").alias("c")).groupBy("run_id").agg(F.max("c").alias("c"))
    g = c.groupBy("run_id").agg((F.count("*") > 10).alias("many_claims"), (F.countDistinct("branch") > 5).alias("many_branches")).withColumn("_r", F.coalesce("run_id", F.lit("")))
    g = g.join(most.withColumn("_r", F.coalesce("run_id", F.lit(""))).select("_r", "c"), "_r", "left").select("run_id", "many_claims", "many_branches", F.coalesce(F.col("c") > 2, F.lit(False)).alias("repeated"))
    return g.where("many_claims or many_branches or repeated")
