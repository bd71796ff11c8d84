"""Queries of rules, scores and the remaining set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions.text import squeeze
from lodespark.operators import consensus, reports, rules
from lodespark.plans.catalog import CORE
from lodespark.plans.reference_graph import TREE_META, tree_meta
from lodespark.plans.reference_search import _RULES, _hits, _most, _pick
from lodespark.sources.tables import table

_TYPED = f"(select report_id, claim, {_pick} claim_type from (select *, {_most} m from (select report_id, claim, {_hits} from (select report_id, claim, lower(claim) t from claim_reports))))"
_case = lambda i: "case claim_type " + " ".join(f"when '{t}' then {w[i]}" for t, w in rules.CLAIM_WEIGHTS.items()) + " end"


@CORE.query(
    "claim_priority",
    f"select report_id, round((0.35 * {_case(0)} + 0.30 * {_case(1)} + 0.20 * case when length(claim) > 40 then 0.80 else 0.65 end + 0.15 * case when claim_type in ('security', 'feature_gap', 'validation') then 0.75 else 0.50 end)::double, 6) priority from {_TYPED}",
)
def claim_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Each claim's priority by its type."""
    c = table(spark, sf, "claim_reports", "report_id", "claim")
    return c.select("report_id", F.round(rules.claim_priority(consensus.best_label(F.col("claim")), F.col("claim")), 6).alias("priority"))


_qs = ", ".join(f"({n}, '{t}', {0.35 * i + 0.25 * u + 0.20 * r:.6f})" for n, (t, i, u, r) in enumerate(rules.QUESTIONS))


@CORE.query(
    "question_priority_topk",
    f"""with q as (select report_id, qtype, round((b + 0.20 * case when agent_role = 'security' then 0.25 else 1 end)::double, 6) priority, n from claim_reports, (values {_qs}) v(n, qtype, b) where claim is not null)
    select report_id, qtype, priority from (select *, row_number() over (partition by report_id order by priority desc, n) k from q) where k <= 2""",
)
def question_priority_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The two best questions of each claim."""
    c = table(spark, sf, "claim_reports", "report_id", "claim", "agent_role").where("claim is not null")
    novelty = F.when(F.col("agent_role") == "security", 0.25).otherwise(1.0)
    return rules.top_questions(c, novelty).select("report_id", "qtype", F.round("priority", 6).alias("priority"))


@CORE.query(
    "evidence_confidence",
    """select l_partkey, (case when f = 0 then 0.25 when a >= f then 0.45 when f >= 3 and a = 0 then 0.85 else 0.65 end)::double confidence
    from (select l_partkey, count(*) filter (l_returnflag <> 'R') f, count(*) filter (l_returnflag = 'R') a from lineitem group by 1)""",
)
def evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """A step function of evidence for and against."""
    against = F.col("l_returnflag") == "R"
    n = table(spark, sf, "lineitem", "l_partkey", "l_returnflag").groupBy("l_partkey").agg(F.count_if(~against).alias("f"), F.count_if(against).alias("a"))
    return n.select("l_partkey", rules.evidence_confidence(F.col("f"), F.col("a")).alias("confidence"))


_low = "lower(trim(claim, ' '))"


@CORE.query(
    "viable_claims",
    rf"select report_id from claim_reports where length({_low}) >= 24 and not starts_with({_low}, 'what ') and not contains({_low}, '?') and length(regexp_replace({_low}, '[a-z0-9_/.\-]', '', 'g')) <= length({_low}) * 0.4",
)
def viable_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that say something."""
    return table(spark, sf, "claim_reports", "report_id", "claim").where(rules.viable(F.col("claim"))).select("report_id")


@CORE.query("document_sentences")
def document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The first five different sentences of each document that could be claims."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(rules.sentences(F.col("text"))).alias("place", "sentence"))


_ONE = "(select distinct run_id, repo, tests_passed, safety_gates_passed, duration_seconds, patches_applied, findings_count, ts, errors from runs)"


@CORE.query(
    "gate_rollup",
    f"""select run_id, n = 3 passed, n::varchar || '/3 passed' summary from (select distinct run_id, coalesce(tests_passed::int, 0) + coalesce(safety_gates_passed::int, 0) + coalesce((duration_seconds < 600)::int, 0) n from {_ONE})""",
)
def gate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a run passed all gates."""
    r = table(spark, sf, "runs", "run_id", "tests_passed", "safety_gates_passed", "duration_seconds").distinct()
    ok, _, text = rules.gates([F.col("tests_passed"), F.col("safety_gates_passed"), F.col("duration_seconds") < 600])
    return r.select("run_id", ok.alias("passed"), text.alias("summary")).distinct()


@CORE.query("checkpoint_needed", f"select distinct run_id from {_ONE} where patches_applied > 0 or findings_count > 5 or not tests_passed")
def checkpoint_needed(spark: SparkSession, sf: str) -> DataFrame:
    """Runs after which a checkpoint is due."""
    r = table(spark, sf, "runs", "run_id", "patches_applied", "findings_count", "tests_passed")
    return r.where("patches_applied > 0 or findings_count > 5 or not tests_passed").select("run_id").distinct()


@CORE.query(
    "five_whys",
    "with c as (select distinct tree_id, case when contains(lower(issue), 'eval') then 'eval' when contains(lower(issue), 'os.system') then 'os.system' when contains(lower(issue), 'missing_docstring') then 'missing_docstring' else '' end k from fractal_trees where issue is not null) select tree_id, lvl as \"level\", conf::double confidence from c join (values "
    + ", ".join(f"('{n}', {i}, {c})" for n, cs in rules.WHY.items() for i, c in enumerate(cs, 1))
    + ") v(k, lvl, conf) using (k)",
)
def five_whys(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of whys of each finding."""
    f = table(spark, sf, "fractal_trees", "tree_id", "issue").where("issue is not null").distinct()
    return rules.why_chain(f, "issue").select("tree_id", "level", "confidence").distinct()


@CORE.query(
    "tree_actions",
    f"""select tree_id, aggregate, case when lower(severity) = 'critical' and aggregate > 0.7 then 'patch' when lower(severity) in ('critical', 'high') and aggregate > 0.5 then 'review' when aggregate < 0.3 then 'ignore' else 'escalate' end "action"
    from ({TREE_META}) join (select distinct tree_id, severity from fractal_trees) using (tree_id)""",
)
def tree_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What to do about each finding."""
    t = table(spark, sf, "fractal_trees", "tree_id", "severity").distinct()
    return tree_meta(spark, sf).join(t, "tree_id").select("tree_id", "aggregate", rules.tree_action(F.col("severity"), F.col("aggregate")).alias("action"))


@CORE.query(
    "adaptive_rate",
    """with l as (select user_id, list(case when value > 10 then 1.0::double else -1.0::double end order by ts, event_id)[5:] l from events where user_id is not null and value is not null group by 1)
    select user_id, len(l)::bigint n, round(list_reduce(list_prepend(1.0::double, l), lambda a, x: greatest(0.1, least(1.0, a * 0.95 + 0.05 * x))), 6) rate from l where len(l) > 0""",
)
def adaptive_rate(spark: SparkSession, sf: str) -> DataFrame:
    """each user's success rate as a clamped walk over events."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "value").withColumn("good", F.col("value") > 10)
    return rules.clamped_walk(e, "user_id", ["ts", "event_id"], "good").withColumn("rate", F.round("rate", 6))


_V = "select l_orderkey claim, case l_returnflag when 'A' then 'APPROVE' when 'R' then 'REJECT' else 'ABSTAIN' end verdict, l_discount * 10 confidence, l_quantity weight, case when l_linenumber = 1 then 'security_auditor' else 'other' end agent_role from lineitem"
_T = """select claim, count(*) n_votes, coalesce(sum(weight) filter (verdict = 'APPROVE'), 0) a_w, coalesce(sum(weight) filter (verdict = 'REJECT'), 0) r_w,
 bool_or(verdict = 'APPROVE' and agent_role = 'security_auditor') pa, bool_or(verdict = 'REJECT' and agent_role = 'security_auditor') pr, count(*) filter (verdict = 'APPROVE') a_n, count(*) filter (verdict = 'REJECT') r_n from {0} group by 1"""
_v = "case when n_votes < 2 then 'ABSTAIN' else " + _RULES["majority"][0] + " end"


@CORE.query(
    "debate_verdict",
    f"""with v as ({_V}), a as ({_T.format("v")}), h as (select claim, n_votes >= 2 and case {_v} when 'APPROVE' then r_n when 'REJECT' then a_n else a_n + r_n end > 0 and (pr and {_v} <> 'REJECT' or pa and {_v} <> 'APPROVE') heard from a),
    u as (select v.* replace (case when heard and verdict = 'APPROVE' and agent_role <> 'security_auditor' and greatest(0.1, confidence - 0.3) < 0.4 then 'ABSTAIN' else verdict end as verdict) from v join h using (claim)), b as ({_T.format("u")})
    select claim, {_v} verdict from b""",
)
def debate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict after dissent was heard."""
    verdict = F.when(F.col("l_returnflag") == "A", "APPROVE").when(F.col("l_returnflag") == "R", "REJECT").otherwise("ABSTAIN")
    v = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity").select(
        F.col("l_orderkey").alias("claim"), verdict.alias("verdict"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_quantity").alias("weight"), F.when(F.col("l_linenumber") == 1, "security_auditor").otherwise("other").alias("agent_role")
    )
    return consensus.decide(consensus.debate(v), "majority").select("claim", "verdict")


@CORE.query(
    "active_patches",
    """with p as (select distinct patch_id, repo, applied_at, promoted, reverted from patches), k as (select *, row_number() over (partition by repo order by applied_at desc, patch_id desc) i from p where not coalesce(reverted, false))
    select p.repo, count(*) total, count(*) filter (reverted) reverted, count(*) filter (promoted) promoted, max(k.patch_id) latest from p left join (select repo, patch_id from k where i = 1) k on p.repo = k.repo group by 1""",
)
def active_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches by state and the latest that was not reverted."""
    p = table(spark, sf, "patches", "patch_id", "repo", "applied_at", "promoted", "reverted").dropDuplicates(["patch_id"])
    live = ~F.coalesce("reverted", F.lit(False))
    return p.groupBy("repo").agg(
        F.count("*").alias("total"), F.count_if("reverted").alias("reverted"), F.count_if("promoted").alias("promoted"), F.max_by("patch_id", F.when(live, F.struct("applied_at", "patch_id"))).alias("latest")
    ).where("repo is not null")


@CORE.query("patched_findings", "select distinct tree_id from fractal_trees t where line is not null and exists (select 1 from patches p where lower(p.issue) = lower(t.issue) and p.run_id = t.run_id)")
def patched_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Located findings for whose issue the same run made a patch."""
    t = table(spark, sf, "fractal_trees", "tree_id", "run_id", "issue", "line").where("line is not null").withColumn("issue", F.lower("issue"))
    p = table(spark, sf, "patches", "run_id", F.lower("issue").alias("issue")).distinct()
    return t.join(p, ["run_id", "issue"], "left_semi").select("tree_id").distinct()


@CORE.query("topic_stats", "select count(distinct event_type) topics, count(distinct (event_type, user_id)) subscriptions, count(*) messages from events")
def topic_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Topics, subscriptions and messages."""
    e = table(spark, sf, "events", "event_type", "user_id").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return e.agg(F.countDistinct("event_type").alias("topics"), F.count("*").alias("subscriptions"), F.sum("n").alias("messages"))


@CORE.query(
    "missing_phases",
    """select run_id, p phase from (select run_id, list_distinct(list(phase)) l from traces where run_id is not null group by 1), (select unnest(['validate', 'consensus', 'orchestrator', 'error']) p) where not list_contains(l, p)""",
)
def missing_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Phases that a run must show and does not."""
    seen = table(spark, sf, "traces", "run_id", "phase").where("run_id is not null").groupBy("run_id").agg(F.collect_set("phase").alias("l"))
    need = F.array(*map(F.lit, ("validate", "consensus", "orchestrator", "error")))
    return seen.select("run_id", F.explode(F.array_except(need, "l")).alias("phase"))


@CORE.query(
    "metadata_merge",
    """with t as (select distinct on (trace_id) trace_id, run_id, ts, metadata from traces where run_id is not null and trace_id is not null), e as (select run_id, ts, trace_id, unnest(map_entries(metadata)) e from t)
    select run_id, e."key" k, arg_max(e."value", (ts, trace_id)) v from e group by all""",
)
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    """U8: a run's metadata, the last value of each key."""
    t = table(spark, sf, "traces", "trace_id", "run_id", "ts", "metadata").where("run_id is not null and trace_id is not null").dropDuplicates(["trace_id"])
    e = t.select("run_id", "ts", "trace_id", F.explode("metadata").alias("k", "v"))
    return e.groupBy("run_id", "k").agg(F.max_by("v", F.struct("ts", "trace_id")).alias("v"))


@CORE.query("claim_text", r"select distinct tree_id, coalesce(severity, 'info') || ' severity: ' || coalesce(issue, '') || ' in ' || coalesce(file, 'unknown') claim, (case lower(severity) when 'critical' then 0.95 when 'high' then 0.85 when 'medium' then 0.7 else 0.5 end)::double confidence from fractal_trees")
def claim_text(spark: SparkSession, sf: str) -> DataFrame:
    """Findings as claims with a confidence by severity."""
    t = table(spark, sf, "fractal_trees", "tree_id", "severity", "issue", "file")
    text = F.concat(F.coalesce("severity", F.lit("info")), F.lit(" severity: "), F.coalesce("issue", F.lit("")), F.lit(" in "), F.coalesce("file", F.lit("unknown")))
    s = F.lower("severity")
    conf = F.when(s == "critical", 0.95).when(s == "high", 0.85).when(s == "medium", 0.7).otherwise(0.5)
    return t.select("tree_id", text.alias("claim"), conf.alias("confidence")).distinct()


@CORE.query("claim_hash", r"select report_id, substr(sha256(trim(regexp_replace(claim, '\s+', ' ', 'g'), ' ')), 1, 16) hash from claim_reports where claim is not null")
def claim_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A short hash of each claim with single blanks."""
    return table(spark, sf, "claim_reports", "report_id", "claim").where("claim is not null").select("report_id", F.substring(F.sha2(squeeze("claim"), 256), 1, 16).alias("hash"))


@CORE.query("evict_by_size", "select doc_id from (select doc_id, sum(length(text)) over (partition by source order by doc_id desc) s from documents where text is not null) where s <= 20000")
def evict_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """The newest documents of each source whose texts together fit a size."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents", "doc_id", "source", "text").where("text is not null").select("doc_id", "source", F.length("text").alias("n"))
    return d.withColumn("s", F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0))).where("s <= 20000").select("doc_id")


@CORE.query("warning_search", "select distinct run_id from runs where contains(lower(goal), 'patch') or len(list_filter(warnings, lambda w: contains(lower(w), 'slow'))) > 0 or len(list_filter(errors, lambda w: contains(lower(w), 'timeout'))) > 0")
def warning_search(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose goal, warnings or errors contain a word."""
    has = lambda c, w: F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), F.lit(w))), F.lit(False))
    r = table(spark, sf, "runs", "run_id", "goal", "warnings", "errors")
    return r.where(F.coalesce(F.contains(F.lower("goal"), F.lit("patch")), F.lit(False)) | has("warnings", "slow") | has("errors", "timeout")).select("run_id").distinct()


@CORE.query("html_rows", "select distinct tree_id, '<tr><td>' || replace(replace(replace(coalesce(issue, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || coalesce(severity, '') || '</td></tr>' line from fractal_trees")
def html_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Findings as rows of an HTML table."""
    return table(spark, sf, "fractal_trees", "tree_id", "issue", "severity").select("tree_id", reports.html_row([F.col("issue"), F.col("severity")]).alias("line")).distinct()
