"""Queries of scores and classes, and small set operations of reports and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions.text import squeeze
from lodespark.operators import consensus, dewey, scores, tracker
from lodespark.plans.catalog import CORE
from lodespark.plans.reference_runs import _TRACK, _errors
from lodespark.plans.reference_search import panel_vote
from lodespark.plans.training_data import _P1_WITH
from lodespark.sources.tables import table


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({text}, '')), {_q(w)})" for w in words) + ")"


_CLAIMS = "(select report_id, claim, confidence, branch from claim_reports)"


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claim_reports", "report_id", "claim", "confidence", "branch")


_NODES = (
    _P1_WITH.rstrip()
    + """, c as (select tree_id, regexp_replace(path, '\\.?[0-9]+$', '') path, count(*) q from (select distinct tree_id, path from n) group by all),
v as (select tree_id, path, count(*) filter (not coalesce(try_cast(v->>'contradicts' as boolean), false)) f, count(*) filter (coalesce(try_cast(v->>'contradicts' as boolean), false)) a
  from (select distinct tree_id, path, i, case when json_type(v) = 'OBJECT' then v::varchar else '{}' end::json v from e where json_type(v) <> 'NULL') group by all),
o as (select distinct n.tree_id, n.path, try_cast(j->>'confidence' as double) confidence, (j->>'rebuttal') is not null r, coalesce(f, 0) f, coalesce(a, 0) a, coalesce(q, 0) q from n left join v on v.tree_id = n.tree_id and v.path = n.path left join c on c.tree_id = n.tree_id and c.path = n.path) """
)


def _scored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with how much speaks for and against them, whether they have a rebuttal, and their number of children."""
    from lodespark.storage import stored

    labelled = stored(dewey.label_trees(table(spark, sf, "fractal_trees", "tree_id", "tree")), "labelled")
    nodes = dewey.node_table(labelled).select("tree_id", "node_path", "parent_path", "confidence", F.col("rebuttal").isNotNull().alias("has_rebuttal"))
    bad = F.coalesce("contradicts", F.lit(False))
    evidence = dewey.evidence_table(labelled).groupBy("tree_id", "node_path").agg(F.count_if(~bad).alias("n_for"), F.count_if(bad).alias("n_against"))
    kids = nodes.groupBy("tree_id", F.col("parent_path").alias("node_path")).agg(F.count("*").alias("n_questions"))
    return nodes.join(evidence, ["tree_id", "node_path"], "left").join(kids, ["tree_id", "node_path"], "left").fillna(0, ["n_for", "n_against", "n_questions"])


@CORE.query(
    "node_quality",
    _NODES
    + """select tree_id, path node_path, round((0.35 + case when f > 0 then 0.2 else 0 end + case when a > 0 then 0.15 else 0 end + case when r then 0.1 else 0 end + case when q >= 4 then 0.1 else 0 end)::double, 6) quality,
  round((case when f = 0 then case when confidence is not null then least(confidence, 0.3) end else confidence end)::double, 6) confidence from o""",
)
def node_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of each node, and its confidence, capped where nothing supports it."""
    n = _scored_nodes(spark, sf)
    q = scores.quality(F.col("n_for"), F.col("n_against"), F.col("has_rebuttal").cast("int"), F.col("n_questions"))
    return n.select("tree_id", "node_path", F.round(q, 6).alias("quality"), F.round(scores.supported_confidence(F.col("confidence"), F.col("n_for")), 6).alias("confidence"))


@CORE.query(
    "node_corrections",
    _NODES + "select tree_id, path node_path, case when len(string_split(path, '.')) > 4 then 'budget_halt' when a < 1 and f > 0 then 'seek_counter_evidence' when coalesce(confidence, 0) < 0.6 then 'expand_deeper' else 'none' end \"action\" from o",
)
def node_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """What is to be done about each node, with a budget of four levels."""
    n = _scored_nodes(spark, sf)
    left = F.lit(5) - F.size(F.split("node_path", r"\."))
    return n.select("tree_id", "node_path", scores.correction(F.lit(None).cast("string"), F.col("confidence"), F.col("n_for"), F.col("n_against"), left).alias("action"))


@CORE.query(
    "claim_risk",
    f"""select report_id, round(least(0.35 + case when {_any("claim", scores.RISKY_SUBJECTS)} then 0.2 else 0 end + case when coalesce(confidence < 0.5, false) then 0.1 else 0 end + case when confidence is null then 0.2 else 0 end, 0.95)::double, 6) risk,
    case when {_any("claim", scores.BLOCKED)} then 0.0 else 0.95 end::double security from {_CLAIMS}""",
)
def claim_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk and security of each claim; a low confidence stands for counter-evidence, a missing one for no support."""
    c = _claims(spark, sf)
    risk = scores.claim_risk(F.col("claim"), F.col("confidence") < 0.5, F.col("confidence").isNull())
    return c.select("report_id", F.round(risk, 6).alias("risk"), scores.security(F.col("claim")).alias("security"))


@CORE.query(
    "stop_reasons",
    f"""select report_id, case when d >= 4 then 'max_depth' end stop_before, case when {_any("claim", scores.BLOCKED)} then 'low_security' when coalesce(confidence, 0) < 0.6 then 'low_quality' end stop_after
    from (select *, len(string_split(branch, '.')) d from {_CLAIMS})""",
)
def stop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a claim's branch ends before or after it is scored; its confidence stands for quality."""
    no, depth = F.lit(False), F.size(F.split("branch", r"\."))
    after = scores.stop_after(scores.security(F.col("claim")), F.coalesce("confidence", F.lit(0.0)), F.lit(1.0))
    return _claims(spark, sf).select("report_id", scores.stop_before(no, depth, no, 4).alias("stop_before"), after.alias("stop_after"))


@CORE.query(
    "failure_classes",
    """select distinct run_id, case when not coalesce(patches_applied > 0 or patches_blocked = 0, true) then 'patch_apply_failure' when not coalesce(tests_passed, true) then 'test_failure'
    when not coalesce(safety_gates_passed, true) then 'patch_scope_failure' when not coalesce(patches_blocked = 0, true) then 'sensitive_edit' else 'no_failure_detected' end failure from runs""",
)
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of each run's verification that failed."""
    r = table(spark, sf, "runs", "run_id", "patches_applied", "patches_blocked", "tests_passed", "safety_gates_passed")
    blocked = F.col("patches_blocked") == 0
    return r.select("run_id", scores.failure_class((F.col("patches_applied") > 0) | blocked, F.col("tests_passed"), F.col("safety_gates_passed"), blocked).alias("failure")).distinct()


_ERROR = r"regexp_extract(e, '^(\w+(?:Error|Exception))', 1)"


@CORE.query(
    "error_classes",
    f"""select class, count(*) n from (select case when n in ('ValueError', 'TypeError', 'AssertionError', 'KeyError') then 'validation' when n in ('ConnectionError', 'TimeoutError', 'OSError') then 'network'
      when contains(lower(n), 'patch') or contains(e, ' Patch') then 'patch' when contains(lower(e), 'timeout') then 'timeout' else 'unknown' end class
    from (select e, {_ERROR} n from (select unnest(errors) e from (select distinct run_id, errors from runs)) where e is not null)) group by 1""",
)
def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    """P25: errors of all runs by class."""
    e = table(spark, sf, "runs", "run_id", "errors").distinct().select(F.explode("errors").alias("e")).where("e is not null")
    name = F.regexp_extract("e", r"^(\w+(?:Error|Exception))", 1)
    return e.select(scores.error_class(name, F.col("e")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


_WORDS = r"case when trim(regexp_replace(coalesce(claim, ''), '\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(claim, '\s+', ' ', 'g')), ' ')) end"


@CORE.query(
    "reflected_claims",
    f"""select report_id, round(v, 6) adjusted, v >= 0.5 is_valid from (select report_id, greatest(0, coalesce(confidence, 0) - (0.3::double + case when {_any("claim", scores.ABSOLUTE)} then 0.2::double else 0 end
      + case when {" + ".join(_any("claim", w) + "::int" for w in scores.COUNTER)} >= 3 then 0.1::double else 0 end + case when {_WORDS} < 5 then 0.1::double else 0 end))::double v from {_CLAIMS})""",
)
def reflected_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Each claim's confidence after four layers of doubt, taken as having one piece of evidence."""
    v = scores.reflected_confidence(F.col("claim"), F.col("confidence"), F.lit(1))
    return _claims(spark, sf).select("report_id", F.round(v, 6).alias("adjusted"), (v >= 0.5).alias("is_valid"))


_asked = ", ".join(f"case when {_any('claim', words)} then {_q(q)} end" for words, qs in scores.WHAT_IFS for q in qs)


@CORE.query(
    "counterfactuals",
    f"select report_id, unnest(case when len(h) > 0 then h[1:5] else [{', '.join(map(_q, scores.OTHERWISE))}] end) question from (select report_id, list_filter([{_asked}], lambda x: x is not null) h from {_CLAIMS} where claim is not null)",
)
def counterfactuals(spark: SparkSession, sf: str) -> DataFrame:
    """The questions that each claim raises, five at most."""
    return _claims(spark, sf).where("claim is not null").select("report_id", F.explode(scores.counterfactuals(F.col("claim"))).alias("question"))


_TARGET = r"([a-z_0-9]+) in [^ ]+"
_said = " ".join(f"when {_any('claim', words)} then {_q(end)}" for words, end in reversed(scores.HYPOTHESES))


@CORE.query(
    "hypotheses",
    rf"""select report_id, t || case {_said} else {_q(scores.EXISTS)} end hypothesis from (select *, regexp_extract(lower(claim), '{_TARGET}', 1) t from {_CLAIMS} where claim is not null)
    where t <> '' and len(string_split(trim(regexp_replace(claim, '\s+', ' ', 'g')), ' ')) >= 4""",
)
def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """What can be tested about the function that a claim names; the last rule that holds."""
    said = scores.hypothesis(F.col("claim"), F.regexp_extract(F.lower("claim"), _TARGET, 1))
    return _claims(spark, sf).where("claim is not null").select("report_id", said.alias("hypothesis")).where("hypothesis is not null")


_SENSITIVE = ("deploy", "policy")


@CORE.query(
    "target_scores",
    rf"""select distinct patch_id, round((case when old_content is not null then 1 else 0 end + case when ends_with(lower(file_path), '.py') then 2 when regexp_matches(lower(file_path), '\.(md|txt|rst)$') then 0.5 else 0 end
      + case when contains(lower(file_path), 'test') then case when {_any("action_type", ("test", "coverage"))} then 1.5 else 0.5 end else 0 end - case when contains(file_path, 'deploy') or contains(file_path, 'policy') then 3 else 0 end)::double, 2) score
    from patches where file_path is not null""",
)
def target_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How good each patched file was as a target."""
    p = table(spark, sf, "patches", "patch_id", "file_path", "old_content", "action_type").where("file_path is not null")
    return p.select("patch_id", scores.target_score(F.col("file_path"), F.col("old_content").isNotNull(), F.col("action_type"), _SENSITIVE).alias("score")).distinct()


_KINDS = (("docstring", "missing_docstring"), ("except", "bare_except"), ("default argument", "mutable_default_arg"), ("eval", "eval_usage"))
_KIND = "case " + " ".join(f"when contains(issue, '{w}') then '{k}'" for w, k in _KINDS) + " end"
_SEEN = f"(select run_id, {_KIND} kind, case when severity in ('critical', 'high') then 2.0 else 1.0 end w from (select distinct tree_id, run_id, issue, severity from fractal_trees where run_id is not null))"


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "fractal_trees", "tree_id", "run_id", "issue", "severity").where("run_id is not null").distinct()
    kind = F.lit(None).cast("string")
    for w, k in reversed(_KINDS):
        kind = F.when(F.contains("issue", F.lit(w)), k).otherwise(kind)
    return t.select("run_id", kind.alias("kind"), F.when(F.col("severity").isin("critical", "high"), 2.0).otherwise(1.0).alias("w"))


@CORE.query(
    "abduced_runs",
    f"""select run_id, count(*) n, count(k) matched, round(least(1, count(k) / count(*) * 0.7 + least(coalesce(sum(w) filter (k is not null), 0) * 0.1, 0.3))::double + 1e-9, 2) confidence
    from (select *, kind k from {_SEEN}) group by 1""",
)
def abduced_runs(spark: SparkSession, sf: str) -> DataFrame:
    """How far known causes explain the findings of each run."""
    return scores.abduced(_seen(spark, sf), "run_id", "kind", "w")


_causes = ", ".join(f"({_q(k)}, {_q(c)}, {i})" for k, v in scores.CAUSES.items() for i, c in enumerate(v))


@CORE.query("run_causes", f"select run_id, cause, bool_or(i = 0) likely from {_SEEN} join (values {_causes}) v(kind, cause, i) using (kind) group by all")
def run_causes(spark: SparkSession, sf: str) -> DataFrame:
    """The different causes of each run's findings."""
    return scores.causes(_seen(spark, sf), "run_id", "kind")


@CORE.query("verdict_counts", "select verdict, count(*) n, round(avg(confidence), 6) mean from (" + CORE.sql["panel_vote"] + ") group by 1")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A5: how many claims the panel approves and rejects."""
    return panel_vote(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


_HASH = r"substr(sha256(trim(regexp_replace(claim, '\s+', ' ', 'g'), ' ')), 1, 16)"


@CORE.query("cached_votes", f"with v as ({CORE.sql['panel_vote']}), h as (select report_id, {_HASH} hash from claim_reports where claim is not null) select hash, arg_min(verdict, report_id) verdict, min(report_id) voted, count(*) - 1 hits from h join v using (report_id) group by 1")
def cached_votes(spark: SparkSession, sf: str) -> DataFrame:
    """F6 (exact hits), A34: each different claim's votes, held from its first report on, and how many later reports they answered.

    A claim's first report is the one that is voted on, so equal claims meet in one aggregate and only
    the first of each goes to the panel. Votes taken from a merely similar claim before are not built.
    """
    c = table(spark, sf, "claim_reports", "report_id", "claim").where("claim is not null").withColumn("hash", F.substring(F.sha2(squeeze("claim"), 256), 1, 16))
    first = c.groupBy("hash").agg(F.min_by("claim", "report_id").alias("claim"), F.min("report_id").alias("voted"), (F.count("*") - 1).alias("hits"))
    ruled = consensus.decide(consensus.panel_votes(first.select(F.col("voted").alias("report_id"), "claim")), "majority", claim="report_id")
    return first.join(ruled.select(F.col("report_id").alias("voted"), "verdict"), "voted").select("hash", "verdict", "voted", "hits")


@CORE.query("tracker_latest", _TRACK + "select user_id, run_count, last_run::varchar last_run from s order by run_count desc, s.last_run desc, user_id desc limit 500")
def tracker_latest(spark: SparkSession, sf: str) -> DataFrame:
    """T8, second store: the 500 keys with most runs, of equals those seen last."""
    kept = tracker.keep_latest(tracker.track(_errors(spark, sf), "user_id", "day"), "user_id", 500)
    return kept.select("user_id", "run_count", F.col("last_run").cast("string").alias("last_run"))


@CORE.query(
    "run_notes",
    "select run_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' | ') notes from (select run_id, list_filter(list_concat(coalesce(errors, []), coalesce(warnings, [])), lambda x: x is not null) l from (select distinct run_id, errors, warnings from runs))",
)
def run_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The different errors and warnings of each run, in their first order."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.array_compact(F.concat(F.coalesce("errors", none), F.coalesce("warnings", none))))
    return table(spark, sf, "runs", "run_id", "errors", "warnings").distinct().select("run_id", F.array_join(both, " | ").alias("notes"))


@CORE.query(
    "all_findings",
    """select 'tree' origin, issue text, severity, null::double confidence from (select distinct tree_id, issue, severity from fractal_trees) union all select 'report', claim, null, confidence from claim_reports
    union all select 'patch', issue, null, null from (select distinct patch_id, issue from patches)""",
)
def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all sources in one table; what a source lacks is null."""
    parts = [
        table(spark, sf, "fractal_trees", "tree_id", "issue", "severity").distinct().select(F.lit("tree").alias("origin"), F.col("issue").alias("text"), "severity"),
        table(spark, sf, "claim_reports", "claim", "confidence").select(F.lit("report").alias("origin"), F.col("claim").alias("text"), "confidence"),
        table(spark, sf, "patches", "patch_id", "issue").distinct().select(F.lit("patch").alias("origin"), F.col("issue").alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@CORE.query(
    "focus_claims",
    """with b as (select distinct branch from (select branch from claim_reports union all select branch from claim_updates) where branch is not null),
    f as (select branch, arg_max(claim, (updated_at, update_id)) claim from claim_updates where branch is not null and claim <> '' group by 1), l as (select branch, arg_max(claim, report_id) claim from claim_reports where branch is not null and claim <> '' group by 1)
    select branch, coalesce(f.claim, l.claim) claim from b left join f using (branch) left join l using (branch)""",
)
def focus_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The claim of each branch from the fuller source, else from the other; null if neither has one."""
    u, r = table(spark, sf, "claim_updates", "branch", "claim", "updated_at", "update_id").where("branch is not null"), table(spark, sf, "claim_reports", "branch", "claim", "report_id").where("branch is not null")
    full = u.where("claim != ''").groupBy("branch").agg(F.max_by("claim", F.struct("updated_at", "update_id")).alias("full"))
    last = r.where("claim != ''").groupBy("branch").agg(F.max_by("claim", "report_id").alias("last"))
    branches = u.select("branch").union(r.select("branch")).distinct()
    return branches.join(full, "branch", "left").join(last, "branch", "left").select("branch", F.coalesce("full", "last").alias("claim"))


@CORE.query(
    "child_ids",
    _P1_WITH + "select distinct tree_id, path node_path, case when path = '0' then '0' else regexp_replace(path, '\\.?[0-9]+$', '') || '-' || (len(string_split(path, '.')) - 1) || '-' || regexp_extract(path, '([0-9]+)$', 1) end child_id from n",
)
def child_ids(spark: SparkSession, sf: str) -> DataFrame:
    """An id for each node of its parent, its level and its place."""
    n = dewey.label_trees(table(spark, sf, "fractal_trees", "tree_id", "tree"), values=False).where("row_kind = 'node'")
    made = F.concat_ws("-", "parent_path", (F.size(F.split("row_path", r"\.")) - 1).cast("string"), F.substring_index("row_path", ".", -1))
    return n.select("tree_id", F.col("row_path").alias("node_path"), F.when(F.col("parent_path") == "", F.lit("0")).otherwise(made).alias("child_id"))


@CORE.query("run_labels", "select distinct run_id, 'run-' || strftime(ts, '%Y%m%dT%H%M%SZ') label, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' utc from runs where ts is not null")
def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A label of each run and its start as UTC text."""
    r = table(spark, sf, "runs", "run_id", "ts").where("ts is not null").distinct()
    return r.select("run_id", F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).alias("label"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("utc")).distinct()


_TREE_KEY = "substr(sha256(coalesce(issue, '') || ':' || coalesce(file, '') || ':' || coalesce(line, 0)), 1, 16)"


@CORE.query("tree_cache", f"select key, min(tree_id) tree_id, count(*) - 1 hits from (select tree_id, {_TREE_KEY} key from (select distinct tree_id, issue, file, line from fractal_trees)) group by 1")
def tree_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Trees by the hash of their finding: the one that is kept, and how many later ones it answers."""
    t = table(spark, sf, "fractal_trees", "tree_id", "issue", "file", "line").distinct()
    key = F.substring(F.sha2(F.concat_ws(":", F.coalesce("issue", F.lit("")), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)).cast("string")), 256), 1, 16)
    return t.groupBy(key.alias("key")).agg(F.min("tree_id").alias("tree_id"), (F.count("*") - 1).alias("hits"))


@CORE.query("python_symbols")
def python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Functions (kind 12) and classes (kind 5) at the top of each Python file."""
    from lodespark.plans.reference_graph import _facts

    return _facts(spark, sf).where("kind = 'symbol'").select("patch_id", "name", "line", F.col("value").cast("int").alias("symbol_kind"))
