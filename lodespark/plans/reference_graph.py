"""Graph, code, set, calibration and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import consensus, dewey, graph, history, reports, search
from lodespark.operators import sources_of_code as code
from lodespark.plans.catalog import CORE
from lodespark.plans.reference_search import _hits, _most, _pick
from lodespark.plans.training_data import _P1_WITH
from lodespark.sources.tables import table

_CALLS = r"([a-z_0-9]+) in [^ ]+ calls ([a-z_0-9]+)"
_E = rf"""e as (select distinct regexp_extract(t, '{_CALLS}', 1) src, regexp_extract(t, '{_CALLS}', 2) dst from (select regexp_replace(lower(claim), '[ \t\r\n]+', ' ', 'g') t from claim_reports)
 where regexp_matches(t, '{_CALLS}') and regexp_extract(t, '{_CALLS}', 1) <> regexp_extract(t, '{_CALLS}', 2))"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    t = F.regexp_replace(F.lower("claim"), r"[ \t\r\n]+", " ")
    rows = table(spark, sf, "claim_reports", "claim").withColumn("t", t).where(F.col("t").rlike(_CALLS))
    return graph.edges(rows.select(F.regexp_extract("t", _CALLS, 1).alias("a"), F.regexp_extract("t", _CALLS, 2).alias("b")), "a", "b")


@CORE.query("graph_edges", f"with {_E} select src, dst from e")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The call graph that claims tell of."""
    return _edges(spark, sf)


_DEG = f"{_E}, n as (select src node, 0 i, 1 o from e union all select dst, 1, 0 from e), g as (select node, sum(i)::bigint fan_in, sum(o)::bigint fan_out, (sum(i) + sum(o))::bigint centrality from n group by 1)"


@CORE.query("degree_centrality", f"with {_DEG} select * from g")
def degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    """Fan-in, fan-out and their sum."""
    return graph.degrees(_edges(spark, sf))


@CORE.query("top_hubs", f"with {_DEG} select * from g order by centrality desc, fan_in desc, fan_out desc, node desc limit 10")
def top_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """The most central nodes."""
    return graph.hubs(_edges(spark, sf), 10)


@CORE.query(
    "reachability",
    f"with recursive {_E}, r as (select src as start_, dst node from e union select r.start_, e.dst from r join e on r.node = e.src) select start_ as \"start\", node from r",
)
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    """Everything downstream of every caller."""
    e = _edges(spark, sf)
    return graph.reachable(e, e.select("src").distinct()).select("start", "node")


@CORE.query("cycle_nodes", f"with recursive {_E}, r as (select src as start_, dst node from e union select r.start_, e.dst from r join e on r.node = e.src) select node from r where start_ = node")
def cycle_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """G4 in canonical form: nodes that lie on a cycle."""
    return graph.cycle_nodes(_edges(spark, sf)).select("node")


@CORE.query("trace_call_cycles")
def trace_call_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """G4 on the graph of traced calls: nodes on a cycle of calls, with the length of their shortest one."""
    from lodespark.operators import runs

    t = table(spark, sf, "traces", "trace_id", "run_id", "phase", "ts", "function_name", "stack_depth")
    return graph.cycle_nodes(graph.edges(runs.call_edges(t), "caller", "callee"))


@CORE.query("orphans", f"with {_E} select distinct split_part(function_name, '.', 3) \"function\" from perf_records where function_name is not null and split_part(function_name, '.', 3) not in (select src from e union all select dst from e)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Measured functions that are no end of any told call."""
    f = table(spark, sf, "perf_records", "function_name").select(F.split_part("function_name", F.lit("."), F.lit(3)).alias("function"))
    return graph.orphans(f, _edges(spark, sf), "function")


@CORE.query("coverage_gap", "select distinct function_name from traces where function_name is not null and function_name not in (select function_name from perf_records where function_name is not null)")
def coverage_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Traced functions without a finished measurement."""
    t = table(spark, sf, "traces", "function_name").where("function_name is not null").distinct()
    return t.join(table(spark, sf, "perf_records", "function_name").distinct(), "function_name", "left_anti")


@CORE.query(
    "longest_prefix_resolve",
    """with n as (select distinct function_name from traces where function_name is not null), m as (select distinct module_name from perf_records where module_name is not null)
    select function_name, arg_max(module_name, length(module_name)) resolved from n left join m on function_name = module_name or starts_with(function_name, module_name || '.') group by 1""",
)
def longest_prefix_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Each traced function's module by its longest known prefix."""
    return graph.resolve_longest(table(spark, sf, "traces", "function_name"), "function_name", table(spark, sf, "perf_records", "module_name"), "module_name")


@CORE.query("contains_link", "with i as (select distinct lower(issue) issue from fractal_trees where issue is not null), c as (select report_id, lower(claim) t from claim_reports) select issue, count(*) claims from i join c on contains(t, issue) group by 1")
def contains_link(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that contain the text of a known issue."""
    issues = table(spark, sf, "fractal_trees", "issue").select(F.lower("issue").alias("issue"))
    claims = table(spark, sf, "claim_reports", "claim").select(F.lower("claim").alias("claim"))
    return search.contained(claims, "claim", issues, "issue").groupBy("issue").agg(F.count("*").alias("claims"))


_P = "(select distinct patch_id, repo, file_path, old_content, new_content, diff, applied_at from patches)"


def _patches(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "patches", "patch_id", *columns).dropDuplicates(["patch_id"])


@CORE.query("ext_profile", rf"select regexp_extract(lower(file_path), '\.([^./\\]+)$', 1) ext, count(*) n from {_P} group by 1")
def ext_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Files by extension."""
    return _patches(spark, sf, "file_path").groupBy(code.extension(F.col("file_path")).alias("ext")).agg(F.count("*").alias("n"))


_SLASH = r"regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"


@CORE.query("top_dirs", f"select split_part({_SLASH}, '/', 1) dir, count(*) n from {_P} group by 1 order by n desc, dir limit 5")
def top_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """A2: the five largest top directories."""
    d = F.split_part(code.slashes(F.col("file_path")), F.lit("/"), F.lit(1)).alias("dir")
    return _patches(spark, sf, "file_path").groupBy(d).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(5)


@CORE.query(
    "path_flags",
    f"""select patch_id, contains(p, 'test') is_test, contains(p, 'deploy') is_ci, regexp_matches(p, '\\.(json|ya?ml|toml)$') is_config, contains(p, 'token') or contains(p, 'auth') is_sensitive
    from (select patch_id, lower({_SLASH}) p from {_P})""",
)
def path_flags(spark: SparkSession, sf: str) -> DataFrame:
    """What a path says about a file."""
    p = F.lower(code.slashes(F.col("file_path")))
    any_of = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(p, w))
    return _patches(spark, sf, "file_path").select(
        "patch_id", any_of("test").alias("is_test"), any_of("deploy").alias("is_ci"), p.rlike(r"\.(json|ya?ml|toml)$").alias("is_config"), any_of("token", "auth").alias("is_sensitive")
    )


@CORE.query(
    "diff_line_counts",
    f"""select patch_id, len(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') and not starts_with(x, '+++')))::bigint added,
    len(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '-') and not starts_with(x, '---')))::bigint removed from {_P} where diff is not null""",
)
def diff_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Added and removed lines of each patch."""
    return code.diff_counts(_patches(spark, sf, "diff"), "patch_id", "diff")


@CORE.query(
    "positional_diff",
    f"""select patch_id, len(list_filter(list_zip(string_split(coalesce(old_content, ''), chr(10)), string_split(coalesce(new_content, ''), chr(10))), lambda x: x[1] is distinct from x[2]))::bigint changed from {_P}""",
)
def positional_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that differ by place."""
    return _patches(spark, sf, "old_content", "new_content").select("patch_id", code.changed_lines(F.col("old_content"), F.col("new_content")).alias("changed"))


@CORE.query(
    "snapshot_diff",
    f"""with f as (select repo, {_SLASH} path, arg_min(substr(sha256(old_content), 1, 16), (applied_at, patch_id)) h from {_P} where old_content is not null group by all),
    l as (select repo, {_SLASH} path, arg_max(substr(sha256(new_content), 1, 16), (applied_at, patch_id)) h from {_P} where new_content is not null group by all)
    select coalesce(f.repo, l.repo) repo, coalesce(f.path, l.path) path, case when f.h is null then 'new' when l.h is null then 'deleted' when f.h = l.h then 'unchanged' else 'changed' end "change"
    from f full join l on f.repo is not distinct from l.repo and f.path = l.path""",
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's first old against its last new fingerprint."""
    p = _patches(spark, sf, "repo", "file_path", "old_content", "new_content", "applied_at").withColumn("path", code.slashes(F.col("file_path")))
    side = lambda c, pick: p.where(F.col(c).isNotNull()).withColumn("h", code.fingerprint(F.col(c))).groupBy("repo", "path").agg(pick("h", F.struct("applied_at", "patch_id")).alias("h"))
    d = history.difference(side("old_content", F.min_by), side("new_content", F.max_by), ["repo", "path"], ["h"])
    names = F.create_map(*[F.lit(x) for x in ("inserted", "new", "deleted", "deleted", "same", "unchanged", "changed", "changed")])
    return d.select("repo", "path", names[F.col("change")].alias("change"))


def _sql_text(x: str) -> str:
    return x.replace("'", "''")


_LINES = f"(select patch_id, unnest(string_split(new_content, chr(10))) line, generate_subscripts(string_split(new_content, chr(10)), 1)::int line_no from {_P} where new_content is not null)"
_VALUE = f"regexp_extract(line, '{_sql_text(code.ASSIGNED)}', 1)"
_FINE = f"({_VALUE} = '' or not (lower(trim({_VALUE})) in ({', '.join(repr(v) for v in code.NO_SECRET)}) or regexp_matches(line, '{code.READ}')))"


@CORE.query("secret_line_scan", " union all ".join(f"select patch_id, line_no, '{k}' risk_type, '{sev}' severity from {_LINES} where regexp_matches(line, '{_sql_text(rx)}') and {_FINE}" for k, (sev, rx) in code.SECRET_LINES.items()))
def secret_line_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that one of three patterns takes for a secret, without placeholders."""
    return code.secret_lines(code.lines_of(_patches(spark, sf, "new_content"), "patch_id", "new_content")).select("patch_id", "line_no", "risk_type", "severity")


_BOTH = "coalesce(old_content, '') || chr(10) || coalesce(new_content, '')"


@CORE.query("secret_match_count", f"select * from (select patch_id, unnest(range(1, {len(code.SECRET_PATTERNS) + 1}))::int pattern, unnest([" + ", ".join(f"len(regexp_extract_all({_BOTH}, '{_sql_text(rx)}'))" for rx in code.SECRET_PATTERNS) + f"])::bigint n from {_P}) where n > 0")
def secret_match_count(spark: SparkSession, sf: str) -> DataFrame:
    """How often each of six patterns occurs in each patch; without rows a patch passes."""
    found = F.posexplode(code.patch_secrets(F.col("old_content"), F.col("new_content"))).alias("p", "n")
    return _patches(spark, sf, "old_content", "new_content").select("patch_id", found).where("n > 0").select("patch_id", (F.col("p") + 1).alias("pattern"), "n")


@CORE.query("source_metrics", f"select repo, count(*) files, sum(len(string_split(new_content, chr(10))))::bigint lines, count(*) filter (regexp_matches(new_content, '(?i)todo|fixme|hack')) todo_files from {_P} where new_content is not null group by 1")
def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Files, lines and files with open notes by repo."""
    p = _patches(spark, sf, "repo", "new_content").where("new_content is not null")
    return p.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.size(F.split("new_content", "\n", -1))).alias("lines"), F.count_if(F.col("new_content").rlike("(?i)todo|fixme|hack")).alias("todo_files"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    p = _patches(spark, sf, "file_path", "new_content").where(code.extension(F.col("file_path")).isin("py", "pyi"))
    return code.python_facts(p, "patch_id", "new_content")


@CORE.query("python_imports")
def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Which module each Python file imports."""
    return _facts(spark, sf).where("kind = 'import'").select("patch_id", "name").distinct()


@CORE.query("python_functions")
def python_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with their risk scores."""
    return _facts(spark, sf).where("kind = 'function'").select("patch_id", "name", "line", F.col("value").alias("risk_score"))


@CORE.query("python_findings")
def python_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the syntax tree by kind."""
    f = _facts(spark, sf).where("kind in ('risk', 'fstring_sql', 'bare_except', 'long_function', 'no_docstring')")
    return f.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("patch_id").alias("files"))


@CORE.query("python_calls")
def python_calls(spark: SparkSession, sf: str) -> DataFrame:
    """How often which call occurs."""
    return _facts(spark, sf).where("kind = 'call'").groupBy("name").agg(F.count("*").alias("calls"))


@CORE.query("normalized_dedup", r"select k claim_key, arg_min(claim, report_id) first_spelling, count(*) copies from (select *, lower(regexp_replace(claim, '^\s+|\s+$', '', 'g')) k from claim_reports where claim is not null) where k <> '' group by 1")
def normalized_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Claims by normal form, the first spelling kept."""
    c = table(spark, sf, "claim_reports", "report_id", "claim").withColumn("claim_key", F.lower(F.regexp_replace("claim", r"^\s+|\s+$", ""))).where("claim_key != ''")
    return c.groupBy("claim_key").agg(F.min_by("claim", "report_id").alias("first_spelling"), F.count("*").alias("copies"))


_META = "^((risk|note|claim|issue|old|the|a)[: ]+)+"


@CORE.query("canonical_dedup", f"select regexp_replace(lower(trim(claim, ' ')), '{_META}', '') claim_key, count(*) copies from claim_reports where claim is not null group by 1")
def canonical_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Claims by what remains without leading labels."""
    return table(spark, sf, "claim_reports", "claim").where("claim is not null").groupBy(F.regexp_replace(F.lower(F.trim("claim")), _META, "").alias("claim_key")).agg(F.count("*").alias("copies"))


@CORE.query(
    "novelty_score",
    r"""with c as (select report_id, run_id, reported_at, lower(trim(claim, ' ')) k from claim_reports where claim is not null),
    w as (select report_id, row_number() over (partition by k, run_id order by reported_at, report_id) i, row_number() over (partition by k order by reported_at, report_id) j from c)
    select report_id, (case when i > 1 then 0 when j > 1 then 0.25 else 1 end)::double novelty from w""",
)
def novelty_score(spark: SparkSession, sf: str) -> DataFrame:
    """U4: 0 for what the run has said before, a quarter for what an earlier run said, else 1."""
    from pyspark.sql import Window

    c = table(spark, sf, "claim_reports", "report_id", "run_id", "claim", "reported_at").where("claim is not null").withColumn("k", F.lower(F.trim("claim")))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("reported_at", "report_id"))
    return c.select("report_id", F.when(place("k", "run_id") > 1, 0.0).when(place("k") > 1, 0.25).otherwise(1.0).alias("novelty"))


@CORE.query("branch_map", "select branch, arg_max(claim, report_id) claim from claim_reports where branch is not null and claim is not null and trim(claim, ' ') <> '' group by 1")
def branch_map(spark: SparkSession, sf: str) -> DataFrame:
    """The last claim of each branch."""
    c = table(spark, sf, "claim_reports", "report_id", "branch", "claim").where("branch is not null and claim is not null and trim(claim) != ''")
    return c.groupBy("branch").agg(F.max_by("claim", "report_id").alias("claim"))


@CORE.query("branch_subtree", "select report_id from claim_reports where branch = 'x.a' or starts_with(branch, 'x.a.')")
def branch_subtree(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of a branch and all below it; the filter reaches the scan."""
    b = F.col("branch")
    return table(spark, sf, "claim_reports", "report_id", "branch").where((b == "x.a") | b.startswith("x.a.")).select("report_id")


@CORE.query("paths_in_claims", r"select report_id, unnest(list_distinct(regexp_extract_all(claim, '[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+\.[a-z]+'))) path from claim_reports where claim is not null")
def paths_in_claims(spark: SparkSession, sf: str) -> DataFrame:
    """File paths that a claim names."""
    found = F.array_distinct(F.regexp_extract_all("claim", F.lit(r"[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+\.[a-z]+"), F.lit(0)))
    return table(spark, sf, "claim_reports", "report_id", "claim").select("report_id", F.explode(found).alias("path"))


@CORE.query("json_in_text", r"select report_id, regexp_extract(claim, '(?s)\{.*\}') body from claim_reports where regexp_matches(claim, '(?s)\{.*\}')")
def json_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """What stands between the first and the last curly bracket."""
    return table(spark, sf, "claim_reports", "report_id", "claim").where(F.col("claim").rlike(r"(?s)\{.*\}")).select("report_id", F.regexp_extract("claim", r"(?s)\{.*\}", 0).alias("body"))


@CORE.query("token_estimate", r"select source, sum(greatest(1, ceil(length(trim(text, ' ')) / 4.0)))::bigint est, floor(sum(length(text)) / 4.0)::bigint flat from documents where text is not null group by 1")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Two estimates of tokens by source."""
    d = table(spark, sf, "documents", "source", "text").where("text is not null")
    return d.groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.length(F.trim("text")) / 4))).alias("est"), F.floor(F.sum(F.length("text")) / 4).alias("flat"))


@CORE.query(
    "calibration",
    """with e as (select l_partkey, l_tax * 10 w, l_suppkey s, l_linestatus = 'F' d, l_returnflag = 'R' c from lineitem),
    a as (select l_partkey, sum(w) tw, count(distinct s) src, count(*) filter (d) dc, coalesce(sum(w) filter (c), 0) cw from e group by 1),
    p as (select p_partkey, (p_size % 10) / 10.0::double conf, tw, src, dc, cw from part left join a on p_partkey = l_partkey),
    s as (select *, case when tw is null then conf * 0.5 else greatest(0, least(1, conf * case when round(tw, 6) >= 2.5 then 1.15 when round(tw, 6) >= 1.5 then 1.0 else 0.8 end + least(0.1, dc * 0.05) - case when cw > 0 then least(0.4, cw / tw) else 0 end)) end adj from p)
    select p_partkey, round(adj + 1e-9, 4)::double adjusted, coalesce(cw > 0, false) has_conflict, (case when tw is null then 0 else round(least(1.0, src / 3.0), 2) end)::double diversity from s""",
)
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """A claim's confidence adjusted by weight, directness, diversity and conflict of its evidence."""
    li = table(spark, sf, "lineitem", "l_partkey", "l_tax", "l_suppkey", "l_linestatus", "l_returnflag")
    w = F.col("l_tax") * 10
    a = li.groupBy("l_partkey").agg(
        F.sum(w).alias("tw"), F.countDistinct("l_suppkey").alias("src"), F.count_if(F.col("l_linestatus") == "F").alias("dc"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", w)), F.lit(0.0)).alias("cw")
    )
    p = table(spark, sf, "part", "p_partkey", "p_size").join(a, F.col("p_partkey") == F.col("l_partkey"), "left")
    conf, tw = (F.col("p_size") % 10) / 10.0, F.round("tw", 6)
    factor = F.when(tw >= 2.5, 1.15).when(tw >= 1.5, 1.0).otherwise(0.8)
    bonus, penalty = F.least(F.lit(0.1), F.col("dc") * 0.05), F.when(F.col("cw") > 0, F.least(F.lit(0.4), F.col("cw") / F.col("tw"))).otherwise(0.0)
    adj = F.when(F.col("tw").isNull(), conf * 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf * factor + bonus - penalty)))
    return p.select("p_partkey", F.round(adj + 1e-9, 4).alias("adjusted"), F.coalesce(F.col("cw") > 0, F.lit(False)).alias("has_conflict"), F.when(F.col("tw").isNull(), 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("src") / 3), 2)).alias("diversity"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return dewey.node_table(dewey.label_trees(table(spark, sf, "fractal_trees", "tree_id", "tree")))


_TREE = _P1_WITH + "select distinct tree_id, path, try_cast(j->>'confidence' as double) confidence from n"
TREE_META = f"""select tree_id, count(*) nodes, max(len(string_split(path, '.')))::int "depth", round(avg(confidence) * case when max(len(string_split(path, '.'))) >= 5 then 1.0 else 0.8 end, 6) aggregate from ({_TREE}) group by 1"""


@CORE.query("tree_meta", TREE_META)
def tree_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Size, depth and mean confidence of each tree, with the penalty for shallow ones."""
    g = _nodes(spark, sf).groupBy("tree_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.avg("confidence").alias("m"))
    return g.select("tree_id", "nodes", "depth", F.round(F.col("m") * F.when(F.col("depth") >= 5, 1.0).otherwise(0.8), 6).alias("aggregate"))


@CORE.query(
    "expand_budgeted",
    f"""select tree_id, place::int place, path node_path, case when i < 26 then chr(97 + i) else chr(96 + i // 26) || chr(97 + i % 26) end token from (select *, regexp_extract(path, '([0-9]+)$', 1)::int i,
    row_number() over (partition by tree_id order by list_transform(string_split(path, '.'), lambda x: x::int)) place from (select distinct tree_id, path from ({_TREE}))) where place <= 10""",
)
def expand_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten nodes of each tree in depth-first order, with their branch tokens."""
    n = graph.preorder(_nodes(spark, sf).select("tree_id", "node_path", "parent_path"), "tree_id", "node_path").where("place <= 10")
    return n.select("tree_id", "place", "node_path", graph.branch_token(F.substring_index("node_path", ".", -1).cast("int")).alias("token"))


@CORE.query("tree_outline")
def tree_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Each tree as an indented list."""
    return reports.indented(_nodes(spark, sf), "tree_id", "node_path", "question")


@CORE.query("tree_mermaid")
def tree_mermaid(spark: SparkSession, sf: str) -> DataFrame:
    """Each tree as lines of a flowchart."""
    return reports.mermaid_edges(_nodes(spark, sf), "tree_id", "node_path", "parent_path", "answer")


@CORE.query(
    "metrics_exposition",
    """select 'events_total' "name", 'events_total{event_type="' || event_type || '",day="' || (ts::date)::varchar || '"} ' || count(*) line from events where event_type is not null and ts is not null group by event_type, ts::date""",
)
def metrics_exposition(spark: SparkSession, sf: str) -> DataFrame:
    """Daily event counts in the Prometheus text format."""
    e = table(spark, sf, "events", "ts", "event_type").where("event_type is not null and ts is not null").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return reports.exposition(e.withColumn("metric", F.lit("events_total")), "metric", ["event_type", "day"], "n")


@CORE.query(
    "sarif_rules",
    """with t as (select distinct tree_id, issue, severity from fractal_trees where issue is not null), r as (select *, substr(replace(lower(issue), ' ', '-'), 1, 40) rule_id from t)
    select rule_id, arg_min(issue, tree_id) "name", case when bool_or(lower(severity) in ('critical', 'high')) then 'error' else 'warning' end "level", count(*) results from r group by 1""",
)
def sarif_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of a static-analysis report with their levels."""
    t = table(spark, sf, "fractal_trees", "tree_id", "issue", "severity").distinct()
    return reports.sarif_rules(t, "issue", "severity", "tree_id")


@CORE.query("severity_counts", "select severity, count(*) n, count(*) filter (lower(severity) = 'critical') critical from (select distinct tree_id, severity from fractal_trees) group by 1")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by severity."""
    t = table(spark, sf, "fractal_trees", "tree_id", "severity").distinct()
    return t.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.lower("severity") == "critical").alias("critical"))


@CORE.query("pass_rate_bars", "select repo, rpad(repeat('#', floor(r * 30)::int), 30, '.') bar from (select repo, count(*) filter (tests_passed) / count(*) r from (select distinct run_id, repo, tests_passed from runs) group by 1)")
def pass_rate_bars(spark: SparkSession, sf: str) -> DataFrame:
    """K8: each repo's share of passed tests as a bar."""
    r = table(spark, sf, "runs", "run_id", "repo", "tests_passed").distinct().groupBy("repo").agg((F.count_if("tests_passed") / F.count("*")).alias("r"))
    return r.select("repo", reports.bar(F.col("r")).alias("bar"))


@CORE.query(
    "error_diff",
    """with r as (select * from (select *, row_number() over (partition by run_id order by loaded_at desc) k from runs) where k = 1),
    w as (select repo, run_id, coalesce(errors, []) e, coalesce(lag(errors) over (partition by repo order by ts, run_id), []) p from r)
    select run_id, len(list_filter(list_distinct(e), lambda x: not list_contains(p, x)))::bigint appeared, len(list_filter(list_distinct(p), lambda x: not list_contains(e, x)))::bigint resolved from w""",
)
def error_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Errors that each run brings and resolves against the run before."""
    from pyspark.sql import Window

    from lodespark.operators import runs

    r = runs.distinct_runs(table(spark, sf, "runs", "run_id", "repo", "ts", "errors", "loaded_at"))
    none = F.array().cast("array<string>")
    e, p = F.coalesce("errors", none), F.coalesce(F.lag("errors").over(Window.partitionBy("repo").orderBy("ts", "run_id")), none)
    w = r.select("run_id", e.alias("e"), p.alias("p"))
    return w.select("run_id", F.size(F.array_except("e", "p")).cast("long").alias("appeared"), F.size(F.array_except("p", "e")).cast("long").alias("resolved"))


@CORE.query(
    "benchmark_regression",
    """with o as (select distinct record_id, run_id, function_name, total_time_ms, call_count from perf_records where function_name is not null), r as (select distinct run_id, ts from runs),
    h as (select function_name, sum(total_time_ms) filter (ts < '2031-07-01') / nullif(sum(call_count) filter (ts < '2031-07-01'), 0) b, sum(total_time_ms) filter (ts >= '2031-07-01') / nullif(sum(call_count) filter (ts >= '2031-07-01'), 0) c from o join r using (run_id) group by 1)
    select function_name, round(b + 1e-9, 3) baseline, round(c + 1e-9, 3) "current" from h where c > b * 2""",
)
def benchmark_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Functions whose mean time more than doubled since the first half of the year."""
    o = table(spark, sf, "perf_records", "record_id", "run_id", "function_name", "total_time_ms", "call_count").where("function_name is not null").distinct()
    r = history.run_order(table(spark, sf, "runs", "run_id", "ts"))
    late = F.col("run_ts") >= F.lit("2031-07-01").cast("timestamp_ntz")
    mean = lambda c: F.sum(F.when(c, F.col("total_time_ms"))) / F.nullif(F.sum(F.when(c, F.col("call_count"))), F.lit(0))
    h = o.join(r, "run_id").groupBy("function_name").agg(mean(~late).alias("b"), mean(late).alias("c")).where("c > b * 2")
    return h.select("function_name", F.round(F.col("b") + 1e-9, 3).alias("baseline"), F.round(F.col("c") + 1e-9, 3).alias("current"))


@CORE.query("intent_vote", f"select run_id, {_pick} intent from (select *, {_most} m from (select run_id, {_hits} from (select distinct run_id, lower(goal) t, goal from runs)))")
def intent_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's goal by the words of claim types."""
    r = table(spark, sf, "runs", "run_id", "goal").distinct()
    return r.select("run_id", consensus.best_label(F.col("goal")).alias("intent"))
