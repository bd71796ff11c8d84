"""Queries of the general problems: nested records (1), history (3), snapshot changes (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import dewey, history, snapshots
from lodespark.plans.catalog import CORE
from lodespark.sources.tables import table

TRACKED = ["branch", "confidence", "status", "first_seen_run", "last_seen_run", "run_count"]


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fractal_trees", "tree_id", "tree")


_P1_SQL = r"""
with recursive n(tree_id, path, j) as (
  select distinct tree_id, '0', tree::json from fractal_trees where tree is not null and json_valid(tree) and json_type(tree) = 'OBJECT'
  union all
  select tree_id, path || '.' || (i - 1), c from (
    select tree_id, path, unnest(cs) c, generate_subscripts(cs, 1) i from (
      select tree_id, path, case json_type(ch) when 'ARRAY' then ch::json[] when 'OBJECT' then [ch] else [] end cs from (
        select tree_id, path, case when json_type(j->'children') = 'VARCHAR' then (j->>'children')::json else j->'children' end ch from n)))
  where json_type(c) = 'OBJECT'),
e as (select tree_id, path, unnest(es) v, generate_subscripts(es, 1) i from (
  select tree_id, path, case json_type(j->'evidence') when 'ARRAY' then (j->'evidence')::json[] when 'NULL' then [] else [j->'evidence'] end es from n where json_type(j->'evidence') is not null)),
m as (select n.tree_id, n.path, t.fullkey k, t.type ty from n, json_tree(n.j->'metadata') t where json_type(n.j->'metadata') is not null)
select tree_id, 'node' row_kind, path row_path, regexp_replace(path, '\.?[0-9]+$', '') parent_path from n
union select tree_id, 'evidence', path || '#' || (i - 1), path from e where json_type(v) <> 'NULL'
union select tree_id, 'metadata', path || '@' || ltrim(replace(replace(replace(replace(k, '$', ''), '[', '.'), ']', ''), '"', ''), '.'), path from m where ty not in ('OBJECT', 'ARRAY', 'NULL')
"""


@CORE.query("p1_found", _P1_SQL)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every node, evidence entry and metadata value with its parent."""
    return dewey.label_trees(_trees(spark, sf), values=False)


_P1_WITH = _P1_SQL[: _P1_SQL.index("select tree_id, 'node' row_kind")]


@CORE.query(
    "p1_nodes",
    _P1_WITH
    + r"""select distinct tree_id, path node_path, regexp_replace(path, '\.?[0-9]+$', '') parent_path, len(string_split(path, '.'))::int "depth", try_cast(j->>'level' as int) "level",
  j->>'question' question, j->>'answer' answer, try_cast(j->>'confidence' as double) confidence, j->>'rebuttal' rebuttal from n""",
)
def p1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of nodes."""
    return dewey.node_table(dewey.label_trees(_trees(spark, sf)))


@CORE.query(
    "p1_evidence",
    _P1_WITH
    + r"""select distinct tree_id, path || '#' || (i - 1) evidence_path, path node_path, (i - 1)::int "position", case when json_type(v) = 'VARCHAR' then v->>'$' end "text",
  case when json_type(v) = 'OBJECT' then v->>'source' end "source", case when json_type(v) = 'OBJECT' then v->>'type' end "type",
  case when json_type(v) = 'OBJECT' then try_cast(v->>'weight' as double) end weight, case when json_type(v) = 'OBJECT' then try_cast(v->>'contradicts' as boolean)::varchar end contradicts
  from e where json_type(v) <> 'NULL'""",
)
def p1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of evidence."""
    return dewey.evidence_table(dewey.label_trees(_trees(spark, sf))).withColumn("contradicts", F.col("contradicts").cast("string"))


_P1_KEYS = r"""ltrim(replace(replace(replace(replace(k, '$', ''), '[', '.'), ']', ''), '"', ''), '.')"""
_P1_META = rf"""w as (select n.tree_id, n.path, t.fullkey k, t.type ty, n.j->'metadata'->>t.fullkey v from n, json_tree(n.j->'metadata') t where json_type(n.j->'metadata') is not null),
x as (select distinct tree_id, path || '@' || {_P1_KEYS} metadata_path, path node_path, 'node.metadata' || case when k = '$' then '' else '.' || regexp_replace({_P1_KEYS}, '(^|\.)[0-9]+(?=\.|$)', '\1*', 'g') end schema_path,
  case when ty = 'VARCHAR' then 'string' when ty = 'BOOLEAN' then 'boolean' else 'number' end value_type, v "value" from w where ty not in ('OBJECT', 'ARRAY', 'NULL'))""".replace("(?=\\.|$)", "(\\.|$)").replace("'\\1*'", "'\\1*\\2'")


@CORE.query("p1_metadata", f"{_P1_WITH.rstrip()}, {_P1_META} select * from x")
def p1_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of metadata values."""
    return dewey.metadata_table(dewey.label_trees(_trees(spark, sf)))


@CORE.query(
    "p1_tables",
    f"""{_P1_WITH.rstrip()}, {_P1_META},
r as (select distinct 'node' schema_path, tree_id, path row_path, (j::varchar) v from n
  union select distinct 'node.evidence.' || case json_type(v) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' else 'number' end, tree_id, path || '#' || (i - 1), '' from e where json_type(v) <> 'NULL'
  union select schema_path, tree_id, metadata_path, '' from x)
select schema_path, count(distinct tree_id || ' ' || row_path)::bigint n_rows from r group by 1""",
)
def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables that the trees' rows form by schema path, and how many rows each has."""
    return dewey.schema_tables(dewey.label_trees(_trees(spark, sf))).select("schema_path", "n_rows")


_P3_SQL = r"""
with r as (select run_id, min(ts) ts from runs where run_id is not null and ts is not null group by 1),
s as (
  select claim_id, last_seen_run run_id, 1 rk, received_at, update_id, status, confidence from claim_updates
  union all
  select claim_id, h.run_id, 0, received_at, update_id, h.status_change, h.confidence
  from (select claim_id, received_at, update_id, unnest(history) h from claim_updates)),
n as (select claim_id, run_id, rk, received_at, update_id,
  nullif(regexp_replace(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), '') status, confidence from s where claim_id is not null),
one as (select * from (select n.*, ts, row_number() over (partition by claim_id, n.run_id order by rk desc, received_at desc, update_id desc, status desc, confidence desc) k
  from n join r on r.run_id = n.run_id) where k = 1),
f as (select claim_id, run_id, ts,
  last_value(status ignore nulls) over w status, last_value(confidence ignore nulls) over w confidence
  from one window w as (partition by claim_id order by ts, run_id rows between unbounded preceding and current row)),
c as (select *, row_number() over v = 1 or status is distinct from lag(status) over v or confidence is distinct from lag(confidence) over v opens
  from f window v as (partition by claim_id order by ts, run_id))
"""


@CORE.query("p3_found", _P3_SQL + "select claim_id, run_id from_run, coalesce(lead(run_id) over (partition by claim_id order by ts, run_id), '') to_run from c where opens")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The runs from and until which each version of a claim held."""
    return history.versions(_updates(spark, sf), table(spark, sf, "runs", "run_id", "ts")).select("claim_id", "from_run", "to_run")


@CORE.query(
    "p3_history",
    _P3_SQL
    + "select claim_id, status, confidence, run_id from_run, coalesce(lead(run_id) over x, '') to_run, ts from_ts, lead(ts) over x to_ts from c where opens window x as (partition by claim_id order by ts, run_id)",
)
def p3_history(spark: SparkSession, sf: str) -> DataFrame:
    """Each version with its values and its period."""
    return history.versions(_updates(spark, sf), table(spark, sf, "runs", "run_id", "ts")).select("claim_id", "status", "confidence", "from_run", "to_run", "from_ts", "to_ts")


_P3_SNAPSHOTS = r"""
with k as (select *, lower(regexp_replace(claim, '^\s+|\s+$', '', 'g')) claim_key from claim_snapshots where repo is not null and snapshot_no is not null),
l as (select * from (select *, rank() over (partition by repo, snapshot_no order by load_no desc) rk from k) where rk = 1 and claim_key <> ''),
d as (select repo, snapshot_no, row_number() over (partition by repo order by snapshot_no) o from (select distinct repo, snapshot_no from k)),
v as (select distinct repo, claim_key, o, status, confidence from l join d using (repo, snapshot_no)),
g as (select *, sum(opens) over (partition by repo, claim_key order by o) part from (select *, case when lag(o) over w = o - 1 and status is not distinct from lag(status) over w and confidence is not distinct from lag(confidence) over w then 0 else 1 end opens
  from v window w as (partition by repo, claim_key order by o))),
s as (select repo, claim_key, part, min(o) lo, max(o) hi, min(status) status, min(confidence) confidence from g group by 1, 2, 3)
select s.repo, claim_key, a.snapshot_no from_no, b.snapshot_no::varchar to_no, status, confidence from s join d a on a.repo = s.repo and a.o = lo left join d b on b.repo = s.repo and b.o = hi + 1
"""


@CORE.query("p3_snapshots", _P3_SNAPSHOTS)
def p3_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each claim of a repo's tracker over its full snapshots, with the snapshot that ended each."""
    return history.snapshot_versions(_snapshots(spark, sf), ["status", "confidence"]).withColumn("to_no", F.col("to_no").cast("string"))


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claim_updates", "update_id", "claim_id", "last_seen_run", "status", "confidence", "history", "received_at")


_P5_SQL = r"""
with k as (select *, lower(regexp_replace(claim, '^\s+|\s+$', '', 'g')) claim_key from claim_snapshots where repo is not null and snapshot_no is not null),
l as (select * from (select *, rank() over (partition by repo, snapshot_no order by load_no desc) rk from k) where rk = 1 and claim_key <> ''),
d as (select repo, snapshot_no, lead(snapshot_no) over (partition by repo order by snapshot_no) nxt, row_number() over (partition by repo order by snapshot_no) o
  from (select distinct repo, snapshot_no from k)),
v as (select distinct l.repo, l.snapshot_no, nxt, o, claim_key, branch, confidence, status, first_seen_run, last_seen_run, run_count from l join d using (repo, snapshot_no)),
j as (select coalesce(a.repo, b.repo) repo, coalesce(a.nxt, b.snapshot_no) snapshot_no, coalesce(a.claim_key, b.claim_key) claim_key,
  case when a.claim_key is null then 'added' when b.claim_key is null then 'removed'
    when a.branch is distinct from b.branch or a.confidence is distinct from b.confidence or a.status is distinct from b.status
      or a.first_seen_run is distinct from b.first_seen_run or a.last_seen_run is distinct from b.last_seen_run or a.run_count is distinct from b.run_count then 'changed' end change_kind
  from (select * from v where nxt is not null) a full join (select * from v where o > 1) b on a.repo = b.repo and a.nxt = b.snapshot_no and a.claim_key = b.claim_key)
"""


@CORE.query("p5_found", _P5_SQL + "select repo, snapshot_no, claim_key, change_kind from j where change_kind is not null")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Claims added, removed or changed between consecutive snapshots of each repo."""
    return snapshots.changes(_snapshots(spark, sf), TRACKED).drop("old", "new")


@CORE.query("p5_change_counts", _P5_SQL + "select repo, snapshot_no, change_kind, count(*) n from j where change_kind is not null group by all")
def p5_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many claims changed in which way at each snapshot."""
    return snapshots.changes(_snapshots(spark, sf), TRACKED).groupBy("repo", "snapshot_no", "change_kind").agg(F.count("*").alias("n"))


@CORE.query(
    "p5_values",
    _P5_SQL.replace("case when a.claim_key is null", "a.status old_status, b.status new_status, a.run_count::varchar old_count, b.run_count::varchar new_count, case when a.claim_key is null")
    + "select repo, snapshot_no, claim_key, old_status, new_status, old_count, new_count from j where change_kind = 'changed'",
)
def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    """Status and number of runs of each changed claim, before and after."""
    changed = snapshots.changes(_snapshots(spark, sf), TRACKED).where("change_kind = 'changed'")
    return changed.selectExpr("repo", "snapshot_no", "claim_key", "old.status old_status", "new.status new_status", "cast(old.run_count as string) old_count", "cast(new.run_count as string) new_count")


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claim_snapshots", "repo", "snapshot_no", "load_no", "claim", *TRACKED)
